import math
import random

import numpy as np

from streamwarden.llm import pivot_search

SCHEMA = "vec_id long, embedding array<float>, id string, v string"


def brute_force(rows, k, every):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for query in sorted({(i, tuple(v)) for i, v in whole if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(query[1], v, strict=False)), i) for i, v in whole if i != query[0])
        out += [(query[0], n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=10):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = pivot_search.top_k(frame, lambda i: i % every == 0, k=k).collect()
    assert sorted(tuple(r) for r in got) == brute_force(rows, k, every)


def vectors(rng, n, size=8):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    # multiples of 1/64 are exact as floats
    return [[round((x + rng.gauss(0, 0.2)) * 64) / 64 for x in rng.choice(centres)] for _ in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 7)
    rng = random.Random(1)
    rows = [(i, v, None, "clash") for i, v in enumerate(vectors(rng, 300))]
    check(spark, rows)


def test_ties_and_odd_vectors(spark):
    rng = random.Random(2)
    same = vectors(rng, 1)[0]
    rows = [(i, same, None, None) for i in range(25)]
    rows += [(30, None, None, None), (40, [float("nan")] * 8, None, None), (50, [None] * 8, None, None), (60, [math.inf] * 8, None, None)]
    rows += [(70, [], None, None), (80, same[:3], None, None), (None, same, None, None), (90, [0.0] * 8, None, None)]
    check(spark, rows)


def test_large_components_take_part(spark):
    rng = random.Random(3)
    rows = [(i, v, None, None) for i, v in enumerate(vectors(rng, 40))]
    rows += [(100, [3e5] + [0.0] * 7, None, None), (101, [-3e5, 4e6] + [0.5] * 6, None, None), (110, [2.0**20] * 8, None, None)]
    check(spark, rows)
    # a vector whose score with itself exceeds 64 bits stays out
    found = pivot_search.top_k(spark.createDataFrame([*rows, (120, [2.0**22] * 8, None, None)], SCHEMA), lambda i: i % 10 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute_force(rows, 5, 10)


def test_few_and_no_rows(spark):
    check(spark, [(0, [1.0, 2.0], None, None)])
    check(spark, [(0, [1.0, 2.0], None, None), (1, [0.5, 0.25], None, None)])
    check(spark, [])


def test_bounds_end_the_search_early():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 2, (500, 4)) for c in (-300, 0, 300)]).round().astype(np.int64)
    ids = np.arange(len(points))
    radius2 = float((points.astype(float) ** 2).sum(axis=1).max())
    lift = np.sqrt(radius2 - (points.astype(float) ** 2).sum(axis=1))
    lifted = np.concatenate([points, lift[:, None]], axis=1)
    pivots = pivot_search.choose_pivots(lifted, 24)
    far = pivot_search._distances(points, lift, pivots)
    own = pivot_search._distances(points[:20], np.zeros(20), pivots)
    found, scored = pivot_search.search_block(ids[:20], points[:20], own, ids, points, far, radius2, 5)
    assert scored < 0.7 * 20 * len(points)
    for q in range(20):
        wanted = sorted((-int(points[q] @ points[c]), c) for c in ids if c != q)[:5]
        assert [(s, c) for i, c, s in found if i == q] == [(-s, c) for s, c in wanted]
