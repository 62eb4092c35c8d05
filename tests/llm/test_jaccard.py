import random
import re
from itertools import combinations

import numpy as np
import pytest

from streamwarden.llm import jaccard
from tests.llm.fixtures import SCHEMA, WORDS, odd_documents, odd_frame


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return sets, [root(i) for i in range(len(texts))]


def family(seed, n, edits, words=150):
    """Copies of one text with a few words changed, so that not all of them link."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"new{rng.randint(0, 99999)}"
        out.append(" ".join(own))
    return out


def check(spark, rows, **options):
    got = jaccard.similar_groups(odd_frame(spark, rows), **options).collect()
    sets, roots = brute_force([t for _, t, _ in rows])
    lowest = {}
    for (doc_id, _, _), own, root in zip(rows, sets, roots, strict=True):
        if own and doc_id is not None:
            lowest[root] = min(lowest.get(root, doc_id), doc_id)
    wanted = [
        (doc_id, len(own), lowest.get(root) if own else doc_id) for (doc_id, _, _), own, root in zip(rows, sets, roots, strict=True)
    ]
    assert sorted(map(str, wanted)) == sorted(str((r.id, r.n_shingles, r.component_id)) for r in got)


def test_odd_rows(spark):
    check(spark, odd_documents())


@pytest.mark.parametrize("region, together", [(2, 64), (10, 3), (2048, 64), (2048, 3)])
def test_families_and_a_shared_passage(spark, monkeypatch, region, together):
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    monkeypatch.setattr(jaccard, "ROWS", 50)
    monkeypatch.setattr(jaccard, "COMMON", 300)
    monkeypatch.setattr(jaccard, "SPREAD", 8)
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rng = random.Random(1)
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = family(2, 30, 6) + family(3, 10, 3, words=40) + family(6, 12, 2, words=70)
    texts += [f"{passage} {' '.join(f'own{rng.randint(0, 10**6)}' for _ in range(rng.randint(5, 80)))}" for _ in range(30)]
    rng.shuffle(texts)
    check(spark, [(i, t, None) for i, t in enumerate(texts)], region=region)


def test_exact_threshold(spark):
    # 20 words have 16 shingles; sharing 16 of 20 is linked, 16 of 21 is not
    base = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(base), None), (2, " ".join([*base, "a", "b", "c", "d"]), None), (3, " ".join([*base, "p", "q", "r", "s", "t"]), None)]
    check(spark, rows)
    got = {r.id: r.component_id for r in jaccard.similar_groups(odd_frame(spark, rows)).collect()}
    assert got[2] == 1 and got[3] == 3


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        whole = np.unique(rng.integers(0, 2**63, rng.integers(2, 400), dtype=np.uint64))
        a, b = (np.unique(rng.choice(whole, rng.integers(1, len(whole) + 1))) for _ in range(2))
        bits = jaccard.bits_for(min(len(a), len(b)))
        x, y = (jaccard.stacked([jaccard.sketch_of(s)], bits) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_regions_in_tasks_lose_no_pair():
    texts = family(5, 60, 5)
    sets = jaccard.shingle_sets(texts)
    bits = max(jaccard.bits_for(len(s)) for s in sets) // 2
    found, more = jaccard.region_pairs(
        np.arange(60), np.arange(60), np.array(list(map(len, sets))), jaccard.stacked(list(map(jaccard.sketch_of, sets)), bits), leaf=5
    )
    assert not more
    for i, j in combinations(range(60), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            assert (i, j) in found


@pytest.mark.parametrize("most", [None, 1, 3])
def test_regions_joined_together_offer_the_same_pairs(most):
    rng = np.random.default_rng(2)
    texts = family(7, 12, 5) + family(8, 9, 5) + family(9, 2, 1)
    sets = jaccard.shingle_sets(texts)
    sizes = np.array(list(map(len, sets)))
    sketches = jaccard.stacked(list(map(jaccard.sketch_of, sets)), 256)
    start, nodes, parts = np.array([0, 12, 21]), np.arange(100, 123), rng.integers(0, 5, 23)
    first, second, back = jaccard.small_regions_pairs(start, nodes, parts, sizes, sketches, 80, most)
    for g, (a, b) in enumerate(zip(start, [12, 21, 23], strict=True)):
        alone, more = jaccard.region_pairs(nodes[a:b], parts[a:b], sizes[a:b], sketches[a:b], most=most)
        own = {(int(nodes[i]), int(nodes[j])) for i, j in zip(first, second, strict=True) if a <= i < b}
        if most is None:
            assert own == set(alone) and not more and not back[g]
        else:
            assert len(own) <= most * (len(set(parts[a:b])) - 1) and (bool(own) == bool(alone))


def test_keep_one_keeps_columns(spark):
    rows = odd_documents()
    kept = jaccard.keep_one(odd_frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "id"]
    sets, roots = brute_force([t for _, t, _ in rows])
    groups = len({r for r, s in zip(roots, sets, strict=True) if s})
    assert kept.count() == groups + sum(not s for s in sets)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.similar_groups(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0


def test_components_of_a_long_chain(spark):
    from streamwarden.llm.links import components

    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_a_region_decides_by_itself_and_tells_links_only():
    texts = family(11, 50, 9) + family(12, 10, 3)
    sets = jaccard.shingle_sets(texts)
    bits = max(jaccard.bits_for(len(s)) for s in sets) // 2
    links = jaccard.region_links(np.arange(60), sets, bits)
    _, roots = brute_force(texts)
    up = list(range(60))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert roots[a] == roots[b] and root(a) != root(b)  # no link between what is joined
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert len({root(i) for i in range(60)}) == len(set(roots)) and len(links) == 60 - len(set(roots))


def test_a_pair_is_looked_at_in_its_first_region():
    rng = np.random.default_rng(4)
    regions = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    for key in range(60):
        own = [i for i, r in enumerate(regions) if key in r]
        first = np.array([(list(regions[i][: jaccard.FIRST_KEYS]) + [key] * jaccard.FIRST_KEYS)[: jaccard.FIRST_KEYS] for i in own])
        i, j = (np.array(x) for x in zip(*combinations(range(len(own)), 2), strict=True))
        mine = jaccard.owned(first, key, i, j)
        for a, b, m in zip(i, j, mine, strict=True):
            assert m or min(set(regions[own[a]]) & set(regions[own[b]])) < key
        assert key < 30 or mine.mean() < 0.1


def test_rows_of_an_undecided_group_grow_with_its_size(spark, monkeypatch):
    """Copies too far from each other to link: no pair is told, whatever their number."""
    told = []
    whole = jaccard._joined_in_tasks

    def counted(*args):
        found = jaccard.cut(whole(*args))
        told.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_joined_in_tasks", counted)
    texts = family(13, 60, 9)
    check(spark, [(i, t, None) for i, t in enumerate(texts)])
    sizes = [len(s) for s in jaccard.shingle_sets(texts)]
    assert len(told) == 1 and told[0] <= sum(jaccard.prefix_length(s) for s in sizes)


def test_few_links_take_few_tasks(spark):
    from streamwarden.llm import links

    edges = spark.range(100).selectExpr("id + 1 AS a", "id AS b").repartition(50)
    step = links._small_star(links._large_star(edges, 1), 1)
    assert step.rdd.getNumPartitions() == 1


def test_sketches_are_short_and_tell_strangers_apart():
    rng = np.random.default_rng(11)
    for size in (65, 128, 129, 300, 1000, 1025, 5000):
        a, b = (np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(2))
        assert len(jaccard.sketch_of(a)) * 8 < 2 * size
        bits = jaccard.bits_for(size)
        x, y = (jaccard.stacked([jaccard.sketch_of(s)], bits) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() > jaccard.most_apart(len(a), len(b), 80)


def test_regions_by_size_hold_every_pair_that_may_link(spark):
    sizes = [*range(1, 70), *range(100, 135), *range(250, 330, 3), *range(500, 660, 5)]
    regions = spark.createDataFrame([(1, n, n) for n in sizes], "key long, node long, size int")
    places: dict[int, set[int]] = {}
    for row in jaccard.by_size(regions, 80).collect():
        places.setdefault(row.node, set()).add(row.bits)
    assert all(jaccard.bits_for(n) in places[n] for n in sizes)
    assert all(places[a] & places[b] for a in sizes for b in sizes if 100 * min(a, b) >= 80 * max(a, b))
