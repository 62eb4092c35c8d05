import math

import numpy as np
import pytest

from streamwarden.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, x string, n string"


def plain(vectors, components):
    """deviation, |whitened| and explained by dense arithmetic on the listed rows."""
    x = [[min(max(math.floor(64 * c), -(2**63)), W.LIMIT - W.SHIFT) + W.SHIFT for c in v] for v in vectors]
    n = len(x)
    sums = [sum(column) for column in zip(*x, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in x])
    e, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:components]
    order = [k for k in order if e[k] > 1e-9 * e.max()]
    return deviation, np.abs(centred @ basis[:, order] / np.sqrt(e[order])), e[order] / e.sum()


def check(found, rows, vectors, components):
    deviation, whitened, explained = plain(vectors, components)
    by_id = {r.vec_id: r for r in found}
    assert len(found) == len(rows)
    for k, vec_id in enumerate(rows):
        r = by_id[vec_id]
        assert r.n == len(vectors)
        assert r.deviation == (deviation[k] if deviation[k] <= W.LIMIT else None)
        assert np.allclose(np.abs(r.whitened), whitened[k], atol=1e-7)
        assert np.allclose(r.explained, explained, rtol=1e-7)
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_dense_arithmetic_with_copies(spark, parts):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)) * [5, 4, 3, 2, 1, 0.5]
    chosen = [base[k].tolist() for k in rng.integers(0, 60, 200)] + [base[0].tolist()] * 150
    rows = [(k, v, "clash", "clash") for k, v in enumerate(chosen)]
    odd = [(900, None, "", ""), (901, [None] + [1.0] * 5, "", ""), (902, [float("nan")] * 6, "", ""), (903, [float("inf")] + [1.0] * 5, "", "")]
    found = W.whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(parts), components=4).collect()
    check(found, [r[0] for r in rows], chosen, 4)
    signs = {tuple(r.whitened) for r in found if r.vec_id >= 200}
    assert len(signs) == 1


def test_lengths_apart_and_vectors_without_variance(spark):
    rows = [(k, [float(k), float(-k)], "", "") for k in range(4)] + [(10 + k, [float(k * k)], "", "") for k in range(3)]
    rows += [(20, [], "", ""), (None, [9.0, 2.0], "", ""), (30, [1.0, 2.0, 3.0], "", ""), (31, [1.0, 2.0, 3.0], "", "")]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    two = [r for r in found if r.vec_id is None or r.vec_id < 4]
    check([r for r in found if r.vec_id in (10, 11, 12)], [10, 11, 12], [[0.0], [1.0], [4.0]], 32)
    assert len(two) == 5 and len(found) == 8
    assert all(len(r.whitened) == 2 and r.n == 5 for r in two)


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, [1.0], "", ""), (1, [1.0], "", ""), (1, [2.0], "", "")]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 3 and {r.n for r in found} == {3}
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame(rows[:2], SCHEMA)).collect() == []


def test_huge_components_keep_exact_deviations(spark):
    vectors = [[3e5, 0.0], [1e12, 1.0], [-1e30, 2.0], [1e30, 3.0], [2.5, 4.0]]
    small = [[3e5, 0.0], [-4e6, 1.0], [2.5, 4.0]]
    rows = [(k, v, "", "") for k, v in enumerate(vectors)]
    found = {r.vec_id: r for r in W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    deviation = plain(vectors, 1)[0]
    assert {k: r.deviation for k, r in found.items()} == {k: d if d <= W.LIMIT else None for k, d in enumerate(deviation)}
    found = {r.vec_id: r for r in W.whiten(spark.createDataFrame([(k, v, "", "") for k, v in enumerate(small)], SCHEMA)).collect()}
    assert [found[k].deviation for k in range(3)] == plain(small, 2)[0]


def test_query_on_the_smallest_table(spark):
    folder = "/root/testdata/sf0.001"
    found = W.op13_embedding_whitening(spark, folder).toPandas()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    deviation, whitened, explained = plain([[float(c) for c in v] for v in table["embedding"]], 32)
    ids = table["vec_id"].tolist()
    assert len(found) == len(ids) * 32
    wide = found.assign(size=found["whitened"].abs()).pivot(index="vec_id", columns="component", values="size").loc[ids]
    assert np.allclose(wide.to_numpy(), whitened, atol=1e-7)
    assert dict(zip(found["vec_id"], found["deviation"], strict=True)) == dict(zip(ids, deviation, strict=True))
    shares = found.drop_duplicates("component").sort_values("component")["explained"]
    assert np.allclose(shares, explained, rtol=1e-9)
    assert found["identity_error"].max() < 1e-8
