"""Exact top-k by inner product with a table of distances to pivots.

Vectors become whole numbers, floor(scale * x). Inner products turn into distances
when every candidate gets one more component that brings all candidates to the same
length R (the longest candidate's) and queries get 0 there:
``|q - c|**2 = |q|**2 + R**2 - 2 * <q, c>``. By the triangle inequality the distance
is at least ``max over pivots |d(q, p) - d(c, p)|``, so the inner product is at most
``(|q|**2 + R**2 - bound**2) / 2``. Candidates are taken in the order of that bound,
and the search of a query ends as soon as the next bound lies below the score of
its k-th hit: nothing after it can score as much, equal scores included.

The distances to the pivots are worked out once for each vector. Queries and
candidates are dealt into blocks of bounded size, each pair of blocks is one task's
work, and it hands on k rows for each query at most. Pivots are chosen on the
driver from a documented sample of ``PIVOT_SAMPLE`` vectors; they only set how
good the bounds are, never the result.

Bounds are floating point numbers and are widened by a relative 1e-9; scores are
whole numbers of 64 bits. Null and non-finite components keep their vector out, and so does
a sum of squares of 2**62 or more, the score of the vector with itself: below that every
score fits. Shorter vectors count as filled up with
zeros, an empty one scores 0. A null id keeps its vector out. Rows that repeat an id
are candidates of their own; a query leaves out every row with its own id, and a
repeated query id is asked once for each distinct vector. Empty tables give empty
results; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamwarden.llm.columns import cut

SCALE = 256
PIVOTS = 24
PIVOT_SAMPLE = 1024  # vectors that pivots are chosen from
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
LIMIT = 2.0**62  # of a vector's sum of squares
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, *, id_column="vec_id", vector_column="embedding", scale=SCALE) -> DataFrame:
    """(id, v): vectors in whole numbers; those that take no part are left out."""
    v = F.col("v")
    x = F.col(vector_column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    # a floor lies less than 1 from its number
    square = F.aggregate(x, F.lit(0.0), lambda a, e: a + F.pow(F.abs(e.cast("double")) * scale + 1, F.lit(2.0)))
    good = finite & (square < LIMIT)
    return (
        vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & good)
        .select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
        .filter(v.isNotNull())
    )


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Each next pivot is the sample's vector farthest from those chosen."""
    chosen = [0]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if nearest.max() <= 0:
            break
        chosen.append(int(np.argmax(nearest)))
    return sample[chosen]


def _matrix(rows, width: int) -> np.ndarray:
    full = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        full[i, : len(row)] = row
    return full


def _distances(matrix: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots; ``extra`` is the added component."""
    lifted = np.concatenate([matrix.astype(np.float64), extra[:, None]], axis=1)
    squares = (lifted**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * lifted @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def search_block(q_ids, q, q_far, c_ids, c, c_far, radius2: float, k: int) -> tuple[list, int]:
    """Best k candidates of each query in one block, and how many were scored."""
    found, scored = [], 0
    q_norms = (q.astype(np.float64) ** 2).sum(axis=1)
    for i in range(len(q_ids)):
        bound = np.abs(c_far - q_far[i]).max(axis=1)
        # rounding: distances of this size are right to about 1e-12 of their scale
        slack = SLACK * (q_norms[i] + radius2 + 1)
        most = (q_norms[i] + radius2 - bound**2) / 2 + slack
        order = np.argsort(-most, kind="stable")
        order = order[c_ids[order] != q_ids[i]]
        ids = np.zeros(0, np.int64)
        scores = np.zeros(0, np.int64)
        start, step = 0, 64
        while start < len(order):
            if len(scores) >= k and most[order[start]] < scores[k - 1]:
                break
            part = order[start : start + step]
            scores = np.append(scores, c[part] @ q[i])
            ids = np.append(ids, c_ids[part])
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            scored += len(part)
            start, step = start + step, step * 2
        found += [(int(q_ids[i]), int(n), int(s)) for n, s in zip(ids, scores, strict=True)]
    return found, scored


def top_k(
    vectors: DataFrame,
    is_query,
    *,
    k: int = 5,
    pivots: int = PIVOTS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, id, score) for the rows where ``is_query`` (a column of ``id``) holds."""
    whole = whole_vectors(vectors, id_column=id_column, vector_column=vector_column, scale=scale)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)
    facts = whole.agg(F.max(F.size("v")), F.max(square), F.count("*")).first()
    width, radius2, count = facts[0] or 0, float(facts[1] or 0), facts[2]
    sample = [r.v for r in whole.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOT_SAMPLE).collect()]
    matrix = _matrix(sample, width)

    def lift(rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(radius2 - (rows.astype(np.float64) ** 2).sum(axis=1), 0))

    if len(matrix):
        table = choose_pivots(np.concatenate([matrix.astype(np.float64), lift(matrix)[:, None]], axis=1), pivots)
    else:
        table = np.zeros((0, 1))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = _matrix(frame["v"].tolist(), width)
            yield frame.assign(
                as_candidate=list(_distances(rows, lift(rows), table)), as_query=list(_distances(rows, np.zeros(len(rows)), table))
            )

    # the pivot table: once for each vector, kept for both roles
    measured = cut(whole.mapInPandas(measure, "id long, v array<long>, as_candidate array<double>, as_query array<double>"))
    asked = measured.filter(is_query(F.col("id"))).select("id", "v", F.col("as_query").alias("far")).dropDuplicates(["id", "v"])
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    candidate_blocks = max(1, -(-count // CANDIDATE_BLOCK))

    def dealt(df, own, own_blocks, other, other_blocks):
        """Each row in its own block, once for every block of the other side."""
        return df.select(
            F.pmod(F.xxhash64("id", "v"), F.lit(own_blocks)).alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)).cast("array<long>")).alias(other),
            "id",
            "v",
            "far",
        )

    left = dealt(asked, "qb", query_blocks, "cb", candidate_blocks)
    right = dealt(measured.select("id", "v", F.col("as_candidate").alias("far")), "cb", candidate_blocks, "qb", query_blocks)

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}, dtype="int64")
        found, _ = search_block(
            queries["id"].to_numpy(),
            _matrix(queries["v"].tolist(), width),
            np.stack(queries["far"].to_numpy()),
            candidates["id"].to_numpy(),
            _matrix(candidates["v"].tolist(), width),
            np.stack(candidates["far"].to_numpy()),
            radius2,
            k,
        )
        return pd.DataFrame(found, columns=["query_id", "id", "score"], dtype="int64")

    hits = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(search, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op3_pivot_top_k(spark, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet")
    found = top_k(vectors, lambda vec_id: vec_id % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


ORACLE = """
WITH whole AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
