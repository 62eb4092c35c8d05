"""Answering prompts from a cache of embedded earlier prompts."""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from streamwarden.session import cut

ACCEPT = 0.94
PIVOTS = 32
PIVOT_SAMPLE = 1024
BLOCK = 4096
# Phrases that mark a hesitant reply.
HEDGES = ("i'm not sure", "i am not sure", "unclear", "cannot determine", "insufficient information")


def is_confident(reply: Column) -> Column:
    return ~F.lower(reply).rlike("|".join(HEDGES)) & (F.length(reply) > 0)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, unit): vectors scaled to length one. NULL vectors, those that hold NULL, NaN or
    an infinite value and those of length zero resemble nothing and are left out."""
    doubles = F.col("embedding").cast("array<double>")
    square = F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x)
    sized = vectors.select("id", doubles.alias("v"), square.alias("square"))
    good = F.col("square").isNotNull() & (F.col("square") > 0) & ~F.isnan("square") & (F.col("square") < float("inf"))
    norm = F.sqrt("square")
    return sized.where(good).select("id", F.transform("v", lambda x: F.try_divide(x, norm)).alias("unit"))


def _spread_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Each next pivot is the sample's vector least like those chosen."""
    chosen, closest = [0], np.full(len(sample), -2.0)
    while len(chosen) < min(most, len(sample)):
        closest = np.maximum(closest, sample @ sample[chosen[-1]])
        if closest.min() >= 1 - 1e-12:
            break
        chosen.append(int(np.argmin(closest)))
    return sample[chosen]


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def nearest(prompts: DataFrame, cache: DataFrame, accept: float = ACCEPT, block: int = BLOCK) -> DataFrame:
    """(prompt_id, cache_id, similarity): the most similar cached vector at or above
    ``accept``; of equally similar ones the smallest id. Exact for every size.

    ``prompts`` and ``cache`` hold (id, embedding). Equal vectors are merged before
    anything is compared. Cached vectors lie in the cell of their closest pivot. A
    match lies within the angle acos(accept) of its prompt, so by the triangle
    inequality a prompt has to visit only cells whose pivot is at most twice that angle
    farther than its closest one, and no farther than the cell reaches plus the angle.
    Cells are dealt into blocks of about ``block`` vectors; a block and a block of prompts
    are compared as a matrix product that hands on one row per prompt, never pairs.
    Only vectors of one length are compared. Pivots come from ``PIVOT_SAMPLE`` vectors
    (a documented bound); they set the amount of work, never the result.
    """
    asked_rows = distinct_vectors(prompts)
    stored = cut(usable(distinct_vectors(cache)).withColumn("dims", F.size("unit")))
    asked = cut(usable(asked_rows).withColumn("dims", F.size("unit")))
    pivots = choose_pivots(stored)
    placed = cut(stored.mapInPandas(placer(pivots), "id long, unit array<double>, dims int, cell int, angle double"))
    cells = cell_sizes(placed).collect()  # at most PIVOTS rows for each vector length
    visits = cut(visited(asked, pivots, cells, accept))
    return best_of(prompts, asked_rows, matches_in_cells(visits, placed, cells, accept, block))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("embedding").agg(F.min("id").alias("id"))


def choose_pivots(stored: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each vector length, spread over a bounded sample of unit vectors."""
    sample: dict[int, list] = {}
    for row in stored.orderBy(F.xxhash64("unit"), "id").limit(PIVOT_SAMPLE).collect():
        sample.setdefault(row.dims, []).append(row.unit)
    return {dims: _spread_pivots(np.array(rows), PIVOTS) for dims, rows in sample.items()}


def _pivots_of(pivots: dict[int, np.ndarray], dims: int) -> np.ndarray:
    """A length that the sample missed has one pivot: the first axis."""
    return pivots[dims] if dims in pivots else np.eye(1, dims)


def placer(pivots: dict[int, np.ndarray]):
    """Adds the cell of the closest pivot, and the angle to it, to frames with ``unit`` and ``dims``."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, part in frame.groupby("dims"):
                angles = _angles(np.stack(part["unit"].to_numpy()), _pivots_of(pivots, int(dims)))
                cell = angles.argmin(axis=1)
                yield part.assign(cell=cell.astype("int32"), angle=angles[np.arange(len(part)), cell])

    return place


def cell_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("dims", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))


def visited(asked: DataFrame, pivots: dict[int, np.ndarray], cells: list, accept: float) -> DataFrame:
    """(id, unit, dims, cell): the cells in which a match of each prompt can lie."""
    reach = math.acos(min(1.0, accept)) + 1e-9
    known: dict[int, list] = {}
    for row in cells:
        known.setdefault(row.dims, []).append((row.cell, row.radius))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, part in frame.groupby("dims"):
                own = known.get(int(dims))
                if not own:
                    continue
                angles = _angles(np.stack(part["unit"].to_numpy()), _pivots_of(pivots, int(dims)))
                close = angles.min(axis=1)
                for cell, radius in own:
                    near = (angles[:, cell] <= radius + reach) & (angles[:, cell] <= close + 2 * reach)
                    yield part[near].assign(cell=np.int32(cell))

    return asked.mapInPandas(visit, "id long, unit array<double>, dims int, cell int")


def matches_in_cells(visits: DataFrame, placed: DataFrame, cells: list, accept: float, block: int) -> DataFrame:
    """(p, c, similarity): the best cached vector of each prompt and block it is compared with.

    A cell is cut into blocks of cached vectors and sides of prompts, as many as its own vectors
    and visits need; a vector goes to the sides of its cell, and nowhere if nobody visits it.
    """
    asked = visits.groupBy("dims", "cell").agg(F.count("*").alias("visits"))  # a row a cell at most
    sizes = {(r.dims, r.cell): -(-r.n // block) for r in cells}
    shape = [
        (r.dims, r.cell, sizes[r.dims, r.cell], -(-r.visits // block)) for r in asked.collect() if (r.dims, r.cell) in sizes
    ]
    spark = visits.sparkSession
    shapes = F.broadcast(spark.createDataFrame(shape, "dims int, cell int, blocks long, sides long"))
    # every block of the cell is compared with a prompt of one side; a cached vector is in one block
    questions = (
        visits.join(shapes, ["dims", "cell"])
        .withColumn("side", F.pmod(F.xxhash64("id"), "sides"))
        .withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    dealt = (
        placed.join(shapes, ["dims", "cell"])
        .withColumn("number", F.pmod(F.xxhash64("id"), "blocks"))
        .withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    )
    key = ["dims", "cell", "number", "side"]

    def compare(questions: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(questions) or not len(answers):
            return pd.DataFrame({"p": [], "c": [], "similarity": []})
        answers = answers.sort_values("id")
        alike = np.stack(questions["unit"].to_numpy()) @ np.stack(answers["unit"].to_numpy()).T
        best = alike.argmax(axis=1)  # the first of equal ones: the smallest id
        found = pd.DataFrame({"p": questions["id"].to_numpy(), "c": answers["id"].to_numpy()[best], "similarity": alike.max(axis=1)})
        return found[found["similarity"] >= accept]

    asked_in = questions.select(*key, "id", "unit").groupBy(*key)
    return asked_in.cogroup(dealt.select(*key, "id", "unit").groupBy(*key)).applyInPandas(compare, "p long, c long, similarity double")


def best_of(prompts: DataFrame, asked_rows: DataFrame, compared: DataFrame) -> DataFrame:
    """(prompt_id, cache_id, similarity) of every prompt, equal ones included."""
    best = compared.groupBy("p").agg(F.max(F.struct("similarity", (-F.col("c")).alias("minus"))).alias("m"))
    matched = asked_rows.join(best, F.col("id") == F.col("p")).select("embedding", "m")
    return prompts.join(matched, "embedding").select(
        F.col("id").alias("prompt_id"), (-F.col("m.minus")).alias("cache_id"), "m.similarity"
    )


def answer(prompts: DataFrame, matches: DataFrame, cache: DataFrame) -> DataFrame:
    """Answers from the cache, else the cheap reply when it is confident, else the strong one."""
    hits = matches.join(
        cache.select(F.col("id").alias("cache_id"), "response_text", F.col("model_used").alias("cached_model")), "cache_id"
    )
    joined = prompts.join(hits, prompts.id == hits.prompt_id, "left")
    hit = F.col("cache_id").isNotNull()
    sure = is_confident(F.col("cheap"))
    return joined.select(
        prompts.id.alias("prompt_id"),
        F.when(hit, F.col("response_text")).when(sure, F.col("cheap")).otherwise(F.col("strong")).alias("response"),
        F.when(hit, F.col("cached_model")).when(sure, "cheap").otherwise("strong").alias("model_used"),
        hit.alias("cache_hit"),
    )


def cache_hits(cache: DataFrame, matches: DataFrame, at: Column) -> DataFrame:
    """The cache with hit counts and last-hit times brought up to date."""
    hits = matches.groupBy("cache_id").agg(F.count(F.lit(1)).alias("new_hits"), F.max(at).alias("newest"))
    joined = cache.join(hits, cache.id == hits.cache_id, "left").drop("cache_id")
    return joined.withColumn("hit_count", F.col("hit_count") + F.coalesce("new_hits", F.lit(0))).withColumn(
        "last_hit_at", F.greatest("last_hit_at", "newest")
    ).drop("new_hits", "newest")
