"""Cached answering as a job: a stored index of answered prompts that its own misses extend.

The index is a table of unit vectors by the cell of their closest pivot. Its pivots are
chosen once, from the first vectors that arrive, and stored; they set which files are read,
never the result. A micro-batch reads the cells its prompts can have a match in, answers
from them, and appends what it had to answer anew, so that the same prompts hit next time.
A batch that runs again looks at the index as it was before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from streamwarden.operators import answers as A
from streamwarden.session import cut
from streamwarden.sources.keyed_table import KeyedTable
from streamwarden.sources.tables import exists

ENTRY = (
    "place int, dims int, cell int, id long, embedding array<double>, unit array<double>, angle double, "
    "response_text string, model_used string"
)
CELL = "place int, dims int, cell int, radius double, n long"


def _total(held: DataFrame, new: DataFrame) -> DataFrame:
    both = held.unionByName(new)
    return both.groupBy("place", "dims", "cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class AnswerCache:
    path: str
    accept: float = A.ACCEPT
    block: int = A.BLOCK

    @property
    def entries(self) -> KeyedTable:
        return KeyedTable(f"{self.path}/entries", ("place",), ENTRY, buckets=1, direct=True)

    @property
    def cells(self) -> KeyedTable:
        """Reach and size of each cell: a row a cell."""
        return KeyedTable(f"{self.path}/cells", ("place",), CELL, buckets=1)

    def pivots(self, spark: SparkSession, offered: DataFrame | None = None) -> dict[int, np.ndarray]:
        """The stored pivots; where there are none yet, they are chosen from ``offered`` and stored."""
        place = f"{self.path}/pivots"
        if not exists(spark, f"{place}/_SUCCESS"):
            if offered is None:
                return {}
            chosen = A.choose_pivots(offered)
            rows = [(dims, k, [float(x) for x in v]) for dims, vs in chosen.items() for k, v in enumerate(vs)]
            if not rows:
                return {}
            made = spark.createDataFrame(rows, "dims int, number int, vector array<double>")
            made.coalesce(1).write.mode("overwrite").parquet(place)
        found: dict[int, list] = {}
        for r in spark.read.parquet(place).orderBy("dims", "number").collect():
            found.setdefault(r.dims, []).append(r.vector)
        return {dims: np.array(vs) for dims, vs in found.items()}

    def visits(self, asked: DataFrame, run: str, batch: int) -> tuple[DataFrame, list, list[int]]:
        """Which cells distinct unit vectors visit, all cells, and the places of the visited ones."""
        spark = asked.sparkSession
        cells = self.cells.read(spark, manifest=self.cells.base(spark, run, batch)).collect()
        seen = cut(A.visited(asked, self.pivots(spark), cells, self.accept))
        near = {(r.dims, r.cell) for r in seen.select("dims", "cell").distinct().collect()}
        return seen, cells, sorted(r.place for r in cells if (r.dims, r.cell) in near)

    def nearest(self, prompts: DataFrame) -> DataFrame:
        """As ``answers.nearest`` over the stored entries; only visited cells are read."""
        return self._search(prompts, "", -1)[0]

    def _search(self, prompts: DataFrame, run: str, batch: int) -> tuple[DataFrame, DataFrame]:
        """Matches, and the entries of the visited cells."""
        spark = prompts.sparkSession
        asked_rows = A.distinct_vectors(prompts)
        asked = cut(A.usable(asked_rows).withColumn("dims", F.size("unit")))
        seen, cells, places = self.visits(asked, run, batch)
        held = self.entries.read(spark, places, self.entries.base(spark, run, batch))
        compared = A.matches_in_cells(seen, held.select("id", "unit", "dims", "cell"), cells, self.accept, self.block)
        return A.best_of(prompts, asked_rows, compared), held

    def add(self, answered: DataFrame, run: str, batch: int) -> None:
        """Append answered prompts (id, embedding, response_text, model_used); of equal vectors the smallest id."""
        spark = answered.sparkSession
        one = answered.groupBy("embedding").agg(F.min_by(F.struct("id", "response_text", "model_used"), "id").alias("r"))
        one = one.select("embedding", "r.*")
        units = cut(A.usable(one.select("id", "embedding")).withColumn("dims", F.size("unit")))
        pivots = self.pivots(spark, units)
        placed = units.mapInPandas(A.placer(pivots), "id long, unit array<double>, dims int, cell int, angle double")
        rows = cut(
            placed.join(one, "id").select(
                (F.col("dims") * A.PIVOTS + F.col("cell")).cast("int").alias("place"),
                "dims",
                "cell",
                "id",
                F.col("embedding").cast("array<double>").alias("embedding"),
                "unit",
                "angle",
                "response_text",
                "model_used",
            )
        )
        self.entries.append(rows, run, batch)
        sizes = A.cell_sizes(rows).withColumn("place", (F.col("dims") * A.PIVOTS + F.col("cell")).cast("int"))
        self.cells.upsert(sizes.select("place", "dims", "cell", "radius", "n"), run, batch, _total)

    def answer(self, prompts: DataFrame, run: str, batch: int) -> DataFrame:
        """Answers of prompts (id, embedding, cheap, strong), written through: misses become entries.

        Prompts of one batch are compared with what was stored before it, not with each other.
        """
        prompts = cut(prompts)
        matches, held = self._search(prompts.select("id", "embedding"), run, batch)
        matches = cut(matches)
        answers = cut(A.answer(prompts, matches, held.select("id", "response_text", "model_used")))
        new = answers.where("not cache_hit").select(F.col("prompt_id").alias("id"), F.col("response").alias("response_text"), "model_used")
        self.add(prompts.select("id", "embedding").join(new, "id"), run, batch)
        return answers.join(matches.select("prompt_id", "cache_id"), "prompt_id", "left")


def answer_stream(prompts: DataFrame, cache: AnswerCache, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Answer a stream of (id, embedding, cheap, strong, timestamp); store answers, hits and new entries."""

    def work(batch: DataFrame, batch_id: int) -> None:
        answers = cut(cache.answer(batch.drop("timestamp"), checkpoint, batch_id))
        answers.write.mode("overwrite").parquet(f"{out}/answers/batch={batch_id}")
        hits = answers.where("cache_hit").join(batch.select(F.col("id").alias("prompt_id"), "timestamp"), "prompt_id")
        hits.select("cache_id", "prompt_id", F.col("timestamp").alias("hit_at")).write.mode("overwrite").parquet(f"{out}/hits/batch={batch_id}")

    writer = prompts.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def hit_counts(spark: SparkSession, out: str) -> DataFrame:
    """How often each entry was hit, and when last."""
    hits = spark.read.schema("cache_id long, prompt_id long, hit_at timestamp, batch int").parquet(f"{out}/hits")
    return hits.groupBy("cache_id").agg(F.count(F.lit(1)).alias("hit_count"), F.max("hit_at").alias("last_hit_at"))
