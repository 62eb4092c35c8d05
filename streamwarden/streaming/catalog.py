"""The catalog as a job over two topics: entries and lineage merged into keyed tables.

A micro-batch merges its schema events into the entries and its lineage into the neighbours, and
writes rejects to a folder of its own. Only the buckets of datasets it names are read and
written; a batch that runs again builds on the same earlier version.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from streamwarden.operators import catalog as K
from streamwarden.sources.keyed_table import KeyedTable, add_rows

ENTRIES = (
    "dataset_name string, schema_fingerprint string, schema_json string, description string, "
    "tags array<string>, updated_at timestamp"
)
NEIGHBOURS = "dataset_name string, up string, down string"


def entry_table(out: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(f"{out}/catalog", tuple(K.ENTRY_KEY), ENTRIES, buckets)


def neighbour_table(out: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(f"{out}/lineage", ("dataset_name",), NEIGHBOURS, buckets)


def entry_rows(schema_events: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Entries of classified schema events, one per dataset and fingerprint.

    ``answers`` (dataset_name, schema_fingerprint, answer) describe some of them; the others
    have no description yet.
    """
    rows = schema_events.select(
        "dataset_name",
        K.fingerprint_of(F.col("schema")).alias("schema_fingerprint"),
        F.to_json("schema").alias("schema_json"),
        F.col("timestamp").alias("updated_at"),
    )
    if answers is None:
        return K.latest_entries(
            rows.withColumn("description", F.lit(None).cast("string")).withColumn("tags", F.lit(None).cast("array<string>")),
            "updated_at",
        )
    description, tags = K.parse_answer(F.col("answer"))
    one = answers.groupBy(*K.ENTRY_KEY).agg(F.min("answer").alias("answer"))
    joined = rows.join(one, K.ENTRY_KEY, "left")
    return K.latest_entries(joined.withColumn("description", description).withColumn("tags", tags), "updated_at")


def _merged(held: DataFrame, new: DataFrame) -> DataFrame:
    return K.upsert(new, held).select(*held.columns)


def catalog_stream(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    answers: Callable[[SparkSession], DataFrame] | None = None,
    buckets: int = 64,
    **trigger,
) -> StreamingQuery:
    """Keep the catalog of schema and lineage topics; ``messages`` has topic, value, timestamp.

    ``answers`` is asked for descriptions at each micro-batch.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sorted_out = K.classify(batch).persist()
        try:
            lost = sorted_out.where(F.col("branch") == "dead_letter")
            lost.select("topic", F.col("value").alias("event"), "reason", F.col("timestamp").alias("failed_at")).write.mode(
                "overwrite"
            ).parquet(f"{out}/catalog_dead_letters/batch={batch_id}")
            entries = entry_rows(sorted_out.where(F.col("branch") == "schema"), answers(spark) if answers else None)
            entry_table(out, buckets).upsert(entries.persist(), checkpoint, batch_id, _merged)
            near = K.neighbours(K.incidence(sorted_out.where(F.col("branch") == "lineage"))).persist()
            neighbour_table(out, buckets).upsert(near, checkpoint, batch_id, add_rows)
            entries.unpersist()
            near.unpersist()
        finally:
            sorted_out.unpersist()

    writer = messages.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stored_catalog(spark: SparkSession, out: str, buckets: int = 64) -> DataFrame:
    """Entries with the lineage of known datasets, as the job left them."""
    entries = entry_table(out, buckets).read(spark)
    return K.with_lineage(entries, neighbour_table(out, buckets).read(spark))


def dead_letter_count(spark: SparkSession, out: str) -> DataFrame:
    lost = spark.read.schema("topic string, event string, reason string, failed_at timestamp, batch int").parquet(
        f"{out}/catalog_dead_letters"
    )
    return lost.agg(F.count(F.lit(1)).alias("dead_letters"))
