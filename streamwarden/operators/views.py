"""Reads over the logs and state tables the jobs keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from streamwarden.functions import json_values as J

# The card each topic is shown on.
CARDS = {
    "raw-data": "kafka",
    "validated-data": "sidecar",
    "dead-letter-queue": "schema",
    "drift-events": "drift",
    "anomaly-alerts": "isoforest",
    "schema-events": "catalog",
    "schema-evolution-requests": "schema",
    "remediation-requests": "breaker",
    "remediation-dlq": "breaker",
    "openlineage-events": "catalog",
    "catalog-updates": "catalog",
}
HEALED_MARK = "_schema_healer"


def last_per_topic(messages: DataFrame, limit: int) -> DataFrame:
    """The newest messages of each topic over all its partitions."""
    newest = Window.partitionBy("topic").orderBy(F.desc("timestamp"), F.desc("partition"), F.desc("offset"))
    return messages.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def topic_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic").agg(F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("last_event_at"))


def recent(log: DataFrame, order: list[str], limit: int, where: Column | None = None) -> DataFrame:
    """The newest rows of a log, for one monitor or contract when ``where`` says so."""
    chosen = log if where is None else log.where(where)
    return chosen.orderBy(*[F.desc(c) for c in order]).limit(limit)


def cards(messages: DataFrame) -> DataFrame:
    """Messages with their id and card; repaired records are shown where repairs are."""
    card = F.lit("kafka")
    for topic, name in CARDS.items():
        card = F.when(F.col("topic") == topic, F.lit(name)).otherwise(card)
    mark = J.member(J.parse_json(F.col("value")), HEALED_MARK)
    healed = (F.col("topic") == "validated-data") & mark.isNotNull()
    return messages.select(
        F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("id"),
        "topic",
        F.when(healed, F.lit("schema")).otherwise(card).alias("card"),
        "timestamp",
        "value",
    )


def score_statistics(scored: DataFrame, created: str) -> DataFrame:
    """Counts over scored rows and the latest prediction, in one pass."""
    latest = F.max_by(F.struct("order_total", "anomaly_score", "is_anomaly"), F.struct(created, "row_key"))
    return scored.where("is_anomaly is not null").agg(
        F.count(F.lit(1)).alias("processed_records"),
        F.count_if("is_anomaly").alias("anomaly_records"),
        F.max(created).alias("last_scored_at"),
        latest.alias("latest"),
    )


def catalog_listing(entries: DataFrame, limit: int = 100) -> DataFrame:
    return recent(entries, ["updated_at", "dataset_name"], limit)
