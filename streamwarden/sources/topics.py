"""Topic sources and sinks: Kafka on a cluster, files of the same shape elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MESSAGE = "topic string, partition int, offset long, timestamp timestamp, value string"

# Field names that carry monitor and report id, per incident topic.
INCIDENT_FIELDS = {
    "drift-events": ("monitor_name", "report_id"),
    "anomaly-alerts": ("monitor_name", "report_id"),
}


def read_stream(spark: SparkSession, topics: list[str], source: str = "kafka", earliest: bool = True, **options) -> DataFrame:
    """Messages of one or more topics. Values stay text: bad JSON is data, not a failure.

    ``source="kafka"`` needs the Kafka connector on the classpath and takes its
    connection options as they are. Any file format reads ``path``.
    """
    if source == "kafka":
        raw = (
            spark.readStream.format("kafka")
            .option("subscribe", ",".join(topics))
            .option("startingOffsets", "earliest" if earliest else "latest")
            .options(**options)
            .load()
        )
        return raw.select("topic", "partition", "offset", "timestamp", F.col("value").cast("string").alias("value"))
    files = spark.readStream.format(source).schema(MESSAGE).options(**options).load()
    return files.where(F.col("topic").isin(*topics))


def write_messages(messages: DataFrame, sink: str, batch_id: int, mode: str = "overwrite", **options) -> None:
    """Write (topic, value) rows. File sinks overwrite the batch's own folder, so a replay adds nothing;
    a batch that is written in parts adds the others to the first (``mode``)."""
    columns = options.pop("columns", ("topic", "value"))
    if sink == "kafka":
        messages.select("topic", "value").write.format("kafka").options(**options).save()
        return
    path = f"{options.pop('path').rstrip('/')}/batch={batch_id}"
    messages.select(*columns).write.mode(mode).partitionBy("topic").format(sink).options(**options).save(path)


def incidents(messages: DataFrame, fields: dict[str, tuple[str, str]] = INCIDENT_FIELDS) -> DataFrame:
    """(monitor_name, report_id, detected_at, trigger_topic, incident) of incident messages.

    ``fields`` says for each topic which members hold the monitor and the report id.
    """
    from streamwarden.functions import json_values as J
    from streamwarden.functions.times import parse_iso

    document = J.parse_json(F.col("value"))
    monitor = report = F.lit(None).cast("string")
    for topic, (monitor_field, report_field) in fields.items():
        here = F.col("topic") == topic
        monitor = F.when(here, J.as_string(J.member(document, monitor_field))).otherwise(monitor)
        report = F.when(here, J.as_string(J.member(document, report_field))).otherwise(report)
    return messages.select(
        monitor.alias("monitor_name"),
        report.alias("report_id"),
        parse_iso(J.as_string(J.member(document, "detected_at"))).alias("detected_at"),
        F.col("topic").alias("trigger_topic"),
        F.col("value").alias("incident"),
        "timestamp",
    )


def outcome_reports(messages: DataFrame) -> DataFrame:
    """(monitor_name, report_id, success, timestamp) of remediation outcomes."""
    from streamwarden.functions import json_values as J

    document = J.parse_json(F.col("value"))
    success = J.member(document, "success")
    return messages.select(
        J.as_string(J.member(document, "monitor_name")).alias("monitor_name"),
        J.as_string(J.member(document, "report_id")).alias("report_id"),
        F.when(J.json_type(success) == "BOOLEAN", F.try_variant_get(success, "$", "boolean")).alias("success"),
        "timestamp",
    ).where("success is not null and length(monitor_name) > 0")
