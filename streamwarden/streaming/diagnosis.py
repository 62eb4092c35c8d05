"""Diagnosis as a job: requests meet their drift report, even a later one, and their decision goes back to the gate.

A request waits for the report of its id in a stream-stream join that ends at a time bound, so
it goes on without one when none comes. Each micro-batch then looks up the newest transitions of
its monitors, decides by the policy, and stores the report and the outcome.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from streamwarden.functions import json_values as J
from streamwarden.operators import context as X
from streamwarden.session import cut
from streamwarden.streaming.gating import newest_transitions

REQUESTS = "monitor_name string, report_id string, incident string, timestamp timestamp"


def remediation_requests(messages: DataFrame) -> DataFrame:
    """(monitor_name, report_id, incident, timestamp) of forwarded incidents; nameless ones are passed over."""
    doc = J.parse_json(F.col("value"))
    named = messages.select(
        J.as_string(J.member(doc, "monitor_name")).alias("monitor_name"),
        J.as_string(J.member(doc, "report_id")).alias("report_id"),
        F.to_json(J.member(doc, "incident")).alias("incident"),
        "timestamp",
    )
    return named.where("length(monitor_name) > 0")


def awaited(requests: DataFrame, reports: DataFrame, wait: str = "15 minutes", lateness: str = "5 minutes") -> DataFrame:
    """Requests with ``drift_report``: the one of their id that came within ``wait`` of them, before or after.

    A request without one comes out when the watermark has passed its bound. ``reports`` has
    report_id, timestamp and the columns that ``context.summary`` shows.
    """
    left = requests.withWatermark("timestamp", lateness)
    right = reports.withWatermark("timestamp", lateness).select(
        F.col("report_id").alias("_id"),
        F.col("timestamp").alias("_told"),
        F.struct(*[c for c in reports.columns if c not in ("report_id", "timestamp")]).alias("drift_report"),
    )
    near = F.expr(f"_told >= timestamp - interval {wait} and _told <= timestamp + interval {wait}")
    return left.join(right, (F.col("report_id") == F.col("_id")) & near, "left").drop("_id", "_told")


def diagnosed(batch: DataFrame, transitions: DataFrame, results: DataFrame, policy: X.OutcomePolicy) -> DataFrame:
    """Context, result and decision of each request of a micro-batch.

    ``results`` (report_id, severity, confidence) are somebody's answers; a request without
    one is decided as doubtful.
    """
    history = X.recent_history(transitions)
    joined = batch.join(history, "monitor_name", "left").withColumn("context", X.summary())
    one = results.groupBy("report_id").agg(F.max_by(F.struct("severity", "confidence"), "confidence").alias("r"))
    known = joined.join(one, "report_id", "left").select(*joined.columns, "r.severity", "r.confidence")
    return X.decide(known)


def diagnosis_stream(
    requests: DataFrame,
    reports: DataFrame,
    results: Callable[[SparkSession], DataFrame],
    gate_out: str,
    out: str,
    checkpoint: str,
    policy: X.OutcomePolicy = X.OutcomePolicy(),
    wait: str = "15 minutes",
    lateness: str = "5 minutes",
    **trigger,
) -> StreamingQuery:
    """Diagnose requests and hand outcomes to the gate.

    ``gate_out`` is where the gate job stores its transitions. Reports go to
    ``out/rca_reports`` with a snapshot of the context, outcomes to ``out/outcomes`` as
    the gate reads them: (monitor_name, report_id, success, timestamp).
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked = cut(batch)
        done = cut(diagnosed(asked, newest_transitions(spark, gate_out, asked), results(spark), policy))
        done.select(
            "report_id",
            "monitor_name",
            "context",
            "severity",
            "confidence",
            "outcome_success",
            "outcome_reason",
            F.col("timestamp").alias("requested_at"),
            F.col("drift_report").isNotNull().alias("has_report"),
        ).write.mode("overwrite").parquet(f"{out}/rca_reports/batch={batch_id}")
        told = X.outcomes(done, F.col("timestamp"))
        told.select(
            F.col("key").alias("monitor_name"), F.col("tie").alias("report_id"), "success", F.col("at").alias("timestamp")
        ).write.mode("overwrite").parquet(f"{out}/outcomes/batch={batch_id}")

    writer = awaited(requests, reports, wait, lateness).writeStream.foreachBatch(work)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
