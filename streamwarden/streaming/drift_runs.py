"""A drift check as a scheduled run: report stored, gate consulted, event published.

Everything a run writes is named by its report id, which follows from monitor and time, so a run
that is repeated leaves the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamwarden.operators import drift as D, gate as G
from streamwarden.session import cut
from streamwarden.sources.tables import exists
from streamwarden.sources.topics import write_messages

REPORTS = (
    "report_id string, monitor_name string, run_timestamp timestamp, reference_start timestamp, reference_end timestamp, "
    "current_start timestamp, current_end timestamp, dataset_drift_detected boolean, drift_share double, "
    "column_results array<struct<column:string,kind:string,method:string,score:double,drifted:boolean>>, forced boolean"
)


def stored_reports(spark: SparkSession, out: str) -> DataFrame:
    place = f"{out}/drift_reports"
    if not exists(spark, place):
        return spark.createDataFrame([], REPORTS)
    return spark.read.schema(REPORTS).option("recursiveFileLookup", "true").parquet(place)


def gate_decisions(reports: DataFrame, settings: G.GateSettings = G.GateSettings()) -> DataFrame:
    """What the publish gate makes of the stored reports of each monitor, in order of time."""
    checks = reports.select(
        F.col("monitor_name").alias("key"),
        (F.unix_micros("run_timestamp") / F.lit(1e6)).alias("at"),
        F.col("report_id").alias("tie"),
        F.lit(G.CHECK).alias("kind"),
        F.col("dataset_drift_detected").alias("drifted"),
        "forced",
    )
    return G.replay_gate(checks, settings)


def run_check(
    df: DataFrame,
    settings: D.DriftSettings,
    as_of: datetime,
    out: str,
    force: bool = False,
    gate: G.GateSettings = G.GateSettings(),
    sink: str = "json",
) -> DataFrame:
    """Check, store the report, and publish an event if the gate lets it through.

    A window that is too small raises and stores nothing: it is never "no drift". ``force``
    passes the gate's pauses, but publishes only where there is drift.
    """
    spark = df.sparkSession
    report = cut(D.drift_check(df, settings, as_of).withColumn("forced", F.lit(force)))
    name = report.first().report_id
    report.write.mode("overwrite").parquet(f"{out}/drift_reports/{settings.monitor_name}/{name}")
    own = stored_reports(spark, out).where(F.col("monitor_name") == settings.monitor_name)
    decided = gate_decisions(own, gate).where(F.col("tie") == name)
    told = D.drift_events(report, decided)
    write_messages(told, sink, name, path=f"{out}/messages")
    return report
