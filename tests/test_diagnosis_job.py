"""Diagnosis of forwarded incidents, and its outcomes at the gate."""

from pyspark.sql import functions as F

from streamwarden.operators import breaker as B
from streamwarden.streaming import diagnosis as D, gating as G

START = 1_700_000_000
REPORT = (
    "report_id string, timestamp timestamp, dataset_drift_detected boolean, drift_share double, reference_start string, "
    "reference_end string, current_start string, current_end string, column_results string"
)


def put(spark, folder, rows, schema):
    """Rows with their second in place of the timestamp."""
    df = spark.createDataFrame(rows, schema.replace("timestamp timestamp", "timestamp long"))
    df.withColumn("timestamp", F.timestamp_seconds(F.col("timestamp") + START)).coalesce(1).write.mode("append").parquet(folder)


def report(report_id, seconds):
    return (report_id, seconds, True, 0.5, "a", "b", "c", "d", "[]")


def test_late_report_is_joined_and_outcome_closes_the_breaker(spark, tmp_path):
    incidents, gate, asked, reports, out = (str(tmp_path / n) for n in ("incidents", "gate", "asked", "reports", "out"))
    incident = "monitor_name string, report_id string, timestamp timestamp"
    settings = B.BreakerSettings(3, B.Backoff(100.0, jitter=False))

    def run_gate(outcomes=None):
        query = G.gate_stream(
            spark.readStream.schema(incident).parquet(incidents),
            None if outcomes is None else spark.readStream.schema(f"{incident}, success boolean").parquet(outcomes),
            gate,
            str(tmp_path / ("g1" if outcomes is None else "g2")),
            settings,
        )
        query.awaitTermination(240)
        assert query.exception() is None

    # three incidents open the breaker, a fourth is the trial that asks for a diagnosis
    put(spark, incidents, [("m", f"r{i}", i) for i in range(3)] + [("m", "trial", 200)], incident)
    run_gate()
    assert G.stored_states(spark, gate).first().state == "HALF_OPEN"

    def run_diagnosis():
        query = D.diagnosis_stream(
            spark.readStream.schema(D.REQUESTS).parquet(asked),
            spark.readStream.schema(REPORT).parquet(reports),
            lambda s: s.createDataFrame([("trial", "low", 0.9), ("other", "high", 0.9)], "report_id string, severity string, confidence double"),
            gate,
            out,
            str(tmp_path / "d"),
        )
        query.awaitTermination(240)
        assert query.exception() is None

    put(spark, asked, [("m", "trial", "{}", 200), ("m", "other", None, 210)], D.REQUESTS)
    put(spark, reports, [report("unasked", 190)], REPORT)
    run_diagnosis()
    put(spark, reports, [report("trial", 700), report("other", 9000)], REPORT)  # in time, and much too late
    run_diagnosis()
    put(spark, asked, [("m", "last", "{}", 20_000)], D.REQUESTS)
    put(spark, reports, [report("last", 20_000)], REPORT)
    run_diagnosis()
    done = {r.report_id: r for r in spark.read.parquet(f"{out}/rca_reports").collect()}
    assert done["trial"].has_report and "share of drifted columns = 0.5" in done["trial"].context
    assert not done["other"].has_report and "none stored" in done["other"].context
    assert "newest transitions = incident_forwarded OPEN > HALF_OPEN" in done["trial"].context
    assert done["trial"].outcome_success and not done["other"].outcome_success

    run_gate_inputs = spark.read.parquet(f"{out}/outcomes").select("monitor_name", "report_id", "timestamp", "success")
    fed = str(tmp_path / "fed")
    run_gate_inputs.where("report_id = 'trial'").coalesce(1).write.parquet(fed)
    # the gate from the start, now with the outcome: the trial's success closes the breaker
    run_gate(fed)
    state = G.stored_states(spark, gate).first()
    assert (state.state, state.trip_count, state.consecutive_failures) == ("CLOSED", 0, 0)
