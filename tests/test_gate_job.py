"""Admission and gate as jobs, compared with the batch operators over restarts."""

import json
import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from streamwarden.operators import breaker as B
from streamwarden.sources import topics as S
from streamwarden.streaming import gating as G

START = 1_700_000_000


def report(i, monitor, report_id, arrived, age):
    body = {"monitor_name": monitor, "report_id": report_id, "number": i}
    if age is not None:
        body["detected_at"] = f"{datetime.fromtimestamp(START + arrived - age, UTC):%Y-%m-%dT%H:%M:%S}Z"
    return ("drift-events" if i % 2 else "anomaly-alerts", 0, i, arrived, json.dumps(body))


def frame(spark, rows):
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, seconds long, value string")
    return df.select("topic", "partition", "offset", F.timestamp_seconds(F.col("seconds") + START).alias("timestamp"), "value")


def test_labels_of_the_stream_equal_those_of_the_table(spark, tmp_path):
    """Late, stale, repeated, nameless and idless reports over three restarts: each has its label."""
    rng = random.Random(2)
    rows = []
    for i in range(240):
        monitor = "" if i % 17 == 0 else f"m{i % 5}"
        age = None if i % 13 == 0 else rng.choice([0, 30, 400, 899, 901, 5000])
        arrived = i * 20 - (2000 if i % 29 == 0 else 0)  # some arrive far behind the others
        rows.append(report(i, monitor, None if i % 11 == 0 else f"r{rng.randint(0, 40)}", max(arrived, 0), age))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        frame(spark, rows[part * 80 : part * 80 + 80]).coalesce(1).write.mode("append").json(source)
        messages = S.read_stream(spark, ["drift-events", "anomaly-alerts"], "json", path=source)
        labelled = G.labelled_reports(S.incidents(messages), remember_seconds=10**7, place=F.col("incident"))
        for name, value in G.STATE_STORE.items():
            spark.conf.set(name, value)
        writer = labelled.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        writer.trigger(availableNow=True).start().awaitTermination(180)
    got = spark.read.parquet(out)
    assert got.count() == len(rows)
    # within a micro-batch the earliest arrival is first; over batches the earlier batch is
    whole = frame(spark, rows)
    batch = F.floor(F.col("offset") / 80)
    table = S.incidents(whole).join(whole.select(F.col("value").alias("incident"), batch.alias("batch")).distinct(), "incident")
    wanted = B.admit(table, F.col("timestamp"), arrival=("batch", "timestamp", "incident"))
    key = lambda df: sorted((r.incident, r.timestamp, r.admission) for r in df.select("incident", "timestamp", "admission").collect())
    assert key(got) == key(wanted)
    assert {r.admission for r in got.collect()} == {"ok", "stale", "duplicate", "no_monitor"}


def test_forgotten_ids_are_new_again(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for arrived, name in ((0, "same"), (100, "same"), (10_000, "other"), (10_001, "same"), (10_002, "same")):
        frame(spark, [report(arrived, "m", name, arrived, 0)]).coalesce(1).write.mode("append").json(source)
        messages = S.read_stream(spark, ["drift-events", "anomaly-alerts"], "json", path=source)
        writer = G.labelled_reports(S.incidents(messages), lateness="1 second").writeStream.format("parquet")
        writer.option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    got = {r.timestamp.timestamp() - START: r.admission for r in spark.read.parquet(out).collect()}
    assert [got[k] for k in sorted(got)] == ["ok", "duplicate", "ok", "ok", "duplicate"]


def test_many_ids_share_few_keys_of_the_state(spark, tmp_path):
    """Ids of one bucket keep labels and memory of their own; as many yields as buckets, not ids."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):  # every id twice in the first batch, half of them and as many new ones in the second
        names = [f"r{i}" for i in range(part * 50, part * 50 + 100) for _ in range(2 - part)]
        frame(spark, [report(i, "m", name, i, 0) for i, name in enumerate(names)]).coalesce(1).write.mode("append").json(source)
        messages = S.read_stream(spark, ["drift-events", "anomaly-alerts"], "json", path=source)
        labelled = G.labelled_reports(S.incidents(messages), remember_seconds=10**7, buckets=2)
        writer = labelled.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        writer.trigger(availableNow=True).start().awaitTermination(180)
    got = spark.read.parquet(out)
    assert {r.admission: r["count"] for r in got.groupBy("admission").count().collect()} == {"ok": 150, "duplicate": 150}
    assert got.where("admission = 'ok'").select("report_id").distinct().count() == 150


def test_gate_job_equals_batch_replay_over_restarts(spark, tmp_path):
    """Incidents and outcomes from two inputs; states, log and messages as the batch makes them."""
    rng = random.Random(4)
    incidents, outcomes = [], []
    for i in range(150):
        row = (f"m{rng.randint(0, 3)}", f"{i:05d}", START + i * 40.0)
        if i % 5 == 4:
            outcomes.append((*row, rng.random() < 0.5))
        else:
            incidents.append(row)
    outcomes.append(("stranger", "99999", START + 1.0, True))
    ins, outs, out = str(tmp_path / "ins"), str(tmp_path / "outs"), str(tmp_path / "out")
    times = lambda df: df.withColumn("timestamp", F.timestamp_seconds("timestamp"))
    one = times(spark.createDataFrame(incidents, "monitor_name string, report_id string, timestamp double"))
    two = times(spark.createDataFrame(outcomes, "monitor_name string, report_id string, timestamp double, success boolean"))
    middle = F.timestamp_seconds(F.lit(START + 75 * 40.0 - 1))

    def run(checkpoint):
        query = G.gate_stream(
            spark.readStream.schema(one.schema).parquet(ins),
            spark.readStream.schema(two.schema).parquet(outs),
            out,
            str(tmp_path / checkpoint),
            buckets=4,
        )
        query.awaitTermination(240)
        assert query.exception() is None

    for when in (F.col("timestamp") < middle, F.col("timestamp") >= middle):
        one.where(when).coalesce(1).write.mode("append").parquet(ins)
        two.where(when).coalesce(1).write.mode("append").parquet(outs)
        run("c")
    events = G.gate_events(one, two)
    decided = B.notify_blocks(B.replay_breaker(events, partitions=3))
    log = spark.read.parquet(f"{out}/breaker_events")
    show = lambda df: sorted(map(str, df.select("monitor_name", "event_type", "from_state", "to_state", "reason", "related_report_id").collect()))
    assert show(log) == show(G.audit_rows(decided))
    assert log.where("event_type = 'rejected'").count() == 1
    states = lambda df: sorted(map(str, df.select("monitor_name", "state", "consecutive_failures", "trip_count", "opened_at", "cooldown_seconds").collect()))
    assert states(G.stored_states(spark, out, buckets=4)) == states(B.current_state(decided))
    messages = spark.read.option("basePath", f"{out}/messages").schema("value string, batch int, topic string").json(f"{out}/messages")
    assert sorted(r.value for r in messages.collect()) == sorted(r.value for r in B.announce(decided).collect())
    asked = spark.createDataFrame([("m1",), ("never",)], "monitor_name string")
    view = B.state_view(asked, G.stored_states(spark, out, asked, buckets=4), F.lit(START + 10**6).cast("timestamp"))
    assert {r.monitor_name: r.state for r in view.collect()}["never"] == "CLOSED"
    counts = {r.admission: r.incidents for r in G.gate_counters(spark.createDataFrame([("ok",)], "admission string"), decided).collect()}
    assert counts["ok"] == 1 and counts["suppressed"] == decided.where("not notify").count() > 0


def test_dry_run_publishes_nothing(spark, tmp_path):
    ins, out = str(tmp_path / "ins"), str(tmp_path / "out")
    one = spark.createDataFrame([("m", str(i), START + float(i)) for i in range(5)], "monitor_name string, report_id string, timestamp double")
    one = one.withColumn("timestamp", F.timestamp_seconds("timestamp"))
    one.write.parquet(ins)
    G.gate_stream(spark.readStream.schema(one.schema).parquet(ins), None, out, str(tmp_path / "c"), dry_run=True, sink="parquet").awaitTermination(180)
    assert spark.read.parquet(f"{out}/breaker_events").count() == 3  # two forwarded, the trip; later blocks are quiet
    assert spark.read.schema("value string").parquet(f"{out}/messages/batch=0").count() == 0
