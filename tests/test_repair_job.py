"""Contracts in the plural, and repair behind the guard as a job."""

import json

import pytest
from pyspark.sql import functions as F

from streamwarden import contracts as C
from streamwarden.functions import json_values as J
from streamwarden.functions.backoff import Backoff
from streamwarden.operators import heal as H
from streamwarden.operators.guard import GuardSettings, guard_state, replay_guard
from streamwarden.operators.route import audit, route
from streamwarden.sources import topics as S
from streamwarden.streaming import jobs

FLAT = """
contract_name: prices
source_topic: prices-in
sink_topic: prices-out
fields:
  - {name: sku, type: string, required: true}
  - {name: price_total, type: float, required: true}
  - {name: owner, type: string, required: false, pii: true, masking_strategy: redact}
quality_rules:
  - {rule: range_check, field: price_total, min: 0}
"""
NESTED = """
contract:
  name: stock
  kafka: {source_topic: stock-in, sink_topic: stock-out, dlq_topic: stock-lost}
schema:
  fields:
    - {name: sku, type: string, required: true}
    - {name: left, type: float, required: true}
"""
RULE = "contract_name string, signature string, ops_json string, root_cause_category string, narrative string, confidence double, model_used string"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.yaml").write_text(FLAT)
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "b.yaml").write_text(NESTED)
    (tmp_path / "empty.yaml").write_text("")
    return tmp_path


def frame(spark, rows):
    data = [(t, 0, i, None, v if isinstance(v, str) else json.dumps(v)) for i, (t, v) in enumerate(rows)]
    return spark.createDataFrame(data, S.MESSAGE).withColumn("timestamp", F.timestamp_seconds(F.col("offset") * 100))


def test_each_topic_is_judged_by_its_own_contract(spark, folder):
    known = C.by_topic(folder)
    assert set(known) == {"prices-in", "stock-in"} and set(C.by_name(folder)) == {"prices"}
    rows = [
        ("prices-in", {"sku": "a", "price_total": 3, "owner": "me"}),
        ("prices-in", {"sku": "a", "left": 3}),
        ("stock-in", {"sku": "a", "left": 3}),
        ("stock-in", {"sku": "a", "price_total": 3, "owner": "me"}),
        ("stock-in", "{bad"),
        ("other", {"sku": "a"}),
        ("prices-in", {"sku": "a", "price_total": -1}),
    ]
    routed = route(frame(spark, rows), known, as_of=F.lit("2024-01-01").cast("timestamp"))
    got = {r.source_offset: r for r in routed.collect()}
    assert [got[i].topic for i in range(7)] == [
        "prices-out", C.HEALER_TOPIC, "stock-out", "stock-lost", "stock-lost", C.DEAD_LETTER_TOPIC, C.HEALER_TOPIC,
    ]
    assert [got[i].violations for i in (1, 3, 4, 5, 6)] == [
        ["missing_required_field:price_total"],
        ["missing_required_field:left"],
        ["malformed_json"],
        ["contract_not_found:other"],
        ["range_check:price_total:below_min"],
    ]
    assert json.loads(got[0].value)["owner"] == "***" and json.loads(got[3].value)["contract_name"] == "stock"
    log = audit(routed, known)
    assert log.where("event_type = 'validation_pass'").count() == 2
    assert {json.loads(r.payload).get("routed_via") for r in log.collect()} == {None, "dead_letter_queue", "schema_evolution_requests"}
    # one contract for everything stays as it was
    alone = route(frame(spark, rows[:2]), known["prices-in"], as_of=F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r.topic for r in alone.collect()) == ["prices-out", C.HEALER_TOPIC]


def test_schemas_are_announced_once(spark, folder, tmp_path):
    known, out = C.by_topic(folder), str(tmp_path / "out")
    assert jobs.publish_schemas(spark, known, out, "run", 0).count() == 2
    assert jobs.publish_schemas(spark, known, out, "run", 1).count() == 0
    (folder / "a.yaml").write_text(FLAT.replace("price_total", "amount"))
    changed = C.by_topic(folder)
    for _ in range(2):  # the second time as after a failure
        assert [r.dataset_name for r in jobs.publish_schemas(spark, changed, out, "run", 2).collect()] == ["prices"]
    assert jobs.publish_schemas(spark, changed, out, "run", 3).count() == 0


def request(contract, record, report_id):
    return ("requests", {"event_type": "schema_mismatch", "report_id": report_id, "contract_name": contract, "record": record})


def test_repair_job_equals_batch_over_restarts(spark, folder, tmp_path):
    known = {c.name: c for c in C.by_topic(folder).values()}
    settings = GuardSettings(2, Backoff(250.0, jitter=False))
    rows = []
    for i in range(40):
        if i % 10 == 9:
            rows.append(request("nobody", {"sku": "x"}, f"r{i}"))
        elif i % 8 < 3:
            rows.append(request("prices", {"sku": "x"}, "same"))  # one report id again and again; cannot be repaired
        elif i % 2:
            rows.append(request("prices", {"sku": "x", "price_amount": "4.5", "owner": "me"}, f"r{i}"))
        else:
            rows.append(request("stock", {"sku": "x", "left": "7"}, f"r{i}"))
    rows.append(request("prices", [1], "odd"))
    rules = lambda s: s.createDataFrame(
        [("stock", "types=left", '[{"op": "cast_type", "field": "left", "target_type": "float"}]', "unknown", "", 0.9, "m")], RULE
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    whole = frame(spark, rows)
    at = F.lit("2024-01-01").cast("timestamp")
    for part in (F.col("offset") < 13, (F.col("offset") >= 13) & (F.col("offset") < 30), F.col("offset") >= 30):
        whole.where(part).coalesce(1).write.mode("append").json(source)
        stream = S.read_stream(spark, ["requests"], "json", path=source)
        query = jobs.heal_stream(stream, known, rules, out, str(tmp_path / "c"), settings, as_of=at)
        query.awaitTermination(240)
        assert query.exception() is None
    named = whole.select("value", *[F.col(c).alias(f"source_{c}") for c in ("topic", "partition", "offset", "timestamp")])
    healed = H.heal(H.mismatch_requests(named), known, rules(spark), as_of=at)
    timed = healed.withColumn("at", F.unix_micros("source_timestamp") / F.lit(1e6))
    expected, states = H.guarded(timed, "at", settings)
    show = lambda df: sorted(map(str, df.select("report_id", "contract_name", "success", "reason").collect()))
    reports = spark.read.parquet(f"{out}/healing_reports")
    assert show(reports) == show(expected) and reports.count() == 40
    reasons = {r.reason.split(":")[0] for r in reports.collect()}
    assert {"contract_not_found", "healer_paused", "healed_and_revalidated", "healed_and_revalidated_with_deterministic_rename"} <= reasons
    assert reports.where("report_id = 'same'").count() == sum(1 for _, v in rows if v["report_id"] == "same")
    held = {r.contract_name: (r.failures, r.trip_count) for r in jobs.guard_table(out).read(spark).collect()}
    assert held == {r.contract_name: (r.failures, r.trip_count) for r in states.collect()} and "nobody" not in held
    messages = spark.read.option("basePath", f"{out}/messages").schema("value string, lineage string, batch int, topic string").json(f"{out}/messages")
    assert messages.count() == len(rows)
    sent = [json.loads(r.value) for r in messages.where("topic = 'validated-data'").collect()]
    assert any(m.get("left") == 7 for m in sent) and all(m.get("owner", "***") == "***" for m in sent)


def test_six_requests_of_one_report_stay_six(spark):
    known = C.from_document({"contract_name": "c", "fields": [{"name": "a", "type": "string", "required": True}]})
    asked = spark.createDataFrame([("one", "c", i) for i in range(6)], "report_id string, contract_name string, n int")
    asked = asked.withColumn("record", J.members(J.parse_json(F.lit('{"b": "x"}'))))
    outcomes = H.heal(asked, known, spark.createDataFrame([], RULE), as_of=F.lit("2024-01-01").cast("timestamp"))
    paused = H.with_guard(outcomes, "n", GuardSettings(3, Backoff(100.0, jitter=False)))
    assert sorted((r.n, r.reason.split(":")[0]) for r in paused.collect()) == [
        (i, "low_confidence_or_no_ops" if i < 3 else "healer_paused") for i in range(6)
    ]
    attempts = outcomes.selectExpr("contract_name key", "double(n) at", "report_id tie", "'attempt' kind", "success")
    assert guard_state(replay_guard(attempts)).count() == 1
