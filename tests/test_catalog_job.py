"""The catalog as a job over two topics, and lineage of wide events."""

import json

from pyspark.sql import functions as F

from streamwarden.operators import catalog as K
from streamwarden.streaming import catalog as S

MESSAGES = "topic string, value string, timestamp timestamp"


def schema(name, *columns):
    return (K.SCHEMA_TOPIC, json.dumps({"dataset_name": name, "schema": {c: "string" for c in columns}}))


def lineage(inputs, outputs, kind="COMPLETE"):
    named = lambda names: [{"name": n} for n in names]
    return (K.LINEAGE_TOPIC, json.dumps({"eventType": kind, "inputs": named(inputs), "outputs": named(outputs)}))


def frame(spark, rows):
    data = [(topic, value, k) for k, (topic, value) in enumerate(rows)]
    df = spark.createDataFrame(data, "topic string, value string, seconds long")
    return df.select("topic", "value", F.timestamp_seconds(F.col("seconds") + 1_700_000_000).alias("timestamp"))


def test_job_over_restarts_equals_one_batch(spark, tmp_path):
    rows = []
    for i in range(60):
        rows.append(schema(f"d{i % 7}", "a", f"c{i % 3}"))
        if i % 4 == 0:
            rows.append(lineage([f"d{i % 5}", " d1 "], [f"d{i % 3 + 4}", "unknown"], "START" if i % 8 == 4 else "COMPLETE"))
        if i % 9 == 0:
            rows += [(K.SCHEMA_TOPIC, "{bad"), (K.SCHEMA_TOPIC, "[1]"), (K.LINEAGE_TOPIC, '{"eventType": "COMPLETE"}')]
    whole = frame(spark, rows)
    answers = [
        ("d1", "first line\ntags: x, y"),
        ("d2", f"{K.PENDING_PREFIX} soon)"),
    ]
    told = spark.createDataFrame(answers, "dataset_name string, answer string")
    prints = K.classify(whole).where("branch = 'schema'").select("dataset_name", K.fingerprint_of(F.col("schema")).alias("schema_fingerprint"))
    told = told.join(prints.distinct(), "dataset_name").select("dataset_name", "schema_fingerprint", "answer")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        whole.where(F.unix_seconds("timestamp") % 3 == part).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(MESSAGES).json(source)
        query = S.catalog_stream(stream, out, str(tmp_path / "c"), answers=(lambda s: told) if part < 2 else None, buckets=4)
        query.awaitTermination(240)
        assert query.exception() is None
    # the same three batches by the batch operators
    held = spark.createDataFrame([], S.ENTRIES)
    near = spark.createDataFrame([], S.NEIGHBOURS)
    for part in range(3):
        c = K.classify(whole.where(F.unix_seconds("timestamp") % 3 == part))
        new = S.entry_rows(c.where("branch = 'schema'"), told if part < 2 else None)
        held = K.upsert(new, held)
        near = near.unionByName(K.neighbours(K.incidence(c.where("branch = 'lineage'")))).distinct()
    wanted = K.with_lineage(held, near)
    columns = ["dataset_name", "schema_fingerprint", "schema_json", "description", "tags", "updated_at", "lineage_upstream", "lineage_downstream"]
    show = lambda df: sorted(map(str, df.select(*columns).collect()))
    got = S.stored_catalog(spark, out, buckets=4)
    assert show(got) == show(wanted)
    found = {r.dataset_name: r for r in got.collect()}
    assert found["d1"].description == "first line" and found["d1"].tags == ["x", "y"]
    assert found["d2"].description is None  # the placeholder was blanked by the batch without answers
    assert "d1" in found["d4"].lineage_upstream and "unknown" not in found
    assert S.dead_letter_count(spark, out).first().dead_letters == K.classify(whole).where("branch = 'dead_letter'").count()


def test_wide_event_is_not_exploded_twice(spark):
    inputs, outputs = [f"in{i:04d}" for i in range(2000)], [f"out{i:04d}" for i in range(2000)]
    events = K.classify(frame(spark, [lineage(inputs, outputs)] * 3 + [lineage(["in0000"], ["out0000", "in0001"])]))
    nodes = K.incidence(events.where("branch = 'lineage'"))
    assert nodes.count() == 4000 + 3  # equal events are one; a row for each dataset an event names
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 2  # one for each side of the union, none on top of another
    sets = {r.dataset_name: r for r in K.lineage_sets(K.neighbours(nodes)).collect()}
    assert len(sets) == 4000
    assert list(sets["out0000"].lineage_upstream) == inputs and list(sets["in0000"].lineage_downstream) == ["in0001", *outputs]
    assert list(sets["in0001"].lineage_upstream) == ["in0000"]
