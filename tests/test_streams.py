"""Streaming jobs on files, compared with the batch operators."""

import json

from pyspark.sql import functions as F

from streamwarden.contracts import orders_contract
from streamwarden.operators import breaker as B, forest as I
from streamwarden.operators.route import route
from streamwarden.sources import topics as S
from streamwarden.streaming import jobs
from streamwarden.streaming.keyed import keyed_stream



def messages(spark, n, start=0):
    rows = []
    for i in range(start, start + n):
        record = {"order_id": f"o{i % 150}", "order_total": 20.0 + i % 9, "payment_method": "card", "customer_id": f"c{i}"}
        if i % 5 == 0:
            record["order_amt"] = str(record.pop("order_total"))
        rows.append(("raw-data", i % 3, i, None, json.dumps(record) if i % 11 else "{bad"))
    return spark.createDataFrame(rows, S.MESSAGE).withColumn("timestamp", F.timestamp_seconds(F.col("offset") + 1_700_000_000))


def test_routing_stream_equals_batch_and_survives_replay(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = F.lit("2024-01-01").cast("timestamp")
    first, second = messages(spark, 200), messages(spark, 100, 200)
    first.coalesce(1).write.mode("append").json(source)

    def run(checkpoint):
        stream = S.read_stream(spark, ["raw-data"], "json", path=source)
        jobs.route_stream(stream, orders_contract(), out, str(tmp_path / checkpoint), as_of=at).awaitTermination(120)

    run("c1")
    second.coalesce(1).write.mode("append").json(source)
    run("c1")
    expected = route(first.unionByName(second), orders_contract(), as_of=at)
    key = lambda df: sorted((r.topic, r.value) for r in df.select("topic", "value").collect())
    written = spark.read.option("basePath", f"{out}/messages").schema("value string, batch int, topic string").json(f"{out}/messages")
    assert key(written) == key(expected)
    orders = jobs.orders_table(out).read(spark)
    ids = [r.order_id for r in orders.select("order_id").collect()]
    assert len(ids) == len(set(ids)) > 50
    count = orders.count()
    run("c2")  # everything again, as after a lost checkpoint: both inputs arrive in batch 0
    assert spark.read.parquet(f"{out}/pipeline_events").where("batch = 0").count() == 300
    assert jobs.orders_table(out).read(spark).count() == count


def test_breaker_stream_equals_batch_replay(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"m{i % 3}", float(i * 40), i, "incident" if i % 4 else "outcome", i % 8 == 0) for i in range(120)]
    schema = "key string, at double, tie long, kind string, success boolean"
    spark.createDataFrame(rows[:60], schema).coalesce(1).write.json(source)
    machine = B.breaker_machine()

    def run():
        stream = spark.readStream.schema(schema).json(source)
        writer = keyed_stream(stream, machine).writeStream.format("parquet").option("path", out)
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    run()
    spark.createDataFrame(rows[60:], schema).coalesce(1).write.mode("append").json(source)
    run()
    columns = ["tie", "entry", "from_state", "to_state", "trip_count", "cooldown_seconds"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(columns).collect())
    batch = B.replay_breaker(spark.createDataFrame(rows, schema), partitions=4)
    assert got == sorted(tuple(r) for r in batch.select(columns).collect())


def test_scoring_stream_trains_then_scores(spark, tmp_path):
    source, out, models = (str(tmp_path / n) for n in ("in", "out", "models"))

    def feed(start, n, total):
        rows = [("validated-data", 0, i, None, json.dumps({"order_id": f"o{i}", "order_total": total + i % 7, "item_count": i % 5})) for i in range(start, start + n)]
        df = spark.createDataFrame(rows, S.MESSAGE).withColumn("timestamp", F.timestamp_seconds("offset"))
        df.coalesce(1).write.mode("append").json(source)
        stream = S.read_stream(spark, ["validated-data"], "json", path=source)
        jobs.score_stream(stream, models, out, str(tmp_path / "c")).awaitTermination(120)

    feed(0, 80, 50.0)
    feed(100, 3, 90000.0)
    rows = spark.read.parquet(f"{out}/order_features")
    assert rows.where("is_anomaly is null").count() == 80
    assert rows.where("is_anomaly").count() == 3
    alerts = spark.read.json(f"{out}/messages/batch=1")
    assert alerts.count() == 3
    # the first batch once more, as after a failure: its own model stays unseen
    stream = S.read_stream(spark, ["validated-data"], "json", path=source)
    jobs.score_stream(stream, models, out, str(tmp_path / "c2")).awaitTermination(120)
    again = spark.read.parquet(f"{out}/order_features/batch=0")
    assert again.count() == 83 and again.where("is_anomaly is not null").count() == 0


def test_warm_start_takes_registry_then_features_then_orders(spark, tmp_path):
    """Each step is taken only where the one before it has nothing; each leaves its audit row."""
    source, models = str(tmp_path / "in"), str(tmp_path / "models")
    rows = [("validated-data", 0, i, None, json.dumps({"order_id": f"o{i}", "order_total": 50.0 + i % 7})) for i in range(5)]
    rows.append(("validated-data", 0, 9, None, json.dumps({"order_id": "odd", "order_total": 1e6, "item_count": 400})))
    spark.createDataFrame(rows, S.MESSAGE).withColumn("timestamp", F.timestamp_seconds("offset")).coalesce(1).write.json(source)
    columns = ", ".join(f"{n} {t}" for n, t in jobs.VALIDATED_ORDER_COLUMNS.items())
    held = [{"order_id": f"h{i}", "order_total": 40.0 + i % 11, "item_count": i % 4, "unit_price": 5.0} for i in range(60)]
    known = spark.createDataFrame(held, columns).withColumn("ingested_at", F.timestamp_seconds(F.lit(1_700_000_000)))

    def run(out, models, orders):
        stream = S.read_stream(spark, ["validated-data"], "json", path=source)
        jobs.score_stream(stream, models, out, f"{out}/c", orders).awaitTermination(240)
        log = spark.read.parquet(f"{out}/pipeline_events").collect()
        return {r.event_type: json.loads(r.payload) for r in log}, spark.read.parquet(f"{out}/order_features")

    # nothing but validated orders
    log, features = run(str(tmp_path / "a"), models, lambda s: known)
    assert log["model_retrain"] == {"n_samples": 60, "source": "validated_orders"}
    assert "anomaly" in log and features.where("order_id = 'odd' and is_anomaly").count() == 1
    assert features.where("anomaly_score is null").isEmpty()
    # a registry that has a model: nothing is trained
    nodes = I.fit(jobs.order_features(known), "row_key")
    I.save(nodes, str(tmp_path / "registry"), -1, 60, "given")
    log, features = run(str(tmp_path / "b"), str(tmp_path / "registry"), lambda s: known.limit(0))
    assert set(log) == {"anomaly"} and features.where("anomaly_score is null").isEmpty()
    # features stored earlier come before validated orders
    out = str(tmp_path / "d")
    early = jobs.order_features(known).withColumn("order_id", F.lit("x")).withColumn("order_total", F.col("features")[0])
    early = early.withColumn("anomaly_score", F.lit(None).cast("double")).withColumn("is_anomaly", F.lit(None).cast("boolean"))
    early.write.parquet(f"{out}/order_features/batch=-1")
    log, _ = run(out, str(tmp_path / "m2"), lambda s: known.limit(55))
    assert log["model_retrain"] == {"n_samples": 60, "source": "order_features"}
    # neither: the rows wait, and no model is made of six
    log, features = run(str(tmp_path / "e"), str(tmp_path / "m3"), None)
    assert log == {} and features.where("anomaly_score is null").count() == 6


def test_saving_a_model_version_again_replaces_it(spark, tmp_path):
    rows = [(float(i), [float(i % 9), 1.0, 2.0, 3.0, 4.0, float(i % 5)]) for i in range(60)]
    nodes = I.fit(spark.createDataFrame(rows, "at double, features array<double>"), "at")
    for _ in range(2):
        I.save(nodes, str(tmp_path / "m"), 1, 60, "now")
    I.save(nodes, str(tmp_path / "m"), 3, 60, "later")
    assert I.newest(spark, str(tmp_path / "m")) is not None
    assert I.newest(spark, str(tmp_path / "m"), before=1) is None
    assert I.newest(spark, str(tmp_path / "none")) is None
