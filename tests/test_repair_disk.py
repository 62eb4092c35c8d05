"""What the repair job leaves on disk while a batch runs, and its results when they come in slices."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from streamwarden import contracts as C
from streamwarden.functions.backoff import Backoff
from streamwarden.operators.guard import GuardSettings
from streamwarden.sources import topics as S
from streamwarden.streaming import jobs
from tests.test_repair_job import NESTED, RULE

FIELDS = "customer_name delivery_address payment_method order_currency order_region contact_email".split()
SETTINGS = GuardSettings(2, Backoff(250.0, jitter=False))


def requests(spark, n):
    """Requests a hundred seconds apart: a third can be repaired, every ninth has no object as its record."""
    i = F.col("id")
    words = [F.substring(F.sha2(F.concat(F.lit(f), i), 256), 1, 8).alias(f) for f in FIELDS]
    left = F.when(i % 3 == 1, i.cast("string"))
    record = F.to_json(F.struct(F.concat(F.lit("s"), i).alias("sku"), left.alias("left"), *words))
    record = F.when(i % 9 == 5, F.concat(F.lit("["), record, F.lit("]"))).otherwise(record)
    head = F.format_string('{"event_type":"schema_mismatch","report_id":"r%d","contract_name":"stock","record":', F.col("id") % (n // 2))
    return spark.range(n).select(
        F.lit("requests").alias("topic"),
        F.lit(0).alias("partition"),
        i.alias("offset"),
        F.timestamp_seconds(i * 100).alias("timestamp"),
        F.concat(head, record, F.lit("}")).alias("value"),
    )


def contract(tmp_path):
    (tmp_path / "stock.yaml").write_text(NESTED)
    return C.by_topic(tmp_path)["stock-in"]


def rules(spark):
    ops = '[{"op": "cast_type", "field": "left", "target_type": "float"}]'
    unexpected = ",".join(sorted(FIELDS))
    return spark.createDataFrame([("stock", f"unexpected={unexpected}|types=left", ops, "unknown", "", 0.9, "m")], RULE)


def heal(spark, tmp_path, source, name, **options):
    out, at = str(tmp_path / name), F.lit("2024-01-01").cast("timestamp")
    stream = S.read_stream(spark, ["requests"], "parquet", path=source)
    query = jobs.heal_stream(stream, contract(tmp_path), rules, out, f"{out}/checkpoint", SETTINGS, as_of=at, **options)
    query.awaitTermination(240)
    assert query.exception() is None
    return out


def stored(spark, out):
    reports = spark.read.parquet(f"{out}/healing_reports").drop("ops_applied")
    messages = spark.read.option("basePath", f"{out}/messages").schema("value string, lineage string, batch int, topic string").json(f"{out}/messages")
    return [sorted(map(str, df.collect())) for df in (reports, messages, jobs.guard_table(out).read(spark))]


def size(folder) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def test_a_batch_takes_less_disk_than_its_requests(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    requests(spark, 6000).coalesce(4).write.parquet(source)
    text = requests(spark, 6000).agg(F.sum(F.length("value"))).first()[0]
    spark.range(1).checkpoint()
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    earlier, before, beside, write = set(Path(shared).iterdir()), size(shared), [], S.write_messages

    def watched(*args, **options):
        beside.append(size(shared) - before)
        write(*args, **options)

    monkeypatch.setattr(jobs, "write_messages", watched)
    out = heal(spark, tmp_path, source, "out")
    assert beside and max(beside) < 0.5 * text
    assert size(f"{out}/messages") < 0.5 * text
    assert not [p for p in set(Path(shared).iterdir()) - earlier if any(p.rglob("*.parquet"))]  # what the batch kept is gone


def test_slices_leave_what_one_slice_leaves(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    requests(spark, 400).repartition(3).write.parquet(source)
    modes, write = [], S.write_messages

    def noted(messages, sink, batch_id, mode="overwrite", **options):
        modes.append(mode)
        write(messages, sink, batch_id, mode, **options)

    monkeypatch.setattr(jobs, "write_messages", noted)
    whole = stored(spark, heal(spark, tmp_path, source, "whole"))
    assert modes == ["overwrite"]
    parts = stored(spark, heal(spark, tmp_path, source, "parts", slice_bytes=12_000))
    assert modes[1] == "overwrite" and len(modes) > 3 and set(modes[2:]) == {"append"}
    assert parts == whole and len(whole[1]) == 400
    reasons = {json.loads(m)["reason"].split(":")[0] for m in map(lambda r: r.lineage, spark.read.json(f"{tmp_path}/parts/messages").where("lineage is not null").collect())}
    assert {"healer_paused", "healed_and_revalidated", "low_confidence_or_no_ops"} <= reasons
