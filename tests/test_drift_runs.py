"""Scheduled drift checks: what is stored and what is published."""

import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamwarden.operators import drift as D, gate as G
from streamwarden.streaming import drift_runs as R
from streamwarden.streaming.drift_summaries import Summaries

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
CONFIG = {
    "monitor_name": "orders",
    "source": {"timestamp_column": "ts"},
    "columns": {"numerical": ["amount"], "categorical": ["kind"]},
    "reference_window": {"strategy": "rolling", "lookback_days": 14, "offset_days": 7},
    "current_window": {"lookback_hours": 24},
    "drift_detection": {"dataset_drift_share_threshold": 0.5, "min_reference_rows": 200, "min_current_rows": 30},
}


def rows(spark):
    """Steady for forty days; from day 38 on amounts are shifted."""
    rng = np.random.default_rng(5)
    start = NOW - timedelta(days=40)
    data = [
        (start + timedelta(hours=h, minutes=m), float(rng.normal(100 if h < 38 * 24 else 160, 10)), "ab"[int(rng.integers(0, 2))])
        for h in range(43 * 24)
        for m in (0, 20, 40)
    ]
    return spark.createDataFrame(data, "ts timestamp, amount double, kind string")


def test_runs_store_reports_and_publish_by_the_gate(spark, tmp_path):
    df, settings, out = rows(spark), D.settings_from(CONFIG), str(tmp_path)
    gate = G.GateSettings(renotify_seconds=2 * 3600, min_interval_seconds=600)
    times = [NOW - timedelta(days=5), NOW, NOW + timedelta(minutes=5), NOW + timedelta(minutes=30), NOW + timedelta(hours=3)]
    for at in times:
        R.run_check(df, settings, at, out, gate=gate)
    R.run_check(df, settings, NOW, out, gate=gate)  # repeated: the same report and the same message
    reports = R.stored_reports(spark, out)
    found = {r.run_timestamp.replace(tzinfo=timezone.utc): r for r in reports.collect()}
    assert reports.count() == len(times) and [found[t].dataset_drift_detected for t in times] == [False, True, True, True, True]
    assert [c["column"] for c in found[NOW].column_results if c["drifted"]] == ["amount"]
    messages = [json.loads(r.value) for r in spark.read.schema("value string").option("recursiveFileLookup", "true").json(f"{out}/messages").collect()]
    assert sorted(m["report_id"] for m in messages) == sorted(found[t].report_id for t in (times[1], times[4]))
    assert {m["publish_reason"].split(":")[0] for m in messages} == {"new episode", "episode goes on"}
    R.run_check(df, settings, NOW + timedelta(hours=3, minutes=1), out, force=True, gate=gate)
    assert spark.read.schema("value string").option("recursiveFileLookup", "true").json(f"{out}/messages").count() == 3


def test_small_windows_store_nothing(spark, tmp_path):
    df, out = rows(spark).where(F.col("ts") > F.lit(NOW - timedelta(days=3))), str(tmp_path)
    with pytest.raises(D.WindowTooSmall):
        R.run_check(df, D.settings_from(CONFIG), NOW, out)
    assert R.stored_reports(spark, out).isEmpty()


def test_fixed_reference_is_read_from_the_configuration():
    fixed = {"strategy": "fixed", "fixed_start": datetime(2024, 1, 1), "fixed_end": datetime(2024, 1, 9)}
    bounds = D.settings_from({**CONFIG, "reference_window": fixed}).bounds(NOW)
    assert (bounds.reference_start, bounds.reference_end) == (datetime(2024, 1, 1), datetime(2024, 1, 9))
    with pytest.raises(ValueError):
        D.settings_from({**CONFIG, "reference_window": {"strategy": "fixed"}})


def test_summaries_give_the_report_of_the_rows(spark, tmp_path):
    """Counted in three batches, one of them twice and with late rows; windows roll over them."""
    df = rows(spark).withColumn("amount", F.round("amount", 1)).withColumn("kind", F.when(F.col("amount") < 95, F.lit(None)).otherwise(F.col("kind")))
    stored = Summaries(str(tmp_path / "s"), D.settings_from(CONFIG), buckets=16)
    part = F.pmod(F.xxhash64("ts"), F.lit(3))
    for batch in (0, 1, 1, 2):
        stored.add(df.where(part == batch), "run", batch)
    for at in (NOW - timedelta(days=5), NOW, NOW + timedelta(hours=3)):
        got, wanted = stored.check(spark, at).first(), D.drift_check(df, D.settings_from(CONFIG), at).first()
        assert got == wanted
    with pytest.raises(ValueError):
        stored.check(spark, NOW + timedelta(minutes=1))
    with pytest.raises(D.WindowTooSmall):
        stored.check(spark, NOW + timedelta(days=300))
    one = spark.range(1).select((F.lit(int(NOW.timestamp())) / 3600).cast("long").alias("period"))
    assert len(stored.table.touched(one)) == 1
