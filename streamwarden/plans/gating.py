"""Registered queries: admission, circuit breaker, throttle, publish gate, repair guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamwarden.functions.backoff import Backoff
from streamwarden.functions.times import parse_iso
from streamwarden.operators import breaker as B, gate as G, guard as U
from streamwarden.operators.replay import event_time
from streamwarden.sources.tables import events

DAY = 86400.0
BREAKER = B.BreakerSettings(3, Backoff(DAY, 2.0, 6 * DAY, jitter=False))
GATE = G.GateSettings(renotify_seconds=5 * DAY, min_interval_seconds=DAY)
GUARD = U.GuardSettings(3, Backoff(3600.0, 2.0, 12 * 3600.0, jitter=False))
NOTICE_SECONDS = 2 * DAY


def _incidents_and_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Errors and views are incidents of the user's monitor, all others report an outcome."""
    ev = events(spark, folder)
    return ev.select(
        F.col("user_id").alias("key"),
        event_time(F.col("ts")).alias("at"),
        F.col("event_id").alias("tie"),
        F.when(F.col("event_type").isin("error", "view"), B.INCIDENT).otherwise(B.OUTCOME).alias("kind"),
        (F.col("value") >= 10).alias("success"),
    )


def _decisions(spark, folder):
    return B.replay_breaker(_incidents_and_outcomes(spark, folder), BREAKER)


def breaker_replay(spark: SparkSession, folder: str) -> DataFrame:
    d = _decisions(spark, folder)
    return d.select(
        F.col("tie").alias("event_id"),
        F.col("key").alias("monitor"),
        "entry",
        "from_state",
        "to_state",
        "consecutive_failures",
        "trip_count",
        F.col("cooldown_seconds").cast("long").alias("cooldown_seconds"),
    )


def throttle_replay(spark: SparkSession, folder: str) -> DataFrame:
    told = B.notify_blocks(_decisions(spark, folder), NOTICE_SECONDS)
    return told.where(F.col("action") == B.BLOCK).select(F.col("tie").alias("event_id"), "notify")


def announcements(spark: SparkSession, folder: str) -> DataFrame:
    told = B.announce(B.notify_blocks(_decisions(spark, folder), NOTICE_SECONDS))
    return told.groupBy("topic", F.col("key").alias("monitor")).agg(F.count(F.lit(1)).alias("messages"))


def state_view(spark: SparkSession, folder: str) -> DataFrame:
    decisions = _decisions(spark, folder)
    asked = events(spark, folder).select((F.col("user_id") * 2).alias("monitor_name"))
    view = B.state_view(asked, B.current_state(decisions), F.unix_seconds(F.lit("2024-01-31").cast("timestamp")))
    return view.withColumn("cooldown_seconds", F.col("cooldown_seconds").cast("long"))


def gate_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a check of the user's monitor but signups of a high value, which
    are failed announcements; middling values are drift."""
    ev = events(spark, folder)
    checks = ev.select(
        F.col("user_id").alias("key"),
        event_time(F.col("ts")).alias("at"),
        F.col("event_id").alias("tie"),
        F.when((F.col("event_type") == "signup") & (F.col("value") > 20), G.PUBLISH_FAILED)
        .otherwise(G.CHECK)
        .alias("kind"),
        (F.col("value") > 5).alias("drifted"),
        (F.col("value") > 40).alias("forced"),
    )
    return G.replay_gate(checks, GATE).select(
        F.col("tie").alias("event_id"),
        "publish",
        F.regexp_replace("publish_reason", r": [0-9]+ s .*$", "").alias("publish_reason"),
    )


def guard_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Repair attempts of five contracts; errors fail."""
    ev = events(spark, folder)
    attempts = ev.select(
        (F.col("user_id") % 5).alias("key"),
        event_time(F.col("ts")).alias("at"),
        F.col("event_id").alias("tie"),
        F.lit("attempt").alias("kind"),
        (F.col("value") < 10).alias("success"),
    )
    return U.replay_guard(attempts, GUARD).select(
        F.col("tie").alias("event_id"),
        F.col("key").alias("contract"),
        "paused",
        "failures",
        "trip_count",
    )


def _guarded_kinds(spark: SparkSession, folder: str) -> DataFrame:
    ev = events(spark, folder)
    attempts = ev.select(
        F.col("event_type").alias("key"),
        event_time(F.col("ts")).alias("at"),
        F.col("event_id").alias("tie"),
        F.lit("attempt").alias("kind"),
        (F.col("value") < 5).alias("success"),
    )
    return U.replay_guard(attempts, GUARD)


def guard_view(spark: SparkSession, folder: str) -> DataFrame:
    states = U.guard_state(_guarded_kinds(spark, folder))
    view = U.guard_view(states, F.unix_seconds(F.lit("2024-01-30 23:59:00").cast("timestamp")))
    return view.select("contract_name", "consecutive_failures", "trip_count", "allowed_now")


def _reports(spark, folder):
    return _reports_of(events(spark, folder))


def _reports_of(ev: DataFrame) -> DataFrame:
    monitor = F.when(F.col("value") < 1, F.lit("")).otherwise(F.concat(F.lit("m"), F.col("user_id")))
    report = F.when(
        F.col("event_type") != "click", F.concat(F.lit("r"), F.col("user_id"), F.dayofmonth("ts") % 2, F.col("event_type"))
    )
    written = F.when(F.col("event_type") == "view", F.lit("unknown")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    )
    return ev.select(
        monitor.alias("monitor_name"),
        report.alias("report_id"),
        parse_iso(written).alias("detected_at"),
        event_time(F.col("ts")).alias("at"),
        F.col("event_id").alias("tie"),
    )


def _admitted(spark, folder):
    return B.admit(_reports(spark, folder), F.lit("2024-01-31").cast("timestamp"), 20 * DAY)


def dedup_stale(spark: SparkSession, folder: str) -> DataFrame:
    return _admitted(spark, folder).select(F.col("tie").alias("event_id"), "admission")


def admission_counts(spark: SparkSession, folder: str) -> DataFrame:
    return B.admission_counts(_admitted(spark, folder))


_BREAKER_SQL = """
WITH RECURSIVE ev AS (
  SELECT user_id AS k, event_id, epoch_us(ts) / 1e6 AS sec, event_type IN ('error', 'view') AS incident, value >= 10 AS success,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
run AS (
  SELECT k, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, 'CLOSED' AS prev, 'CLOSED' AS st, 0 AS n, 0 AS trips,
         CAST(NULL AS DOUBLE) AS opened, CAST(0 AS DOUBLE) AS cool, false AS known, '' AS entry,
         CAST(NULL AS DOUBLE) AS sec
  FROM (SELECT DISTINCT k FROM ev)
  UNION ALL
  SELECT k, rn, event_id, st, nst,
    CASE WHEN incident AND st = 'CLOSED' THEN n + 1 WHEN nst = 'CLOSED' AND st = 'HALF_OPEN' THEN 0 ELSE n END,
    CASE WHEN nst = 'OPEN' AND st <> 'OPEN' THEN trips + 1 WHEN nst = 'CLOSED' AND st = 'HALF_OPEN' THEN 0 ELSE trips END,
    CASE WHEN nst = 'OPEN' AND st <> 'OPEN' THEN sec WHEN nst = 'CLOSED' THEN NULL ELSE opened END,
    CASE WHEN nst = 'OPEN' AND st <> 'OPEN' THEN least(86400.0 * pow(2, trips), 518400.0)
         WHEN nst = 'CLOSED' AND st = 'HALF_OPEN' THEN 0 ELSE cool END,
    known OR incident,
    CASE WHEN incident THEN CASE WHEN fwd THEN 'incident_forwarded' ELSE 'incident_blocked' END
         WHEN NOT known THEN 'rejected' WHEN nst = st THEN 'outcome_ignored'
         WHEN success THEN 'outcome_success' ELSE 'outcome_failure' END,
    sec
  FROM (
    SELECT r.k, e.rn, e.event_id, r.st, r.n, r.trips, r.opened, r.cool, r.known, e.sec, e.incident, e.success,
      CASE WHEN e.incident THEN
             CASE WHEN r.st = 'CLOSED' THEN CASE WHEN r.n + 1 >= 3 THEN 'OPEN' ELSE 'CLOSED' END
                  WHEN r.st = 'OPEN' AND e.sec - r.opened >= r.cool THEN 'HALF_OPEN' ELSE r.st END
           WHEN r.st = 'HALF_OPEN' THEN CASE WHEN e.success THEN 'CLOSED' ELSE 'OPEN' END
           ELSE r.st END AS nst,
      (r.st = 'CLOSED' AND r.n + 1 < 3) OR (r.st = 'OPEN' AND e.sec - r.opened >= r.cool) AS fwd
    FROM run r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1))"""

_THROTTLE_SQL = """,
blocked AS (SELECT k, event_id, sec, prev <> st AS moved,
              row_number() OVER (PARTITION BY k ORDER BY sec, event_id) AS bn
            FROM run WHERE entry = 'incident_blocked'),
told AS (
  SELECT k, bn, event_id, true AS notify, sec AS last FROM blocked WHERE bn = 1
  UNION ALL
  SELECT b.k, b.bn, b.event_id, b.moved OR b.sec - t.last >= 172800,
         CASE WHEN b.moved OR b.sec - t.last >= 172800 THEN b.sec ELSE t.last END
  FROM told t JOIN blocked b ON b.k = t.k AND b.bn = t.bn + 1)"""

_GATE_SQL = """
WITH RECURSIVE ev AS (
  SELECT user_id AS k, event_id, epoch_us(ts) / 1e6 AS sec, event_type = 'signup' AND value > 20 AS failed,
         value > 5 AS drifted, value > 40 AS forced,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
run AS (
  SELECT k, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, false AS was, CAST(NULL AS DOUBLE) AS last,
         '' AS why FROM (SELECT DISTINCT k FROM ev)
  UNION ALL
  SELECT k, rn, event_id, CASE WHEN failed THEN was ELSE drifted END,
    CASE WHEN failed THEN NULL WHEN why IN ('forced', 'new episode', 'episode goes on: heartbeat')
         THEN sec ELSE last END, why
  FROM (SELECT r.k, e.rn, e.event_id, r.was, r.last, e.sec, e.drifted, e.failed,
      CASE WHEN e.failed THEN 'failed announcement forgotten'
           WHEN NOT e.drifted THEN 'clean' WHEN e.forced THEN 'forced'
           WHEN e.sec - r.last < 86400 THEN 'too soon'
           WHEN NOT r.was THEN 'new episode'
           WHEN r.last IS NULL OR e.sec - r.last >= 432000 THEN 'episode goes on: heartbeat'
           ELSE 'same episode' END AS why
    FROM run r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1))
SELECT event_id, why AS publish_reason,
  why IN ('forced', 'new episode', 'episode goes on: heartbeat') AS publish
FROM run WHERE rn > 0"""


def _guard_sql(key: str, ok: str) -> str:
    return f"""
WITH RECURSIVE ev AS (
  SELECT {key} AS k, event_id, epoch_us(ts) / 1e6 AS sec, {ok} AS success,
         row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
run AS (
  SELECT k, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, 0 AS n, 0 AS trips,
         CAST(NULL AS DOUBLE) AS til, false AS paused FROM (SELECT DISTINCT k FROM ev)
  UNION ALL
  SELECT k, rn, event_id,
    CASE WHEN held THEN n WHEN success THEN 0 ELSE n + 1 END,
    CASE WHEN NOT held AND NOT success AND n + 1 >= 3 THEN trips + 1 ELSE trips END,
    CASE WHEN held THEN til WHEN success THEN NULL
         WHEN n + 1 >= 3 THEN sec + least(3600.0 * pow(2, trips), 43200.0) ELSE til END, held
  FROM (SELECT r.k, e.rn, e.event_id, r.n, r.trips, r.til, e.sec, e.success,
               coalesce(e.sec < r.til, false) AS held
        FROM run r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1))"""


_ADMIT_SQL = """
WITH r AS (SELECT *, value < 1 AS nameless,
    CASE WHEN event_type <> 'click' THEN 'r' || user_id || (day(ts) % 2) || event_type END AS report_id,
    event_type <> 'view' AND epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', ts)) > 1728000 AS old
  FROM events),
labelled AS (
  SELECT event_id, 'no_monitor' AS admission FROM r WHERE nameless
  UNION ALL SELECT event_id, 'stale' FROM r WHERE NOT nameless AND old
  UNION ALL SELECT event_id, 'ok' FROM r WHERE NOT nameless AND NOT old AND report_id IS NULL
  UNION ALL SELECT event_id,
      CASE WHEN row_number() OVER (PARTITION BY report_id ORDER BY ts, event_id) = 1 THEN 'ok' ELSE 'duplicate' END
    FROM r WHERE NOT nameless AND NOT old AND report_id IS NOT NULL)"""

QUERIES = {
    "breaker_replay": breaker_replay,
    "throttle_replay": throttle_replay,
    "announcements": announcements,
    "state_view": state_view,
    "gate_replay": gate_replay,
    "guard_replay": guard_replay,
    "guard_view": guard_view,
    "dedup_stale": dedup_stale,
    "admission_counts": admission_counts,
}

ORACLE = {
    "breaker_replay": _BREAKER_SQL
    + """ SELECT event_id, k AS monitor, entry, prev AS from_state, st AS to_state, n AS consecutive_failures,
  trips AS trip_count, CAST(cool AS BIGINT) AS cooldown_seconds FROM run WHERE rn > 0""",
    "throttle_replay": _BREAKER_SQL + _THROTTLE_SQL + " SELECT event_id, notify FROM told",
    "announcements": _BREAKER_SQL
    + _THROTTLE_SQL
    + """ SELECT topic, k AS monitor, count(*) AS messages FROM (
  SELECT 'remediation-requests' AS topic, k FROM run WHERE entry = 'incident_forwarded'
  UNION ALL SELECT 'remediation-dlq', k FROM told WHERE notify) GROUP BY 1, 2""",
    "state_view": _BREAKER_SQL
    + """, fin AS (SELECT * FROM run r WHERE known AND rn = (SELECT max(rn) FROM run x WHERE x.k = r.k))
SELECT monitor_name, coalesce(st, 'CLOSED') AS state, coalesce(n, 0) AS consecutive_failures,
  coalesce(trips, 0) AS trip_count, CAST(coalesce(cool, 0) AS BIGINT) AS cooldown_seconds,
  coalesce(st = 'OPEN' AND epoch(TIMESTAMP '2024-01-31') - opened >= cool, false) AS cooldown_elapsed
FROM (SELECT DISTINCT user_id * 2 AS monitor_name FROM events) LEFT JOIN fin ON k = monitor_name""",
    "gate_replay": _GATE_SQL,
    "guard_replay": _guard_sql("user_id % 5", "value < 10")
    + " SELECT event_id, k AS contract, paused, n AS failures, trips AS trip_count FROM run WHERE rn > 0",
    "guard_view": _guard_sql("event_type", "value < 5")
    + """ SELECT k AS contract_name, n AS consecutive_failures, trips AS trip_count,
  til IS NULL OR epoch(TIMESTAMP '2024-01-30 23:59:00') >= til AS allowed_now
FROM run r WHERE rn = (SELECT max(rn) FROM run x WHERE x.k = r.k)""",
    "dedup_stale": _ADMIT_SQL + " SELECT * FROM labelled",
    "admission_counts": _ADMIT_SQL + " SELECT admission, count(*) AS incidents FROM labelled GROUP BY 1",
}
