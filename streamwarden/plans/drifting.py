"""Registered queries: drift statistics and verdicts."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamwarden.operators import drift as D
from streamwarden.session import use_checkpoint_dir
from streamwarden.sources.tables import table
from streamwarden.streaming.drift_summaries import Summaries

UTC = timezone.utc
SHIP = D.Bounds(
    datetime(1996, 1, 1, tzinfo=UTC),
    datetime(1998, 1, 1, tzinfo=UTC),
    datetime(1999, 1, 1, tzinfo=UTC),
    datetime(2000, 1, 1, tzinfo=UTC),
)
WEEK = D.Bounds(
    datetime(2024, 1, 3, tzinfo=UTC),
    datetime(2024, 1, 17, tzinfo=UTC),
    datetime(2024, 1, 24, tzinfo=UTC),
    datetime(2024, 1, 31, tzinfo=UTC),
)
NUMBERS = ["l_quantity", "l_discount", "l_extendedprice", "shifted", "constant", "two", "holey"]


def _wide_shipments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    late = F.col("l_shipdate") >= F.lit(SHIP.current_start)
    return rows.select(
        "l_shipdate",
        "l_quantity",
        "l_discount",
        "l_extendedprice",
        (F.col("l_extendedprice") * F.when(late, 1.5).otherwise(1.0)).alias("shifted"),
        F.lit(7.0).alias("constant"),
        F.when(F.col("l_returnflag") == "A", 1.0).otherwise(2.0).alias("two"),
        F.when(F.col("l_linenumber") != 2, F.col("l_tax")).when(late, F.lit(float("nan"))).alias("holey"),
    )


def _shipments(spark: SparkSession, folder: str) -> DataFrame:
    return D.windowed(_wide_shipments(spark, folder), "l_shipdate", SHIP, NUMBERS)


def psi_by_column(spark: SparkSession, folder: str) -> DataFrame:
    return D.psi(_shipments(spark, folder), NUMBERS).select("column", F.round("score", 6).alias("psi"))


def psi_from_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The same scores from daily value counts, stored in two batches and added up by windows."""
    use_checkpoint_dir(spark)
    settings = D.DriftSettings("shipments", "l_shipdate", tuple(NUMBERS))
    stored = Summaries(f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}", settings, 86400)
    rows = _wide_shipments(spark, folder)
    for batch in range(2):
        stored.add(rows.where(F.col("l_quantity") % 2 == batch), "all", batch)
    scores = D.psi_from_counts(stored.windows(spark, SHIP).where(F.col("column") != ""), NUMBERS)
    return scores.select("column", F.round("score", 6).alias("psi"))


def quantile_edges(spark: SparkSession, folder: str) -> DataFrame:
    _, counted = D.reference_histogram(_shipments(spark, folder), NUMBERS)
    return counted.where("bin > 0").select("column", "bin", "reference_rows", "current_rows")


def _event_rows(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "events")
    late = F.col("ts") >= F.lit(WEEK.current_start)
    wide = ev.select(
        "ts",
        "event_type",
        F.when(late & (F.col("event_type") == "view"), F.lit("stream")).otherwise(F.col("event_type")).alias("renamed"),
        F.when(F.col("value") > 20, "high").when(F.col("value") > 2, "low").alias("level"),
        "value",
    )
    return D.windowed(wide, "ts", WEEK, ["event_type", "renamed", "level", "value"])


def chi2_by_column(spark: SparkSession, folder: str) -> DataFrame:
    scores = D.chi2(_event_rows(spark, folder), ["event_type", "renamed"])
    return scores.select("column", F.round("score", 6).alias("score"), "drifted")


def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return D.category_counts(_event_rows(spark, folder), ["event_type", "renamed", "level"])


def distribution_distances(spark: SparkSession, folder: str) -> DataFrame:
    d = D.distances(_event_rows(spark, folder), ["value"])
    return d.select("column", F.round("ks", 6).alias("ks"), F.round("wasserstein", 6).alias("wasserstein"))


def jensen_shannon(spark: SparkSession, folder: str) -> DataFrame:
    d = D.jensen_shannon(_shipments(spark, folder), ["l_quantity", "l_extendedprice", "shifted"])
    return d.select("column", F.round("jensen_shannon", 6).alias("jensen_shannon"))


def drift_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """A whole check over order attributes: two windows of orders by date."""
    rows = table(spark, folder, "orders")
    late = F.col("o_orderdate") >= F.lit(datetime(2000, 1, 1, tzinfo=UTC))
    wide = rows.select(
        "o_orderdate",
        "o_totalprice",
        (F.col("o_totalprice") + F.when(late, 200000.0).otherwise(0.0)).alias("raised"),
        "o_orderstatus",
        "o_orderpriority",
        F.when(late, F.lit("new")).otherwise(F.col("o_orderstatus")).alias("status"),
    )
    settings = D.DriftSettings(
        "orders",
        "o_orderdate",
        ("o_totalprice", "raised", "no_such_column"),
        ("o_orderstatus", "status"),
        lookback_days=1000,
        offset_days=700,
        current_hours=24 * 365,
        share_threshold=0.5,
        min_reference_rows=20,
    )
    report = D.drift_check(wide, settings, datetime(2001, 1, 1, tzinfo=UTC))
    flags = F.transform("column_results", lambda c: F.concat_ws(":", c["column"], c["method"], c["drifted"].cast("string")))
    return report.select(
        "monitor_name", "dataset_drift_detected", "drift_share", F.array_join(flags, ",").alias("columns")
    )


_SHIP_SQL = """
WITH base AS (SELECT *, l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AS ref,
    l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2000-01-01' AS cur FROM lineitem),
long AS (
  SELECT 'l_quantity' AS col, l_quantity AS v, ref, cur FROM base
  UNION ALL SELECT 'l_discount', l_discount, ref, cur FROM base
  UNION ALL SELECT 'l_extendedprice', l_extendedprice, ref, cur FROM base
  UNION ALL SELECT 'shifted', l_extendedprice * CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' THEN 1.5::DOUBLE ELSE 1.0 END, ref, cur FROM base
  UNION ALL SELECT 'constant', 7.0, ref, cur FROM base
  UNION ALL SELECT 'two', CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 2.0 END, ref, cur FROM base
  UNION ALL SELECT 'holey', l_tax, ref, cur FROM base WHERE l_linenumber <> 2),
inwin AS (SELECT * FROM long WHERE ref OR cur),
q AS (SELECT col, list_sort(list_distinct(quantile_cont(v, [x::DOUBLE FOR x IN ['0', '0.1', '0.2', '0.30000000000000004', '0.4', '0.5', '0.6000000000000001', '0.7000000000000001', '0.8', '0.9', '1']]))) AS e,
             median(v) AS med, min(v) AS lo, max(v) AS hi FROM inwin WHERE ref GROUP BY col),
edges AS (SELECT col, CASE WHEN len(e) < 3 THEN [lo - 1e-9::DOUBLE, med, hi + 1e-9::DOUBLE] ELSE e END AS e FROM q),
bins AS (SELECT col, e, unnest(generate_series(1, len(e) - 1)) AS b FROM edges),
cnt AS (SELECT bins.col, b,
    (SELECT count(*) FROM inwin i WHERE i.col = bins.col AND ref AND v >= e[b] AND (v < e[b + 1] OR (b = len(e) - 1 AND v = e[b + 1]))) AS rn,
    (SELECT count(*) FROM inwin i WHERE i.col = bins.col AND cur AND v >= e[b] AND (v < e[b + 1] OR (b = len(e) - 1 AND v = e[b + 1]))) AS cn
  FROM bins)"""

_EVENT_SQL = """
WITH base AS (SELECT *, ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-17' AS ref,
    ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' AS cur FROM events),
long AS (SELECT * FROM (
  SELECT 'event_type' AS col, event_type AS v, ref, cur FROM base
  UNION ALL SELECT 'renamed', CASE WHEN cur AND event_type = 'view' THEN 'stream' ELSE event_type END, ref, cur FROM base
  UNION ALL SELECT 'level', CASE WHEN value > 20 THEN 'high' WHEN value > 2 THEN 'low' END, ref, cur FROM base)
  WHERE (ref OR cur) AND v IS NOT NULL),
cnt AS (SELECT col, v, count(*) FILTER (ref) AS r, count(*) FILTER (cur) AS c FROM long GROUP BY 1, 2),
stat AS (SELECT col, count(*) AS k, sum(pow(c + 1 - x, 2) / x) AS chi FROM (
    SELECT col, c, (r + 1) / (sum(r) OVER w + count(*) OVER w) * (sum(c) OVER w + count(*) OVER w) AS x
    FROM cnt WINDOW w AS (PARTITION BY col)) GROUP BY col)"""

QUERIES = {
    "psi_by_column": psi_by_column,
    "psi_from_summaries": psi_from_summaries,
    "quantile_edges": quantile_edges,
    "chi2_by_column": chi2_by_column,
    "category_counts": category_counts,
    "distribution_distances": distribution_distances,
    "jensen_shannon": jensen_shannon,
    "drift_verdict": drift_verdict,
}

ORACLE = {
    "psi_by_column": _SHIP_SQL
    + """, sh AS (SELECT col, greatest(rn / greatest(sum(rn) OVER w, 1), 1e-4) AS r, greatest(cn / greatest(sum(cn) OVER w, 1), 1e-4) AS c
      FROM cnt WINDOW w AS (PARTITION BY col))
SELECT col AS "column", round(sum((c - r) * ln(c / r)), 6) AS psi FROM sh GROUP BY col""",
    "quantile_edges": _SHIP_SQL
    + ' SELECT col AS "column", CAST(b AS INTEGER) AS bin, rn AS reference_rows, cn AS current_rows FROM cnt',
    "chi2_by_column": _EVENT_SQL
    + """, p AS (SELECT col, CASE k WHEN 5 THEN exp(-chi / 2) * (1 + chi / 2)
        WHEN 6 THEN NULL END AS p5, chi, k FROM stat WHERE col <> 'level')
SELECT col AS "column", CASE WHEN k = 5 THEN round(1 - p5, 6) ELSE 1.0 END AS score,
  CASE WHEN k = 5 THEN p5 < 0.05 ELSE chi > 11.0705 END AS drifted FROM p""",
    "category_counts": _EVENT_SQL
    + ' SELECT col AS "column", v AS category, r AS reference_rows, c AS current_rows FROM cnt',
    "distribution_distances": """
WITH c AS (SELECT value AS v, count(*) FILTER (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-17') AS r,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31') AS k FROM events GROUP BY 1),
f AS (SELECT v, abs(sum(r) OVER (ORDER BY v) / sum(r) OVER () - sum(k) OVER (ORDER BY v) / sum(k) OVER ()) AS g,
    coalesce(lead(v) OVER (ORDER BY v) - v, 0) AS step FROM c WHERE r > 0 OR k > 0)
SELECT 'value' AS "column", round(max(g), 6) AS ks, round(sum(g * step), 6) AS wasserstein FROM f""",
    "jensen_shannon": _SHIP_SQL
    + """, sh AS (SELECT col, rn / sum(rn) OVER w AS r, cn / sum(cn) OVER w AS c
      FROM cnt WINDOW w AS (PARTITION BY col))
SELECT col AS "column", round(sqrt(greatest(sum(
    CASE WHEN r > 0 THEN r * ln(r / ((r + c) / 2)) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c / ((r + c) / 2)) ELSE 0 END) / 2, 0)), 6) AS jensen_shannon
FROM sh WHERE col IN ('l_quantity', 'l_extendedprice', 'shifted') GROUP BY col""",
    "drift_verdict": """
WITH base AS (SELECT *, o_orderdate < TIMESTAMP '1999-02-01' AS ref,
    o_totalprice + CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 200000.0 ELSE 0 END AS raised
  FROM orders WHERE (o_orderdate >= TIMESTAMP '1999-02-01' - INTERVAL 1000 DAY AND o_orderdate < TIMESTAMP '1999-02-01')
     OR (o_orderdate >= TIMESTAMP '2001-01-01' - INTERVAL 365 DAY AND o_orderdate < TIMESTAMP '2001-01-01')),
long AS (SELECT 'o_totalprice' AS col, o_totalprice AS v, ref FROM base UNION ALL SELECT 'raised', raised, ref FROM base),
edges AS (SELECT col, list_sort(list_distinct(quantile_cont(v, [x::DOUBLE FOR x IN ['0', '0.1', '0.2', '0.30000000000000004', '0.4', '0.5', '0.6000000000000001', '0.7000000000000001', '0.8', '0.9', '1']]))) AS e
  FROM long WHERE ref GROUP BY col),
bins AS (SELECT col, e, unnest(generate_series(1, len(e) - 1)) AS b FROM edges),
cnt AS (SELECT bins.col, b, count(*) FILTER (ref) AS rn, count(*) FILTER (NOT ref) AS cn
  FROM bins LEFT JOIN long l ON l.col = bins.col AND v >= e[b] AND (v < e[b + 1] OR (b = len(e) - 1 AND v = e[b + 1])) GROUP BY 1, 2),
sh AS (SELECT col, greatest(rn / greatest(sum(rn) OVER w, 1), 1e-4) AS r, greatest(cn / greatest(sum(cn) OVER w, 1), 1e-4) AS c
  FROM cnt WINDOW w AS (PARTITION BY col)),
psi AS (SELECT col, sum((c - r) * ln(c / r)) >= 0.1 AS d FROM sh GROUP BY col),
st AS (SELECT o_orderstatus AS s, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM base GROUP BY 1),
chi AS (SELECT exp(-sum(pow(c + 1 - x, 2) / x) / 2) < 0.05 AS d FROM (
  SELECT c, (r + 1) / (sum(r) OVER () + 3) * (sum(c) OVER () + 3) AS x FROM st)),
flags AS (SELECT col || ':psi:' || d AS t, d FROM psi UNION ALL SELECT 'o_orderstatus:chi2:' || d, d FROM chi
  UNION ALL SELECT 'status:chi2:true', true)
SELECT 'orders' AS monitor_name, avg(CAST(d AS INTEGER)) >= 0.5 AS dataset_drift_detected,
  round(avg(CAST(d AS INTEGER)), 4) AS drift_share, string_agg(t, ',' ORDER BY t) AS columns FROM flags""",
}

ORACLE["psi_from_summaries"] = ORACLE["psi_by_column"]
