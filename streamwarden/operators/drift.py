"""Distribution drift between a reference and a current time window."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from streamwarden.functions.stats import chi2_tail
from streamwarden.operators.ordered import quantile_counts, quantiles_of_counts, running_totals, unpivoted
from streamwarden.operators.route import stable_id
from streamwarden.session import cut

REFERENCE, CURRENT = "reference", "current"
PSI_BUCKETS = 10
SHARE_FLOOR = 1e-4
EDGE_MARGIN = 1e-9


class WindowTooSmall(ValueError):
    """Too few rows to judge; never reported as "no drift"."""


@dataclass(frozen=True)
class Bounds:
    reference_start: datetime
    reference_end: datetime
    current_start: datetime
    current_end: datetime


@dataclass(frozen=True)
class DriftSettings:
    monitor_name: str
    timestamp_column: str
    numerical: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    lookback_days: float = 14
    offset_days: float = 7
    fixed_reference: tuple[datetime, datetime] | None = None
    current_hours: float = 1.0
    psi_threshold: float = 0.1
    significance: float = 0.05
    share_threshold: float = 0.5
    min_reference_rows: int = 200
    min_current_rows: int = 30

    def __post_init__(self):
        if not self.numerical and not self.categorical:
            raise ValueError("at least one numerical or categorical column must be configured")

    def bounds(self, as_of: datetime) -> Bounds:
        end = as_of - timedelta(days=self.offset_days)
        start = end - timedelta(days=self.lookback_days)
        if self.fixed_reference:
            start, end = self.fixed_reference
        return Bounds(start, end, as_of - timedelta(hours=self.current_hours), as_of)


def settings_from(doc: dict) -> DriftSettings:
    """Read the configuration document of a monitor."""
    window, test = doc.get("reference_window", {}), doc.get("drift_detection", {})
    fixed = None
    if window.get("strategy", "rolling") == "fixed":
        fixed = (window.get("fixed_start"), window.get("fixed_end"))
        if None in fixed:
            raise ValueError("a fixed reference window needs fixed_start and fixed_end")
    return DriftSettings(
        monitor_name=doc["monitor_name"],
        timestamp_column=doc["source"]["timestamp_column"],
        numerical=tuple(doc["columns"].get("numerical") or ()),
        categorical=tuple(doc["columns"].get("categorical") or ()),
        lookback_days=window.get("lookback_days", 14),
        offset_days=window.get("offset_days", 7),
        fixed_reference=fixed,
        current_hours=doc.get("current_window", {}).get("lookback_hours", 1.0),
        psi_threshold=test.get("column_drift_threshold", 0.1),
        significance=test.get("categorical_significance_level", 0.05),
        share_threshold=test.get("dataset_drift_share_threshold", 0.5),
        min_reference_rows=test.get("min_reference_rows", 200),
        min_current_rows=test.get("min_current_rows", 30),
    )


def windowed(df: DataFrame, timestamp: str, bounds: Bounds, columns: Sequence[str]) -> DataFrame:
    """Rows of both half-open windows with ``in_reference`` and ``in_current``; one pruned scan."""
    ts, kind = F.col(timestamp), df.schema[timestamp].dataType

    def within(start: datetime, end: datetime) -> Column:
        # bounds take the column's own type: a cast on the column would keep the filter out of the scan
        return (ts >= F.lit(start).cast(kind)) & (ts < F.lit(end).cast(kind))

    reference = within(bounds.reference_start, bounds.reference_end)
    current = within(bounds.current_start, bounds.current_end)
    return df.where(reference | current).select(
        reference.alias("in_reference"), current.alias("in_current"), *columns
    )


def reference_histogram(
    rows: DataFrame, columns: Sequence[str], buckets: int = PSI_BUCKETS
) -> tuple[dict[str, list[float]], DataFrame | None]:
    """Distinct quantiles of the reference, and (column, bin, reference_rows, current_rows) between them.

    Empty bins are present; bin 0 holds what lies outside all edges. A nearly constant column
    gets two coarse bins. Both come from the same two scans: quantiles lie within the values
    that were kept apart, so a collapsed range is inside one bin.
    """
    probs = _probabilities(buckets)
    # the coarse edges lie between values: such columns are counted value by value
    found, counted, whole = quantile_counts(rows, columns, probs + [0.5], apart=3)
    coarse = [c for c, values in found.items() if len(set(values[:-1])) < 3 and c not in whole]
    if coarse:
        again = quantile_counts(rows, coarse, probs + [0.5], apart=1 << 30)[1]
        counted = counted.where(~F.col("column").isin(*coarse)).unionByName(again)
    edges = _edges(found)
    return edges, _histogram(counted, edges) if edges else None


def _probabilities(buckets: int) -> list[float]:
    """Multiples of the step, not exact fractions: 3 * 0.1 lies a hair above 0.3, and a value can sit there."""
    return [i * (1 / buckets) for i in range(buckets)] + [1.0]


def _edges(found: dict[str, list[float]]) -> dict[str, list[float]]:
    """Bin edges from each column's quantiles, the last of which is its median."""
    edges = {}
    for name, values in found.items():
        distinct = sorted(set(values[:-1]))
        if len(distinct) < 3:
            distinct = [min(values) - EDGE_MARGIN, values[-1], max(values) + EDGE_MARGIN]
        edges[name] = distinct
    return edges


def _bin_of(value: Column, gap: Column, edges: list[float]) -> Column:
    """Bin number, the last bin closed; 0 outside the edges."""
    passed = F.lit(0)
    for edge in edges:
        passed = passed + (value >= F.lit(edge)).cast("int")
    last = len(edges) - 1
    own = F.when(value == F.lit(edges[-1]), last).when(passed > last, 0).otherwise(passed)
    return F.when(gap == 0, own).when(gap < 0, 0).otherwise(F.when(passed > last, 0).otherwise(passed))


def window_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if("in_reference").alias("reference_rows"), F.count_if("in_current").alias("current_rows")
    )


def _histogram(counted: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    place = None
    for name, own in edges.items():
        here, number = F.col("column") == name, _bin_of(F.col("value"), F.col("gap"), own)
        place = F.when(here, number) if place is None else place.when(here, number)
    sums = [F.sum(n).alias(n) for n in ("reference_rows", "current_rows")]
    binned = counted.groupBy("column", place.alias("bin")).agg(*sums)
    every = [(c, b, 0, 0) for c in edges for b in range(1, len(edges[c]))]
    empty = counted.sparkSession.createDataFrame(every, "column string, bin int, reference_rows long, current_rows long")
    return binned.unionByName(empty).groupBy("column", "bin").agg(*sums)


def _with_totals(counts: DataFrame) -> DataFrame:
    """Add per-column totals: one row per configured column, so the totals are broadcast."""
    totals = counts.groupBy("column").agg(
        F.sum("reference_rows").alias("reference_total"),
        F.sum("current_rows").alias("current_total"),
        F.count(F.lit(1)).alias("parts"),
    )
    return counts.join(F.broadcast(totals), "column")


def psi(rows: DataFrame, columns: Sequence[str], buckets: int = PSI_BUCKETS) -> DataFrame:
    """(column, score): the population stability index of each numeric column, in two scans."""
    return _psi_of(rows.sparkSession, reference_histogram(rows, columns, buckets)[1], columns)


def psi_from_counts(counts: DataFrame, columns: Sequence[str], buckets: int = PSI_BUCKETS) -> DataFrame:
    """The same from (column, value, reference_rows, current_rows), a row per column and value."""
    probs = _probabilities(buckets)
    found, counted = quantiles_of_counts(counts, columns, probs + [0.5])
    edges = _edges(found)
    return _psi_of(counts.sparkSession, _histogram(counted, edges) if edges else None, columns)


def _psi_of(spark, counted: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    asked = spark.createDataFrame([(c,) for c in columns], "column string")
    if counted is None:
        return asked.select("column", F.lit(0.0).alias("score"))
    counted = cut(counted)  # a row per column and bin
    seen = counted.groupBy("column").agg(F.sum("current_rows").alias("seen"))
    shares = bin_shares(_with_totals(counted.where("bin > 0")))
    r, c = F.greatest("r", F.lit(SHARE_FLOOR)), F.greatest("c", F.lit(SHARE_FLOOR))
    scores = shares.groupBy("column").agg(F.sum((c - r) * F.ln(c / r)).alias("score"))
    joined = asked.join(F.broadcast(seen), "column", "left").join(F.broadcast(scores), "column", "left")
    return joined.select("column", F.when(F.col("seen") > 0, F.col("score")).otherwise(0.0).alias("score"))


def bin_shares(counts: DataFrame) -> DataFrame:
    return counts.select(
        "column",
        "bin",
        (F.col("reference_rows") / F.greatest("reference_total", F.lit(1))).alias("r"),
        (F.col("current_rows") / F.greatest("current_total", F.lit(1))).alias("c"),
    )


def category_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in columns])
    )
    long = rows.select("in_reference", "in_current", cells.alias("c"))
    return window_counts(
        long.where("c.category is not null"), [F.col("c.column").alias("column"), F.col("c.category").alias("category")]
    )


def chi2(rows: DataFrame, columns: Sequence[str], significance: float = 0.05) -> DataFrame:
    """(column, score, drifted): goodness of fit of category counts, add-one smoothed."""
    return chi2_from_counts(category_counts(rows, columns), columns, significance)


def chi2_from_counts(counted: DataFrame, columns: Sequence[str], significance: float = 0.05) -> DataFrame:
    """The same from (column, category, reference_rows, current_rows)."""
    asked = counted.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    counts = _with_totals(counted)
    observed = F.col("current_rows") + 1
    expected = (
        (F.col("reference_rows") + 1)
        / (F.col("reference_total") + F.col("parts"))
        * (F.col("current_total") + F.col("parts"))
    )
    tests = counts.groupBy("column").agg(
        F.sum(F.pow(observed - expected, 2) / expected).alias("statistic"),
        F.first("parts").alias("parts"),
        F.first("current_total").alias("current_total"),
    )
    judged = tests.withColumn("p", chi2_tail("statistic", (F.col("parts") - 1).cast("double")))
    testable = (F.col("parts") >= 2) & (F.col("current_total") > 0)
    return asked.join(judged, "column", "left").select(
        "column",
        F.coalesce(F.when(testable, 1.0 - F.col("p")), F.lit(0.0)).alias("score"),
        F.coalesce(testable & (F.col("p") < significance), F.lit(False)).alias("drifted"),
    )


def window_sizes(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("in_reference").alias("reference"), F.count_if("in_current").alias("current"))


def require_rows(sizes: DataFrame, settings: DriftSettings) -> None:
    size = sizes.first()
    if size.reference < settings.min_reference_rows:
        raise WindowTooSmall(f"reference window has {size.reference} rows, needs {settings.min_reference_rows}")
    if size.current < settings.min_current_rows:
        raise WindowTooSmall(f"current window has {size.current} rows, needs {settings.min_current_rows}")


def column_verdicts(rows: DataFrame, settings: DriftSettings) -> DataFrame | None:
    """(column, kind, method, score, drifted) for the configured columns that exist."""
    numerical = [c for c in settings.numerical if c in rows.columns]
    categorical = [c for c in settings.categorical if c in rows.columns]
    return verdicts(
        psi(rows, numerical) if numerical else None,
        chi2(rows, categorical, settings.significance) if categorical else None,
        settings,
    )


def verdicts(scores: DataFrame | None, tests: DataFrame | None, settings: DriftSettings) -> DataFrame | None:
    parts = []
    if scores is not None:
        drifted = (F.col("score") >= settings.psi_threshold).alias("drifted")
        parts.append(scores.select("column", F.lit("numerical").alias("kind"), F.lit("psi").alias("method"), "score", drifted))
    if tests is not None:
        parts.append(tests.select("column", F.lit("categorical").alias("kind"), F.lit("chi2").alias("method"), "score", "drifted"))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def verdict(columns: DataFrame, settings: DriftSettings) -> DataFrame:
    """One row: the share of drifted columns and whether the dataset drifted (on the exact share)."""
    share = F.avg(F.col("drifted").cast("double"))
    shown = F.struct("column", "kind", "method", F.round("score", 4).alias("score"), "drifted")
    return columns.agg(
        F.coalesce(share >= settings.share_threshold, F.lit(False)).alias("dataset_drift_detected"),
        F.coalesce(F.round(share, 4), F.lit(0.0)).alias("drift_share"),
        F.array_sort(F.collect_list(shown)).alias("column_results"),
    )


def drift_check(df: DataFrame, settings: DriftSettings, as_of: datetime) -> DataFrame:
    """The drift report of one monitor; raises when a window is too small to judge."""
    bounds = settings.bounds(as_of)
    wanted = [c for c in (*settings.numerical, *settings.categorical) if c in df.columns]
    rows = windowed(df, settings.timestamp_column, bounds, wanted)
    require_rows(window_sizes(rows), settings)
    return drift_report(df.sparkSession, column_verdicts(rows, settings), settings, bounds, as_of)


def drift_report(spark, columns: DataFrame | None, settings: DriftSettings, bounds: Bounds, as_of: datetime) -> DataFrame:
    if columns is None:
        columns = spark.createDataFrame([], "column string, kind string, method string, score double, drifted boolean")
    return verdict(columns, settings).select(
        stable_id(F.lit(settings.monitor_name), F.lit(as_of)).alias("report_id"),
        F.lit(settings.monitor_name).alias("monitor_name"),
        F.lit(as_of).alias("run_timestamp"),
        F.lit(bounds.reference_start).alias("reference_start"),
        F.lit(bounds.reference_end).alias("reference_end"),
        F.lit(bounds.current_start).alias("current_start"),
        F.lit(bounds.current_end).alias("current_end"),
        "dataset_drift_detected",
        "drift_share",
        "column_results",
    )


def drift_events(reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """Messages for the reports the publish gate let through."""
    published = decisions.where("publish").select(F.col("tie").alias("report_id"), "publish_reason")
    body = F.struct(
        F.lit("dataset_drift_detected").alias("event_type"),
        "monitor_name",
        "report_id",
        "drift_share",
        F.col("run_timestamp").alias("detected_at"),
        "publish_reason",
    )
    return reports.join(published, "report_id").select(F.lit("drift-events").alias("topic"), F.to_json(body).alias("value"))


def distances(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, ks, wasserstein): two-sample distances from exact running counts."""
    long = unpivoted(rows, columns, ["in_reference", "in_current"])
    counted = window_counts(long, ["column", "value"])
    totals = counted.groupBy("column").agg(
        F.sum("reference_rows").alias("reference_total"), F.sum("current_rows").alias("current_total")
    )
    running = running_totals(counted, ["column"], ["value"], ["reference_rows", "current_rows"])
    gap = F.abs(
        F.col("reference_rows_through") / F.col("reference_total")
        - F.col("current_rows_through") / F.col("current_total")
    )
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    return (
        running.join(F.broadcast(totals), "column")  # one row per configured column
        .groupBy("column")
        .agg(F.max(gap).alias("ks"), F.sum(gap * step).alias("wasserstein"))
    )


def jensen_shannon(rows: DataFrame, columns: Sequence[str], buckets: int = PSI_BUCKETS) -> DataFrame:
    """(column, jensen_shannon): distance between bin shares over reference quantiles."""
    _, counted = reference_histogram(rows, columns, buckets)
    if counted is None:
        return rows.sparkSession.createDataFrame([], "column string, jensen_shannon double")
    shares = bin_shares(_with_totals(counted.where("bin > 0")))
    middle = (F.col("r") + F.col("c")) / 2

    def part(share: str) -> Column:
        return F.when(F.col(share) > 0, F.col(share) * F.ln(F.col(share) / middle)).otherwise(0.0)

    total = F.sum((part("r") + part("c")) / 2)
    return shares.groupBy("column").agg(F.sqrt(F.greatest(total, F.lit(0.0))).alias("jensen_shannon"))
