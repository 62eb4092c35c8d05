"""Drift from stored summaries: value counts per period, which a rolling window adds up.

New rows are counted once, by period and value, and kept in a table by period. A check adds the
counts of the periods in its two windows and never reads the rows again; what overlaps from
one check to the next is not counted again. Counts add up exactly, so the report equals
that of a check over the rows. Columns with many different values have summaries as long
as themselves; round them first where that matters.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from streamwarden.operators import drift as D
from streamwarden.operators.ordered import cells
from streamwarden.session import cut
from streamwarden.sources.keyed_table import KeyedTable, Manifest

COUNTS = "period long, column string, value double, category string, n long"
ROWS = ""  # the column that counts the rows of a period, with or without values


@dataclass(frozen=True)
class Summaries:
    path: str
    settings: D.DriftSettings
    period_seconds: int = 3600
    buckets: int = 64

    @property
    def table(self) -> KeyedTable:
        return KeyedTable(self.path, ("period",), COUNTS, self.buckets)

    def _period(self, at: datetime) -> int:
        aware = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        seconds = aware.timestamp()
        if seconds % self.period_seconds:
            raise ValueError(f"{at} is not the start of a period of {self.period_seconds} s")
        return int(seconds // self.period_seconds)

    def counts_of(self, df: DataFrame) -> DataFrame:
        """Value counts of new rows; combined before the shuffle."""
        s = self.settings
        numerical = [c for c in s.numerical if c in df.columns]
        categorical = [c for c in s.categorical if c in df.columns]
        instant = F.unix_seconds(F.col(s.timestamp_column).cast("timestamp"))
        timed = df.where(F.col(s.timestamp_column).isNotNull()).withColumn("period", F.floor(instant / self.period_seconds).cast("long"))

        def counted(rows: DataFrame, **held: Column) -> DataFrame:
            """Each kind of cell by itself, so that the keys are no wider than its own."""
            keys = [c for c in ("period", "column", "value", "category") if c in rows.columns]
            counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            return counts.withColumns(held).select("period", "column", "value", "category", "n")

        no_value, no_category = F.lit(None).cast("double"), F.lit(None).cast("string")
        parts = [counted(timed.select("period"), column=F.lit(ROWS), value=no_value, category=no_category)]
        if numerical:
            # rows of a period follow each other, so the counts a task adds to at a time are few and near
            found = cells(timed.sortWithinPartitions("period"), numerical, lambda name, value: {}, ["period"])
            parts.append(counted(found, category=no_category))
        if categorical:
            named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in categorical])
            found = timed.select("period", F.inline(named)).where("category is not null")
            parts.append(counted(found, value=no_value))
        counts = parts[0]
        for part in parts[1:]:
            counts = counts.unionByName(part)
        return counts

    def add(self, df: DataFrame, run: str, batch: int) -> Manifest:
        """Count new rows; a batch that runs again replaces what it added. Late rows are simply added."""
        return self.table.append(cut(self.counts_of(df)), run, batch)

    def windows(self, spark: SparkSession, bounds: D.Bounds) -> DataFrame:
        """Counts of both windows, from the buckets of their periods alone."""
        spans = [(self._period(bounds.reference_start), self._period(bounds.reference_end))]
        spans.append((self._period(bounds.current_start), self._period(bounds.current_end)))
        low, high = min(a for a, _ in spans), max(b for _, b in spans)
        periods = spark.range(low, max(low, high)).withColumnRenamed("id", "period")

        def within(span: tuple[int, int]) -> Column:
            return (F.col("period") >= span[0]) & (F.col("period") < span[1])

        asked = periods.where(within(spans[0]) | within(spans[1]))
        held = self.table.read(spark, self.table.touched(asked)).where(within(spans[0]) | within(spans[1]))
        return held.groupBy("column", "value", "category").agg(
            F.sum(F.when(within(spans[0]), F.col("n")).otherwise(0)).alias("reference_rows"),
            F.sum(F.when(within(spans[1]), F.col("n")).otherwise(0)).alias("current_rows"),
        )

    def check(self, spark: SparkSession, as_of: datetime) -> DataFrame:
        """As ``drift.drift_check`` over all rows added; windows must be made of whole periods."""
        s, bounds = self.settings, self.settings.bounds(as_of)
        counts = cut(self.windows(spark, bounds))
        rows = counts.where(F.col("column") == ROWS)
        D.require_rows(
            rows.agg(
                F.coalesce(F.sum("reference_rows"), F.lit(0)).alias("reference"),
                F.coalesce(F.sum("current_rows"), F.lit(0)).alias("current"),
            ),
            s,
        )
        known = {r["column"] for r in counts.select("column").distinct().collect()}
        numerical, categorical = ([c for c in names if c in known] for names in (s.numerical, s.categorical))
        columns = D.verdicts(
            D.psi_from_counts(counts.where(F.col("column").isin(*numerical)), numerical) if numerical else None,
            D.chi2_from_counts(counts.where(F.col("column").isin(*categorical)), categorical, s.significance) if categorical else None,
            s,
        )
        return D.drift_report(spark, columns, s, bounds, as_of)
