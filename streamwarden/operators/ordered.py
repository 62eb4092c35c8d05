"""Exact order statistics and running totals over columns of any size."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from streamwarden.functions.binding import computed_once
from streamwarden.session import cut

SKETCH_ACCURACY = 10000


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Add ``<measure>_through`` (running sum) and ``next_value`` (the following first order value).

    A plain window would sort a whole group in one task. Here rows are
    range-partitioned by (group, order); each partition sums on its own and
    starts from the total of the partitions before it. Those totals are one
    row per partition and group met there, so they are broadcast.
    """
    spread = df.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id())
    ranged = cut(spread)
    keys = ["part", *group]
    first = order[0]
    sums = ranged.groupBy(*keys).agg(
        F.min(first).alias("_first"), *[F.sum(m).alias(f"_total_{m}") for m in measures]
    )
    across = Window.partitionBy(*group).orderBy("part")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *keys,
        F.lead("_first").over(across).alias("_next_part"),
        *[F.coalesce(F.sum(f"_total_{m}").over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures],
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    through = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(F.broadcast(starts), keys)
    return joined.select(
        *df.columns,
        F.coalesce(F.lead(first).over(inside), "_next_part").alias("next_value"),
        *[(F.sum(m).over(through) + F.col(f"_before_{m}")).alias(f"{m}_through") for m in measures],
    )


def cells(df: DataFrame, columns: Sequence[str], of_value, keep: Sequence[str] = ()) -> DataFrame:
    """(column, value, *fields) rows of numeric columns without NULL and NaN.

    ``of_value(name, value)`` gives the further fields of a column's cells. Numbers are taken
    once, behind a generator, so that fields are plain conditions on them, which Spark compiles;
    so it does an unpivot, but not an array whose empty places are taken out for every row.
    """
    typed = computed_once(df, *[number(c).alias(f"_n{k}") for k, c in enumerate(columns)], keep=list(keep))
    made = []
    for k, name in enumerate(columns):
        value = F.col(f"_n{k}")
        fields = [c.alias(n) for n, c in of_value(name, value).items()]
        cell = F.struct(F.lit(name).alias("column"), value.alias("value"), *fields)
        made.append(F.when(value.isNotNull(), cell).alias(f"_c{k}"))
    places = [f"_c{k}" for k in range(len(made))]
    found = typed.select(*keep, *made).unpivot(list(keep), places, "_place", "_cell")
    return found.where(F.col("_cell").isNotNull()).select(*keep, "_cell.*")


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return cells(df, columns, lambda name, value: {}, keep)


def number(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Linearly interpolated quantiles, exact, as one short list per column."""
    rows = df.withColumns({"in_reference": F.lit(True), "in_current": F.lit(False)})
    return quantile_counts(rows, columns, probs)[0]


def quantile_counts(rows: DataFrame, columns: Sequence[str], probs: Sequence[float], apart: int = 0):
    """(quantiles of the reference, counts, columns counted by value): two scans of rows with ``in_reference`` and ``in_current``.

    Quantiles are exact and linearly interpolated, a short list for each column with reference
    values. A sketch first brackets every wanted rank. The second scan keeps only the values
    inside the brackets apart; everything between two brackets collapses into one count before
    the shuffle. Counts are (column, value, gap, reference_rows, current_rows): gap 0 for
    values kept apart, 1 for those between ``value`` and the next bracket, -1 below all.
    A column is counted value by value, in a third scan, where a sketch was off or two
    neighbours of a quantile lie in different brackets; and at once where its sketch has fewer
    than ``apart`` different values. So no quantile ever lies within a collapsed range.
    """
    if not columns:
        return {}, None, set()
    slack = 2.0 / SKETCH_ACCURACY
    cuts = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-slack, slack)})
    aggregates = []
    for c in columns:
        value = F.when(F.col("in_reference"), number(c))
        aggregates += [
            F.count(value).alias(f"n_{c}"),
            F.min(value).alias(f"lo_{c}"),
            F.max(value).alias(f"hi_{c}"),
            F.percentile_approx(value, [float(x) for x in cuts], SKETCH_ACCURACY).alias(f"cut_{c}"),
        ]
    sketch = rows.agg(*aggregates).first().asDict()  # one row of columns x probabilities
    sizes = {c: sketch[f"n_{c}"] for c in columns if sketch[f"n_{c}"]}
    if not sizes:
        return {}, None, set()
    brackets = {c: _brackets(sketch, c, cuts, probs, slack) if len(set(sketch[f"cut_{c}"])) >= apart else None for c in sizes}
    wanted = {c: _ranks(n, probs) for c, n in sizes.items()}
    counted = cut(_counts(rows, brackets))
    found = _values_at(counted, wanted)
    missed = [c for c in sizes if brackets[c] is not None and not _settled(found[c], brackets[c], sizes[c], probs)]
    if missed:
        again = cut(_counts(rows, {c: None for c in missed}))
        found.update(_values_at(again, {c: wanted[c] for c in missed}))
        counted = counted.where(~F.col("column").isin(*missed)).unionByName(again)
    whole = {c for c in sizes if brackets[c] is None} | set(missed)
    return {c: [_interpolated(found[c], n, p) for p in probs] for c, n in sizes.items()}, counted, whole


def quantiles_of_counts(counts: DataFrame, columns: Sequence[str], probs: Sequence[float]):
    """(quantiles, counts with ``gap``) of rows that are counted by value already: no sketch is needed."""
    counted = cut(counts.select("column", "value", F.lit(0).alias("gap"), "reference_rows", "current_rows"))
    sizes = {
        r["column"]: r.n
        for r in counted.groupBy("column").agg(F.sum("reference_rows").alias("n")).collect()
        if r.n and r["column"] in columns
    }
    if not sizes:
        return {}, counted
    found = _values_at(counted, {c: _ranks(n, probs) for c, n in sizes.items()})
    return {c: [_interpolated(found[c], n, p) for p in probs] for c, n in sizes.items()}, counted


def _settled(found: dict[int, float], spans: list[tuple[float, float]], n: int, probs) -> bool:
    """Whether both neighbours of each quantile are there and lie in one bracket."""
    for p in probs:
        k = int(p * (n - 1))
        pair = [found.get(k), found.get(min(k + 1, n - 1))]
        if None in pair or not any(low <= pair[0] and pair[1] <= high for low, high in spans):
            return False
    return True


def _brackets(sketch: dict, c: str, cuts: list[float], probs, slack: float) -> list[tuple[float, float]]:
    at = dict(zip(cuts, sketch[f"cut_{c}"]))
    at[0.0], at[1.0] = sketch[f"lo_{c}"], sketch[f"hi_{c}"]
    spans = []
    for p in probs:
        low, high = at[min(max(p - slack, 0.0), 1.0)], at[min(max(p + slack, 0.0), 1.0)]
        spans.append((low, max(low, high)))
    merged: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _ranks(n: int, probs) -> list[int]:
    return sorted({r for p in probs for r in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))})


def _interpolated(at: dict[int, float], n: int, p: float) -> float:
    position = p * (n - 1)
    low = int(position)
    a, b = at[low], at[min(low + 1, n - 1)]
    t = position - low
    if a == b:
        return a
    return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)


def _counts(rows: DataFrame, brackets: dict) -> DataFrame:
    """Rows of both windows for each column and value, collapsed between brackets."""

    def kept_or_collapsed(name: str, value: Column) -> dict[str, Column]:
        spans = brackets[name]
        if spans is None:
            return {"v": value, "gap": F.lit(0)}
        v, gap = F.when(value < spans[0][0], spans[0][0]), F.when(value < spans[0][0], -1)
        for (low, high), after in zip(spans, [*spans[1:], None]):
            v, gap = v.when(value <= high, value), gap.when(value <= high, 0)
            if after is not None:
                v, gap = v.when(value < after[0], high), gap.when(value < after[0], 1)
        return {"v": v.otherwise(spans[-1][1]), "gap": gap.otherwise(1)}

    return (
        cells(rows, list(brackets), kept_or_collapsed, ["in_reference", "in_current"])
        .groupBy("column", F.col("v").alias("value"), "gap")
        .agg(F.count_if("in_reference").alias("reference_rows"), F.count_if("in_current").alias("current_rows"))
    )


def _values_at(counted: DataFrame, wanted: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    names = list(wanted)
    held = counted.where(F.col("column").isin(*names) & (F.col("reference_rows") > 0))
    totals = running_totals(held.withColumnRenamed("reference_rows", "n"), ["column"], ["value", "gap"], ["n"])
    asked = counted.sparkSession.createDataFrame([(c, wanted[c]) for c in names], "column string, ranks array<long>")
    hit = F.filter("ranks", lambda k: (k < F.col("n_through")) & (k >= F.col("n_through") - F.col("n")))
    rows = (
        totals.where(F.col("gap") == 0)
        .join(F.broadcast(asked), "column")  # one row per column
        .select("column", "value", hit.alias("ranks"))
        .where(F.size("ranks") > 0)
    )
    found: dict[str, dict[int, float]] = {c: {} for c in names}
    for row in rows.collect():  # at most two rows per column and probability
        found[row["column"]].update({k: row["value"] for k in row["ranks"]})
    return found
