"""Whitening of embeddings with a covariance weighted by multiplicity.

Components become whole numbers (a scaled floor plus a shift), and equal vectors are
one row with a count. The covariance is a weighted matrix product over the distinct
vectors, centred before it is multiplied: every task adds up ``(w * c).T @ c`` over
blocks of rows, and the entries of these partial products are added by an aggregate,
so d * d numbers reach the driver, however many rows or tasks there are. Each distinct
vector is whitened once and the result is joined back to the rows by the vector itself.

Centring is exact up to one rounding: sums are decimals of 38 digits, and a mean S / n is
split into its whole part, which is subtracted from the whole component, and its fraction.
``deviation``, the sum over dimensions of (n * x - S) ** 2, is worked out in 64-bit integers
where a bound shows that they suffice, else in Python's integers.

Cases: a vector that is null or holds null or non-finite entries takes no part; other
vectors all do, whatever their size (a scaled component beyond 64 bits is held at the
64-bit limit). Vectors of one length are whitened among themselves; empty vectors have no
components. Repeated rows and repeated or null ids count each by itself. Directions
without variance cannot be scaled to 1 and have no row: one row alone, or a table
of equal vectors, gives an empty result, and so does an empty table. A
``deviation`` beyond 64 bits is null. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamwarden.llm.columns import written

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
BLOCK = 4096  # vectors multiplied at a time
LIMIT = (1 << 63) - 1


@dataclass(frozen=True)
class Axes:
    """What tasks need to whiten vectors of one length."""

    n: int
    sums: list[int]
    basis: np.ndarray  # length x components, each column divided by sqrt(eigenvalue)
    explained: list[float]


def whole_vectors(rows: DataFrame, vector: str, keep: tuple[str, ...], scale=SCALE, shift=SHIFT) -> DataFrame:
    """(row, x): the kept columns and the whole components of the rows that take part."""
    finite = F.forall(
        vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    )
    # floor holds values beyond 64 bits at the limit
    x = F.transform(
        vector, lambda c: F.least(F.floor(c.cast("double") * float(scale)), F.lit(LIMIT - shift)) + F.lit(shift)
    )
    return rows.filter(F.col(vector).isNotNull() & finite).select(F.struct(*keep).alias("row"), x.alias("x"))


def _blocks(batch: pa.RecordBatch, name: str, kind) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) for the vectors of each length, a block at a time."""
    column = batch.column(batch.schema.get_field_index(name))
    ends = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    for length in np.unique(size[size > 0]).tolist():
        chosen = np.flatnonzero(size == length)
        for start in range(0, len(chosen), BLOCK):
            rows = chosen[start : start + BLOCK]
            yield length, rows, flat[ends[rows][:, None] + np.arange(length)].astype(kind, copy=False)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the mean's whole part in whole numbers, then its fraction."""
    whole = [s // n for s in sums]
    rest = np.array([(s - q * n) / n for s, q in zip(sums, whole, strict=True)])
    apart = np.array(whole, dtype=np.int64)
    if _size(x, apart) < 1 << 62:
        return (x - apart).astype(np.float64) - rest
    return (x.astype(object) - apart.astype(object)).astype(np.float64) - rest


def _size(x: np.ndarray, y: np.ndarray) -> int:
    """A bound of the size of x - y."""
    sizes = [max(abs(int(v.min())), abs(int(v.max()))) for v in (x, y) if v.size]
    return sum(sizes)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2 of each row, exactly."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64)  # n * x - S = n * (x - whole) - rest
    if _size(x, whole) < 1 << 62:
        apart = x - whole
        if (n * (int(np.abs(apart).max()) + 1)) ** 2 * x.shape[1] < LIMIT:
            apart = apart * n - rest
            return (apart * apart).sum(axis=1).tolist()
    # far beyond the limit a rounded value tells; the others are worked out in whole numbers
    rough = ((_centred(x, n, sums) * n) ** 2).sum(axis=1)
    exact = [
        sum((n * v - s) ** 2 for v, s in zip(row.tolist(), sums, strict=True)) if about < 1e19 else LIMIT + 1
        for row, about in zip(x, rough, strict=True)
    ]
    return [v if v <= LIMIT else None for v in exact]


def _products(rows: DataFrame, name: str, kind, centre) -> dict[int, np.ndarray]:
    """For each length, the sum over rows of w * c c', c being ``centre(length, vectors)``.

    A task hands on one matrix per length; the matrices are added entry by entry.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column(1).to_numpy().astype(np.float64)
            for length, numbers, x in _blocks(batch, name, kind):
                c = centre(length, x)
                part = (weight[numbers, None] * c).T @ c
                total[length] = total[length] + part if length in total else part
        lengths = list(total)
        entries = [total[length].ravel() for length in lengths]
        yield pa.RecordBatch.from_arrays(
            [pa.array(lengths, pa.int32()), pa.array(entries, pa.list_(pa.float64()))], names=["length", "entries"]
        )

    partial = rows.select(name, "w").mapInArrow(multiply, "length int, entries array<double>")
    entries = (
        partial.select("length", F.posexplode("entries").alias("place", "entry"))
        .groupBy("length", "place")
        .agg(F.sum("entry").alias("entry"))
        .toPandas()
    )
    found = {}
    for length, group in entries.sort_values("place").groupby("length"):
        side = round(len(group) ** 0.5)
        found[int(length)] = group["entry"].to_numpy().reshape(side, side)
    return found


def axes(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Axes]:
    """Mean, scaled eigenvectors and explained shares for each length of vector."""
    counts = {r.length: r.n for r in distinct.groupBy(F.size("x").alias("length")).agg(F.sum("w").alias("n")).collect()}
    sums: dict[int, list[int]] = {length: [0] * length for length in counts}
    weighted = F.col("v").cast("decimal(20,0)") * F.col("w").cast("decimal(18,0)")
    for r in (
        distinct.select(F.size("x").alias("length"), "w", F.posexplode("x").alias("place", "v"))
        .groupBy("length", "place")
        .agg(F.sum(weighted.cast("decimal(38,0)")).alias("s"))
        .collect()
    ):
        sums[r.length][r.place] = int(r.s)
    products = _products(distinct, "x", np.int64, lambda length, x: _centred(x, counts[length], sums[length]))
    found = {}
    for length, product in products.items():
        variance, vectors = np.linalg.eigh((product + product.T) / (2 * counts[length]))
        order = np.argsort(-variance, kind="stable")[:components]
        trace = float(variance.sum())
        # below this a direction has no variance but rounding
        order = [k for k in order if variance[k] > length * np.finfo(float).eps * variance[-1]]
        found[length] = Axes(
            counts[length],
            sums[length],
            vectors[:, order] / np.sqrt(variance[order]),
            (variance[order] / trace).tolist(),
        )
    return found


def whiten(
    rows: DataFrame, *, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS
) -> DataFrame:
    """The kept columns of rows that take part, with ``deviation``, ``whitened``, ``n``, ``explained``
    and ``identity_error``; ``whitened`` and ``explained`` are arrays over the components."""
    used = whole_vectors(rows, vector, keep)
    distinct = written(used.groupBy("x").agg(F.count("*").alias("w")))
    found = axes(distinct, components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, numbers, x in _blocks(batch, "x", np.int64):
                own = found[length]
                values = _centred(x, own.n, own.sums) @ own.basis
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(numbers)),
                        batch.column(1).take(pa.array(numbers)),
                        pa.array(_deviation(x, own.n, own.sums), pa.int64()),
                        pa.array(list(values), pa.list_(pa.float64())),
                    ],
                    names=["x", "w", "deviation", "whitened"],
                )

    once = written(
        distinct.mapInArrow(apply, "x array<long>, w long, deviation long, whitened array<double>")
        .filter(F.size("whitened") > 0)
        .select("*", F.size("x").alias("length"))
    )
    errors = _identity_errors(once, found)
    facts = F.lit(None).cast("struct<n:long,explained:array<double>,identity_error:double>")
    for length, own in found.items():
        fact = F.struct(
            F.lit(own.n).cast("long").alias("n"),
            F.array(*[F.lit(float(v)) for v in own.explained]).cast("array<double>").alias("explained"),
            F.lit(errors.get(length)).cast("double").alias("identity_error"),
        )
        facts = F.when(F.col("length") == length, fact).otherwise(facts)
    once = once.select("x", "deviation", "whitened", facts.alias("facts"))
    return used.join(once, "x").select("row.*", "deviation", "whitened", "facts.*")


def _identity_errors(once: DataFrame, found: dict[int, Axes]) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance minus the identity, for each length."""
    by_width: dict[int, float] = {}
    for length, own in found.items():
        some = once.filter(F.col("length") == length)
        mean = np.zeros(own.basis.shape[1])
        for r in (
            some.select("w", F.posexplode("whitened").alias("place", "v"))
            .groupBy("place")
            .agg((F.sum(F.col("v") * F.col("w")) / own.n).alias("m"))
            .collect()
        ):
            mean[r.place] = r.m
        product = _products(some, "whitened", np.float64, lambda _, y, mean=mean: y - mean)
        for covariance in product.values():
            by_width[length] = float(np.abs(covariance / own.n - np.eye(len(covariance))).max())
    return by_width


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet")
    return whiten(rows).select(
        "vec_id",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "part"),
        "n",
        "deviation",
        "identity_error",
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "part.whitened",
        "part.explained",
        "identity_error",
    )
