"""Best-two-fit packing of token sequences.

A bin is filled greedily with the longest piece that still fits. If it is left
with a gap and holds more than one piece, its smallest piece makes room for the
two unpacked pieces that fill the widened gap best, when they fill it better.

Pieces of one length are interchangeable, so the rule runs on the counts of the
at most ``capacity`` lengths. A bin is repeated for as long as the counts allow
it, which gives the bins a run over single pieces would give, in a number of steps
that depends on the capacity and not on the number of documents. Only the counts
reach the driver; the plan that goes back is a few rows per kind of bin.

A piece takes its place in the plan by its rank among the pieces of its length.
Ranks are counted in parts (a hash of the document's id), so a length that a
third of all pieces have is spread over many tasks.

Cases: a null text is empty and gives a piece with the closing id alone. Rows with
null or repeated ids are packed like others. An empty table gives an empty result.
Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamwarden.llm.bpe import Vocabulary, encoded, vocabulary_path
from streamwarden.llm.columns import cut, documents, text_of

CAPACITY = 2048
CLOSING_ID = 0


def pieces(docs: DataFrame, *, capacity=CAPACITY, path=None, id_column="doc_id", text_column="text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut only where longer than ``capacity``."""
    vocabulary = Vocabulary.load(path or vocabulary_path())
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends in encoded(batches, vocabulary, 1, library=True):
            row, piece, start, length, crc = [], [], [], [], []
            begin = 0
            for number, end in enumerate(ends.tolist()):
                own = np.append(ids[begin:end], CLOSING_ID).astype("<u4")
                begin = end
                # the first piece takes what the whole pieces leave over
                first = (len(own) - 1) % capacity + 1
                marks = [0, *range(first, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False)):
                    row.append(number)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=names,
            )

    return rows.mapInArrow(cut_up, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def fill(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of bins: [(length, how many of it), ...] and the number of such bins.

    ``counts[n]`` is the number of pieces of length n, 1 <= n <= capacity.
    """
    counts = counts.astype(np.int64).copy()
    lengths = np.arange(capacity + 1)
    bins = []
    while counts.any():
        taken: dict[int, int] = {}
        gap = capacity
        longest = np.maximum.accumulate(np.where(counts > 0, lengths, 0))
        size = int(longest[gap])
        while size:
            many = min(int(counts[size]), gap // size)
            taken[size] = many
            gap -= many * size
            size = int(longest[min(gap, size - 1)])
        if gap and sum(taken.values()) > 1:
            _two_for_one(taken, counts, gap, lengths)
        kind = sorted(taken.items(), reverse=True)
        repeats = min(int(counts[n]) // many for n, many in kind)
        for n, many in kind:
            counts[n] -= many * repeats
        bins.append((kind, repeats))
    return bins


def _two_for_one(taken: dict[int, int], counts: np.ndarray, gap: int, lengths: np.ndarray) -> None:
    """Swap the smallest piece of ``taken`` for the two that fit its place best."""
    smallest = min(taken)
    room = gap + smallest
    left = counts.copy()
    for n, many in taken.items():
        left[n] -= many
    longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))
    one = np.flatnonzero(left[: room] > 0)
    two = longest[room - one]
    # the partner is not longer, and not the same single piece
    two = np.minimum(two, one)
    two = np.where(left[two] > 0, two, longest[two])
    alone = (two == one) & (left[one] < 2)
    two = np.where(alone, longest[np.maximum(one - 1, 0)], two)
    total = np.where(two > 0, one + two, 0)
    if not len(total) or total.max() <= smallest:
        return
    best = int(np.argmax(total))
    taken[smallest] -= 1
    if not taken[smallest]:
        del taken[smallest]
    for n in (int(one[best]), int(two[best])):
        taken[n] = taken.get(n, 0) + 1


class Plan:
    """Where the pieces of each length go, by their rank among that length."""

    SHIFT = 44  # ranks below 2 ** 44

    def __init__(self, bins: list[tuple[list[tuple[int, int]], int]], capacity: int):
        next_rank = np.zeros(capacity + 1, dtype=np.int64)
        rows = []
        sequence = 0
        for kind, repeats in bins:
            offset = 0
            for n, many in kind:
                rows.append((n << self.SHIFT | int(next_rank[n]), repeats, sequence, offset))
                next_rank[n] += many * repeats
                offset += many * n
            sequence += repeats
        self.sequences = sequence
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        self.first, self.repeats, self.sequence, self.offset = table.T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.first, length << self.SHIFT | rank, side="right") - 1
        inside = (length << self.SHIFT | rank) - self.first[at]
        slot, copy = np.divmod(inside, self.repeats[at])
        return self.sequence[at] + copy, self.offset[at] + slot * length


def pack(items: DataFrame, *, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """``items`` (with ``length``) with ``sequence_id`` and ``offset``."""
    spark = items.sparkSession
    items = cut(items)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, many in items.groupBy("length").count().collect():  # at most `capacity` rows
        counts[n] = many
    plan = Plan(fill(counts, capacity), capacity)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 64)
    own = [c for c in items.columns if c != "length"]
    parted = items.withColumn("part", F.pmod(F.xxhash64(*own), F.lit(parts)))
    order = Window.partitionBy("length", "part").orderBy(*own)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parted.groupBy("length", "part")
        .agg(F.count("*").alias("n"))
        .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    ranked = (
        parted.withColumn("within", F.row_number().over(order))
        .join(starts, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("within") - 1)
        .select(*items.columns, "rank")
    )
    length_at, rank_at = items.columns.index("length"), len(items.columns)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column(length_at).to_numpy(), batch.column(rank_at).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def op6_best_two_fit(spark, folder: str) -> DataFrame:
    return pack(pieces(documents(spark, folder)))
