"""Exact join of documents by the Jaccard similarity of their word shingles.

Jaccard distance is a metric, but almost all documents lie at distance 1 from almost
all others, where pivots taken from the documents tell nothing apart. The regions
of the first level are therefore drawn around single shingles: with one order of all
shingles (common ones last), two linked documents share a shingle within the first
``size - ceil(0.8 * size) + 1`` of both, so a document is replicated to the regions of
these and no link is lost. Inside a region distances are informative, and there the
metric join runs:

* the region's smallest document is its pivot, and every other one is compared with it;
* a region whose documents are one component is finished, and equal regions are
  joined once;
* the others offer the likeliest pair of each component, by which most of them meet;
* where components are still apart, the documents that may link are laid beside their whole
  sets and their region decides on them (``_linked_in_tasks``): pairs never leave the task, only
  links do that join components, fewer than the region has documents. A pair that is together
  in several regions is looked at in the first of them;
* regions are joined recursively: several pivots create Voronoi cells, a document is
  replicated to each cell whose pivot is at most twice the threshold farther than its
  nearest one (triangle inequality), cells are joined in the same way, and small
  or undivided ones are compared in blocks. Regions above ``REGION`` documents are
  divided by Spark jobs, smaller ones inside one task.

Similarity 0.8 means that at most (a + b) / 9 shingles are in just one of two sets of
sizes a and b. Distances inside regions are those of parity sketches: one bit per
bucket of shingle hashes, at least as many buckets as the set has members: unrelated sets then
differ in about half the buckets, linked ones in two ninths at most. Two
sketches differ in at most as many bits as there are such shingles, and differing
bits are a metric themselves, so windows lose nothing; what they let through is
then decided by the exact Jaccard similarity of the whole sets. Regions are split by
size so that their sketches have one length (a longer one folds to a shorter).

Documents with equal sets are one node (a 64-bit sum of their mixed shingle hashes;
for n sets two different ones meet with a chance of n * n / 2**65). The order of the
shingles comes from counts over all documents, which keep what repeats within a
window of ``WINDOW`` shingles and has at least 1 / ``COMMON`` of all shingles: at most
``COMMON`` rows by construction. The order never changes the result.

Cases: null and empty texts and those without words have no shingles and link with
nothing; fewer than five words are one shingle. Rows that repeat an id or a text are
rows of their own; ``component_id`` is the smallest id, null only if all are. Empty
tables give empty results; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamwarden.llm.columns import cut, documents, free_name, give_back, slices, text_of, written
from streamwarden.llm.links import components

WORDS = 5
PERCENT = 80  # least similarity
COMMON = 4_000_000
WINDOW = 2_000_000
SPREAD = 4096  # documents of a common shingle's region that share a task
WHOLE = -1  # part of a region that is not spread
REGION = 2048  # documents joined inside one task
LEAF = 256
AT_HAND = 1 << 18  # pairs of a region held before only the likeliest stay
FIRST_KEYS = 16  # regions of a document by which a pair's first common one is told
TOGETHER = 64  # documents of a region that is joined along with others
ROWS = 4_000
WORDS_AT_ONCE = 1 << 19  # of sketches, 8 bytes each
PIVOTS = 8
FEWEST_BITS = 64
SENT_TO_ALL = 200_000  # rows (id and hash) that a scan may be handed as a whole
SETS_AT_ONCE = 1 << 25  # bytes of sets laid beside each other before their regions are joined
SLICE = 1 << 20  # bytes of text hashed at once; working arrays are some 40 times that

U = np.uint64
STEP, BACK, GOLD = U(0x9E3779B97F4A7C15), None, U(0x9E3779B97F4A7C15)
BACK = U(pow(int(STEP), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=U) * GOLD)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]  # A-Z count as a-z
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True
# a short sequence differs from any shingle of full width
WIDTH_MARKS = np.arange(64, dtype=U) * GOLD
_powers = {int(STEP): np.ones(1, dtype=U), int(BACK): np.ones(1, dtype=U)}


def _power_table(base: np.uint64, size: int) -> np.ndarray:
    table = _powers[int(base)]
    if len(table) < size:
        table = np.full(max(size, 2 * len(table)), base, dtype=U)
        table[0] = 1
        table = _powers[int(base)] = np.multiply.accumulate(table)
    return table


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word of a byte array, all words at once."""
    blank = BLANK[data]
    change = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    values = BYTE_VALUES[data] * _power_table(STEP, len(data))[: len(data)]
    sums = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    raw = (sums[ends] - sums[starts]) * _power_table(BACK, len(data) + 1)[starts]
    return mixed(raw + (ends - starts).astype(U) * GOLD), starts


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    limits = np.cumsum([0, *(len(d) + 1 for d in data)])
    hashes, starts = word_hashes(np.frombuffer(b" ".join([*data, b""]), dtype=np.uint8))
    bounds = np.searchsorted(starts, limits)
    sets = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = hashes[begin:end]
        n = len(own)
        if not n:
            sets.append(own)
            continue
        width = min(words, n)
        found = np.zeros(n - width + 1, dtype=U)
        for k in range(width):
            found = found * STEP + own[k : n - width + 1 + k]
        sets.append(np.unique(mixed(found + WIDTH_MARKS[width])))
    return sets


def node_of(found: np.ndarray) -> int:
    """One number for a set, whatever order it is in."""
    return int(np.bitwise_xor.reduce(mixed(found + GOLD)) + np.add.reduce(mixed(found ^ GOLD), dtype=U)) & (1 << 63) - 1


def bits_for(size: int) -> int:
    """Buckets of a set's sketch: a power of two, at least its size."""
    return max(FEWEST_BITS, 1 << max(size - 1, 0).bit_length())


def sketch_of(found: np.ndarray) -> bytes:
    """For each bucket, whether an odd number of shingles falls into it."""
    bits = bits_for(len(found))
    odd = np.bincount((found & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """Rows of 64-bit words with ``bits`` bits each: halves of longer ones cancel out."""
    while sketches.shape[1] * 64 > bits:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def stacked(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches of any length as rows of one matrix."""
    out = np.zeros((len(sketches), bits // 64), dtype=U)
    sizes = np.array(list(map(len, sketches)))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join(sketches[i] for i in at), dtype=U).reshape(len(at), -1)
        out[at] = folded(rows, bits)
    return out


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


def _sets_of(batches: Iterator[pa.RecordBatch], text_at: int, words: int):
    for batch in slices(batches, SLICE):
        with np.errstate(over="ignore"):
            yield batch, shingle_sets(batch.column(text_at).to_pylist(), words)
    give_back()


def survey(rows: DataFrame, words: int) -> DataFrame:
    """Per row its id, text mark, node and size; besides, (shingle, many) of what
    repeats within a window of shingles."""
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, hash long, node long, size long, sketch binary, shingle long, many long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "hash", "node", "size", "sketch", "shingle", "many"]
        waiting: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0
        id_kind = None

        def repeated():
            values, counts = np.unique(np.concatenate(waiting), return_counts=True)
            values, counts = values[counts > 1].view(np.int64), counts[counts > 1]
            for a in range(0, len(values), 100_000):
                v, c = values[a : a + 100_000], counts[a : a + 100_000]
                none = pa.nulls(len(v), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(v), id_kind), none, none, none, pa.nulls(len(v), pa.binary()), pa.array(v), pa.array(c.astype(np.int64))],
                    names=names,
                )

        for batch, sets in _sets_of(batches, 2, words):
            id_kind = batch.column(0).type
            nodes = [node_of(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            sizes = pa.array(list(map(len, sets)), pa.int64())
            sketches = pa.array(list(map(sketch_of, sets)), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), sizes, sketches, none, none], names=names
            )
            for node, found in zip(nodes, sets, strict=True):
                if node not in seen:  # equal sets are one node
                    seen.add(node)
                    waiting.append(found)
                    held += len(found)
            if held > WINDOW:
                yield from repeated()
                waiting, held, seen = [], 0, set()
        if waiting:
            yield from repeated()

    return rows.mapInArrow(read, schema)


class Order:
    """Common shingles last; among equals the hash decides."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        by_hash = np.argsort(shingles)
        self.shingles, self.counts = shingles[by_hash], counts[by_hash]

    def prefix(self, found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a sorted set, and the count of each if common."""
        if not len(self.shingles):
            return found[:length], np.zeros(length, np.int64)
        at = np.minimum(np.searchsorted(self.shingles, found), len(self.shingles) - 1)
        common = self.shingles[at] == found
        rare = found[~common][:length]
        if len(rare) == length:
            return rare, np.zeros(length, np.int64)
        rest, counts = found[common], self.counts[at[common]]
        first = np.lexsort((rest, counts))[: length - len(rare)]
        return np.concatenate([rare, rest[first]]), np.concatenate([np.zeros(len(rare), np.int64), counts[first]])


def replicas(rows: DataFrame, order: Order, words: int, percent: int) -> DataFrame:
    """(key, node, size, part): each document in the regions of its first shingles; ``part`` is
    ``WHOLE`` where a region is not spread. What repeats from row to row stands last, as these are
    the most rows of the join."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets_of(batches, 2, words):
            keys, parts, nodes, sizes = [], [], [], []
            if len(seen) > 1_000_000:
                seen = set()
            for found in sets:
                node = node_of(found)
                if len(found) and node not in seen:
                    seen.add(node)
                    key, counts = order.prefix(found, prefix_length(len(found), percent))
                    several = counts // SPREAD + 1
                    keys.append(key)
                    parts.append(np.where(several > 1, node % several, WHOLE))
                    nodes.append(np.full(len(key), node, np.int64))
                    sizes.append(np.full(len(key), len(found), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.concatenate(nodes)),
                        pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(parts).astype(np.int32)),
                    ],
                    names=["key", "node", "size", "part"],
                )

    return rows.mapInArrow(deal, "key long, node long, size int, part int")


def with_pivots(dealt: DataFrame) -> DataFrame:
    """Regions of two nodes or more, streamed in order: each node with the smallest
    node of its region (of its part of the region, where the shingle is common)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the run that may go on: key, part, pivot, its size, last node, whether the pivot was sent
        last = None
        for batch in batches:
            key, node, size, part = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            opens = np.append(True, (np.diff(key) != 0) | (np.diff(part) != 0))
            same = np.append(False, np.diff(node) == 0) & ~opens
            goes_on = last is not None and last[0] == key[0] and last[1] == part[0]
            if goes_on:
                opens[0] = False
                same[0] = node[0] == last[4]
            key, part, node, size, opens = (x[~same] for x in (key, part, node, size, opens))
            if not len(key):
                continue
            run = np.cumsum(opens)  # 0: the run before this batch
            starts = np.flatnonzero(opens)
            pivot_nodes, pivot_sizes = node[starts], size[starts]
            if goes_on:
                pivot_nodes, pivot_sizes = np.append(last[2], pivot_nodes), np.append(last[3], pivot_sizes)
            else:
                run = run - 1
            pivot, pivot_size = pivot_nodes[run], pivot_sizes[run]
            several = ~opens
            spread = part != WHOLE
            sent = several | spread
            followed = np.append(several[1:], False)
            sent |= opens & followed
            extra = None
            if goes_on and run[0] == 0 and not last[5] and several[0]:
                extra = (last[0], last[2], last[3], last[2], last[3], last[6])
            columns = [key[sent], node[sent], size[sent], pivot[sent], pivot_size[sent], spread[sent]]
            if extra is not None:
                columns = [np.append(c, np.array([e], dtype=c.dtype)) for c, e in zip(columns, extra, strict=True)]
            end_run = run[-1]
            pivot_sent = bool(sent[starts[-1]]) if len(starts) and end_run == run[starts[-1]] else True
            last = (key[-1], part[-1], pivot[-1], pivot_size[-1], node[-1], pivot_sent, bool(spread[-1]))
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["key", "node", "size", "pivot", "pivot_size", "spread"]
                )

    return (
        dealt.repartition("key", "part")
        .sortWithinPartitions("key", "part", "node")
        .mapInArrow(stream, "key long, node long, size int, pivot long, pivot_size int, spread boolean")
    )


def sets_of(rows: DataFrame, places: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the given nodes, from a document that has the set."""
    one = places.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "hash")).alias("at"))
    one = cut(one.select(F.col("at.id").alias("own_id"), F.col("at.hash").alias("own_hash")))
    if one.count() <= SENT_TO_ALL:
        one = F.broadcast(one)
    texts = rows.join(one, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash")), "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets_of(batches, 2, words):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["node", "shingles"],
            )

    return texts.mapInArrow(read, "node long, shingles array<long>")


def most_apart(a, b, percent: int):
    """Most shingles that are in just one of two linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def screened(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible."""
    left = nodes.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size_a, sketch_a, size_b, sketch_b = (batch.column(n) for n in ("a", "b", "size_a", "sketch_a", "size_b", "sketch_b"))
            size_a, size_b = size_a.to_numpy(), size_b.to_numpy()
            apart = np.zeros(len(size_a), dtype=np.int64)
            bits = np.array([bits_for(min(m, n)) for m, n in zip(size_a.tolist(), size_b.tolist(), strict=True)], dtype=np.int64)
            for width in np.unique(bits):
                at = np.flatnonzero(bits == width)
                chosen = pa.array(at)
                x, y = (stacked(c.take(chosen).to_pylist(), int(width)) for c in (sketch_a, sketch_b))
                apart[at] = np.bitwise_count(x ^ y).sum(axis=1)
            possible = pa.array(apart <= most_apart(size_a, size_b, percent))
            yield pa.RecordBatch.from_arrays([a.filter(possible), b.filter(possible)], names=["a", "b"])

    near = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    joined = pairs.join(right, "b").join(left, "a").filter(near)
    return joined.select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(screen, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, places: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are linked by the exact similarity of their sets."""
    pairs = cut(pairs.distinct())
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(sets_of(rows, places, ends, words))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    counted = (
        pairs.join(right, "b").join(left, "a").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sizes"))
    )
    return counted.filter(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b").distinct()


def region_pairs(nodes, parts, sizes, sketches: np.ndarray, percent: int = PERCENT, leaf: int = LEAF, most: int | None = None):
    """``region_pair_array`` with its pairs as a list."""
    pairs, held_back = region_pair_array(nodes, parts, sizes, sketches, percent, leaf, most)
    return list(map(tuple, pairs.tolist())), held_back


def region_pair_array(
    nodes, parts, sizes, sketches: np.ndarray, percent: int = PERCENT, leaf: int = LEAF, most: int | None = None, each=None
) -> tuple[np.ndarray, bool]:
    """Pairs of one region's documents, of different components, that sizes and
    sketches leave possible; and whether any were held back.

    Each component but the largest offers its ``most`` likeliest pairs; the pairs are rows of
    an array. With ``each`` none are kept: it is called with the rows and the spare difference of
    some pairs at a time.
    """
    parts, sizes = np.asarray(parts), np.asarray(sizes)
    _, parts = np.unique(parts, return_inverse=True)
    largest = np.bincount(parts).argmax()
    found: list[np.ndarray] = []
    held_back = False

    def likeliest(pairs: np.ndarray) -> np.ndarray:
        """The first ``most`` pairs of each component, so that no more are ever at hand."""
        nonlocal held_back
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0], -pairs[2], parts[pairs[0]]))]
        owner = parts[pairs[0]]
        opens = np.flatnonzero(np.append(True, np.diff(owner) != 0))
        place = np.arange(len(owner)) - np.repeat(opens, np.diff(opens, append=len(owner)))
        held_back = held_back or bool((place >= most).any())
        return pairs[:, place < most]

    def compare(members: np.ndarray) -> None:
        """All but the largest component's own pairs."""
        small = members[parts[members] != largest]
        step = max(1, WORDS_AT_ONCE // max(1, len(members) * sketches.shape[1]))
        for start in range(0, len(small), step):
            own = small[start : start + step]
            apart = np.bitwise_count(sketches[own][:, None, :] ^ sketches[members][None, :, :]).sum(axis=2, dtype=np.int64)
            a, b = sizes[own][:, None], sizes[members][None, :]
            spare = most_apart(a, b, percent) - apart
            near = (spare >= 0) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)
            near &= parts[own][:, None] != parts[members][None, :]
            i, j = np.nonzero(near)
            if each is not None:
                each(own[i], members[j], spare[i, j])
                continue
            found.append(np.stack([own[i], members[j], spare[i, j]]))
            if most is not None and sum(f.shape[1] for f in found) > AT_HAND:
                found[:] = [likeliest(np.concatenate(found, axis=1))]

    def join(members: np.ndarray) -> None:
        if len(np.unique(parts[members])) < 2:
            return
        if len(members) <= leaf:
            compare(members)
            return
        pivots = members[:: max(1, len(members) // PIVOTS)][:PIVOTS]
        far = np.stack([np.bitwise_count(sketches[members] ^ sketches[p]).sum(axis=1, dtype=np.int64) for p in pivots], axis=1)
        widest = most_apart(sizes[members].max(), sizes[members].max(), percent)
        inside = far <= far.min(axis=1, keepdims=True) + 2 * widest
        cells = [members[inside[:, k]] for k in range(len(pivots))]
        if sum(map(len, cells)) > 2 * len(members) or max(map(len, cells)) > 0.9 * len(members):
            compare(members)
            return
        for cell in cells:
            join(cell)

    join(np.arange(len(sizes)))
    pairs = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
    if most is not None and pairs.shape[1]:
        pairs = likeliest(pairs)
    ends = np.unique(np.sort(pairs[:2], axis=0), axis=1)
    return np.asarray(nodes)[ends].T, held_back


def small_regions_pairs(start, nodes, parts, sizes, sketches: np.ndarray, percent: int, most: int | None):
    """The same for many small regions at once; ``start``: the first row of each.

    Returns first rows, second rows, and for each region whether it held any back.
    """
    end = np.append(start[1:], len(nodes))
    group = np.repeat(np.arange(len(start)), end - start)
    row = np.arange(len(nodes))
    later = end[group] - row - 1
    first = np.repeat(row, later)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
    worth = (parts[first] != parts[second]) & (
        np.minimum(sizes[first], sizes[second]) * 100 >= np.maximum(sizes[first], sizes[second]) * percent
    )
    first, second = first[worth], second[worth]
    spare = np.empty(len(first), np.int64)
    step = max(1, WORDS_AT_ONCE // sketches.shape[1])
    for at in range(0, len(first), step):
        i, j = first[at : at + step], second[at : at + step]
        spare[at : at + step] = most_apart(sizes[i], sizes[j], percent) - np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64)
    possible = spare >= 0
    first, second, spare = first[possible], second[possible], spare[possible]
    held_back = np.zeros(len(start), dtype=bool)
    if most is None or not len(first):
        return first, second, held_back
    # components of all regions, numbered; the largest of a region offers nothing
    order = np.lexsort((parts, group))
    fresh = np.append(True, (np.diff(parts[order]) != 0) | (np.diff(group[order]) != 0))
    number = np.empty(len(nodes), np.int64)
    number[order] = np.cumsum(fresh) - 1
    counts = np.bincount(number)
    home = group[order][fresh]
    by_size = np.lexsort((-counts, home))
    largest = np.zeros(len(counts), dtype=bool)
    largest[by_size[np.append(True, np.diff(home[by_size]) != 0)]] = True
    pair = np.concatenate([np.arange(len(first))] * 2)
    owner = np.concatenate([number[first], number[second]])
    offers = ~largest[owner]
    pair, owner = pair[offers], owner[offers]
    order = np.lexsort((pair, -spare[pair], owner))
    pair, owner = pair[order], owner[order]
    opens = np.flatnonzero(np.append(True, np.diff(owner) != 0))
    place = np.arange(len(owner)) - np.repeat(opens, np.diff(opens, append=len(owner)))
    kept = np.zeros(len(first), dtype=bool)
    kept[pair[place < most]] = True
    held_back[group[first[~kept]]] = True
    return first[kept], second[kept], held_back


def whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Pieces of about ``ROWS`` rows, or of ``SETS_AT_ONCE`` bytes, that end where a region ends."""
    held: list[pa.Table] = []
    rows = size = 0
    for batch in batches:
        for part in slices([batch], SLICE):
            held.append(pa.Table.from_batches([part]))
            rows, size = rows + part.num_rows, size + part.nbytes
            if rows < ROWS and size < SETS_AT_ONCE:
                continue
            whole = pa.concat_tables(held)
            key = whole.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield whole.slice(0, last)
            held = [whole.slice(last)]
            rows, size = whole.num_rows - last, held[0].nbytes
    if held:
        yield pa.concat_tables(held)


def _joined_in_tasks(members: DataFrame, nodes: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Possible pairs in regions of bounded size, and whether a region holds more back;
    ``members``: key, node, size, bits, component.

    Regions are streamed in order; small ones are joined many at once.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_regions(batches):
            key, node, size, bits, part = (table.column(c).to_numpy() for c in ("key", "node", "size", "bits", "component"))
            found_key, found_a, found_b, found_more = [], [], [], []

            def keep(keys, a, b, more):
                found_key.append(keys)
                found_a.append(a)
                found_b.append(b)
                found_more.append(more)

            for width in np.unique(bits):
                at = np.flatnonzero(bits == width)
                again = np.append(False, (np.diff(key[at]) == 0) & (np.diff(node[at]) == 0))
                at = at[~again]
                sketches = stacked(table.column("sketch").take(pa.array(at)).to_pylist(), int(width))
                k, n, z, c = key[at], node[at], size[at].astype(np.int64), part[at]
                opens = np.flatnonzero(np.append(True, np.diff(k) != 0))
                length = np.diff(opens, append=len(k))
                small = np.repeat(length <= TOGETHER, length)
                if small.any():
                    own = np.flatnonzero(small)
                    start = np.flatnonzero(np.append(True, np.diff(k[own]) != 0))
                    i, j, back = small_regions_pairs(start, n[own], c[own], z[own], sketches[own], percent, most)
                    region = np.searchsorted(start, i, side="right") - 1
                    keep(k[own][i], n[own][i], n[own][j], back[region])
                for o, m in zip(opens[length > TOGETHER].tolist(), length[length > TOGETHER].tolist(), strict=True):
                    pairs, back = region_pair_array(n[o : o + m], c[o : o + m], z[o : o + m], sketches[o : o + m], percent, most=most)
                    a, b = pairs.T
                    keep(np.full(len(a), k[o]), a, b, np.full(len(a), back))
            columns = [np.concatenate(x) for x in (found_key, found_a, found_b, found_more)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "a", "b", "more"])
        give_back()

    rows = members.select("key", "node", "size", "bits", "component").join(nodes.select("node", "sketch"), "node")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(join, "key long, a long, b long, more boolean")


def owned(first: np.ndarray, key: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the region is the first that the rows i and j have in common, as far as the first
    regions of each (rows of ``first``) tell: never False in the one that is."""
    out = np.ones(len(i), dtype=bool)
    earlier = first < key
    if not earlier.any():
        return out
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        same = (first[a][:, :, None] == first[b][:, None, :]) & earlier[a][:, :, None]
        out[at : at + (1 << 14)] = ~same.any(axis=(1, 2))
    return out


class Joined:
    """Union-find over the components of a region."""

    def __init__(self, parts: np.ndarray):
        _, self.of = np.unique(parts, return_inverse=True)
        self.up = list(range(int(self.of.max()) + 1))

    def root(self, row: int) -> int:
        x = int(self.of[row])
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self) -> np.ndarray:
        up = np.array(self.up)
        while (up[up] != up).any():
            up = up[up]
        return up[self.of]


def region_links(parts: np.ndarray, sets: list[np.ndarray], bits: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (rows of the region) that join its components, decided on whole sets, likeliest pairs
    first; those of documents that are joined by then are left out."""
    sizes = np.array(list(map(len, sets)))
    joined, links = Joined(parts), []

    def decide(i: np.ndarray, j: np.ndarray, spare: np.ndarray) -> None:
        roots = joined.roots()
        apart = roots[i] != roots[j]
        i, j, spare = i[apart], j[apart], spare[apart]
        order = np.argsort(-spare, kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            x, y = joined.root(a), joined.root(b)
            if x == y:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (sizes[a] + sizes[b] - both):
                joined.up[max(x, y)] = min(x, y)
                links.append((a, b))

    with np.errstate(over="ignore"):
        sketches = stacked(list(map(sketch_of, sets)), bits)
    region_pair_array(np.arange(len(sets)), parts, sizes, sketches, percent, each=decide)
    return links


def _linked_in_tasks(
    members: DataFrame, nodes: DataFrame, rows: DataFrame, places: DataFrame, words: int, percent: int
) -> DataFrame:
    """Links (a, b) between the components of regions of bounded size, as many as join all that
    are linked; ``members``: key, node, size, bits, component.

    First, sketches tell which documents of a region may link with one of another component there;
    a pair is looked at in the first of the regions it is in. Only these documents are then laid
    beside their whole sets, where their region decides. Both steps make fewer rows than they get.
    """

    def regions_of(table: pa.Table):
        """(key, bits, rows) of each region."""
        key, node, bits = (table.column(c).to_numpy() for c in ("key", "node", "bits"))
        for width in np.unique(bits):
            at = np.flatnonzero(bits == width)
            at = at[~np.append(False, (np.diff(key[at]) == 0) & (np.diff(node[at]) == 0))]
            opens = np.flatnonzero(np.append(True, np.diff(key[at]) != 0))
            for own in np.split(at, opens[1:]):
                yield int(key[own[0]]), int(width), own

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_regions(batches):
            node, size, part = (table.column(c).to_numpy() for c in ("node", "size", "component"))
            chosen = np.zeros(table.num_rows, dtype=bool)
            for key, width, own in regions_of(table):
                given = table.column("first").take(pa.array(own)).to_pylist()
                first = np.array([f + [key] * (FIRST_KEYS - len(f)) for f in given], dtype=np.int64)
                sketches = stacked(table.column("sketch").take(pa.array(own)).to_pylist(), width)
                may = np.zeros(len(own), dtype=bool)

                def mark(i: np.ndarray, j: np.ndarray, spare: np.ndarray, first=first, key=key, may=may) -> None:
                    fresh = ~(may[i] & may[j])
                    i, j = i[fresh], j[fresh]
                    mine = owned(first, key, i, j)
                    may[i[mine]] = may[j[mine]] = True

                region_pair_array(node[own], part[own], size[own].astype(np.int64), sketches, percent, each=mark)
                chosen[own[may]] = True
            yield from table.filter(pa.array(chosen)).select(["key", "node", "bits", "component"]).combine_chunks().to_batches()
        give_back()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_regions(batches):
            node, part = (table.column(c).to_numpy() for c in ("node", "component"))
            found: list[tuple[int, int]] = []
            for _, width, own in regions_of(table):
                held = table.column("shingles").take(pa.array(own)).combine_chunks()
                ends = held.offsets.to_numpy()
                whole = held.values.to_numpy().view(U)
                sets = [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                found += [(node[own[a]], node[own[b]]) for a, b in region_links(part[own], sets, width, percent)]
            a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        give_back()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = members.select("key", "node", "size", "bits", "component")
    first = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("first"))
    known = members.join(first, "node").join(nodes.select("node", "sketch"), "node")
    dealt = known.repartition(parts, "key").sortWithinPartitions("key", "node")
    chosen = written(dealt.mapInArrow(choose, "key long, node long, bits int, component long"))
    sets = sets_of(rows, places, chosen.select("node").distinct(), words).dropDuplicates(["node"])
    beside = chosen.join(sets, "node").repartition(parts, "key").sortWithinPartitions("key", "node")
    return beside.mapInArrow(decide, "a long, b long").distinct()


def _divided(members: DataFrame, nodes: DataFrame, percent: int, region: int) -> tuple[DataFrame, DataFrame]:
    """Possible pairs with the pivots of large regions, and the members of their cells.

    Pivots are taken by several hash minima, which are combined before the shuffle.
    A region that its cells do not divide is dealt into blocks; each pair of
    blocks is a region.
    """
    picks = [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = members.groupBy("key").agg(F.count("*").alias("n"), F.max("size").alias("largest"), *picks)
    pivots = pivots.select(
        "key", "n", "largest", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.node") for k in range(PIVOTS)]))).alias("a")
    )
    sketches = nodes.select("node", "sketch", F.col("size").alias("own_size"))
    pairs = (
        members.join(pivots, "key")
        .join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("own_size").alias("size_a")), "a")
        .join(sketches.select("node", "sketch"), "node")
        .select("key", "a", "node", "size", "bits", "n", "largest", "size_a", "sketch_a", "sketch")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy()
            apart = np.zeros(len(bits), dtype=np.int64)
            for width in np.unique(bits):
                at = np.flatnonzero(bits == width)
                chosen = pa.array(at)
                x, y = (stacked(batch.column(c).take(chosen).to_pylist(), int(width)) for c in ("sketch_a", "sketch"))
                apart[at] = np.bitwise_count(x ^ y).sum(axis=1)
            kept = [batch.column(c) for c in ("key", "a", "node", "size", "bits", "n", "largest", "size_a")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(apart)], names=["key", "a", "node", "size", "bits", "n", "largest", "size_a", "apart"]
            )

    far = written(
        pairs.mapInArrow(measure, "key long, a long, node long, size int, bits int, n long, largest int, size_a long, apart long")
    )
    linkable = F.col("apart") * (100 + percent) <= (F.col("size") + F.col("size_a")) * (100 - percent)
    near_pairs = far.filter(linkable & (F.col("a") != F.col("node"))).select("a", F.col("node").alias("b"))
    window = F.floor(2 * F.col("largest") * (100 - percent) / (100 + percent))
    near = far.groupBy("key", "node").agg(
        F.min("apart").alias("near"), F.max("n").alias("n"), F.max("size").alias("size"), F.max("bits").alias("bits")
    )
    inside = (
        far.join(near.select("key", "node", "near"), ["key", "node"])
        .filter(F.col("apart") <= F.col("near") + 2 * window)
        .select("key", "a", "node", "size", "bits", "n")
    )
    cells = inside.groupBy("key", "a").agg(F.count("*").alias("many"), F.max("n").alias("n"))
    divides = (F.sum("many") <= 2 * F.max("n")) & (F.max("many") <= 0.9 * F.max("n"))
    whole = cells.groupBy("key").agg(divides.alias("divides"), F.max("n").alias("n"))
    split = inside.join(whole.filter("divides").select("key"), "key").select(
        F.xxhash64("key", "a").alias("key"), "node", "size", "bits", F.lit(False).alias("final")
    )
    blocks = F.ceil(F.col("n") / max(1, region // 2))
    flat = (
        near.drop("n", "near")
        .join(whole.filter("NOT divides").select("key", "n"), "key")
        .withColumn("own", F.pmod(F.xxhash64(F.lit(-1), "node"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"), F.lit("block")).alias("key"),
            "node",
            "size",
            "bits",
            F.lit(True).alias("final"),
        )
    )
    return near_pairs, split.unionByName(flat)


def by_size(regions: DataFrame, percent: int) -> DataFrame:
    """Regions split by size: a document is in the one of its sketch's length, and
    where it can link with a smaller document of the next shorter length also there."""
    size = F.col("size")
    bits = F.greatest(F.lit(FEWEST_BITS), F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("int"))
    # sizes are whole numbers far below 2**52, where log2 of a power of two is exact
    shorter = (F.col("own_bits") > FEWEST_BITS) & (size * percent <= F.col("own_bits") / 2 * 100)
    places = F.when(shorter, F.array(F.col("own_bits"), (F.col("own_bits") / 2).cast("int"))).otherwise(F.array("own_bits"))
    return regions.withColumn("own_bits", bits).withColumn("bits", F.explode(places)).drop("own_bits")


def similar_groups(
    docs: DataFrame, *, id_column="doc_id", text_column="text", words=WORDS, percent=PERCENT, region=None
) -> DataFrame:
    """(id, hash, n_shingles, component, component_id) of every row."""
    region = REGION if region is None else region
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    first = written(survey(rows, words))
    places = first.filter("node IS NOT NULL").select("id", "hash", "node", "size")
    total = places.agg(F.sum("size")).first()[0] or 0
    least = max(4, -(-total // COMMON))
    common = (
        first.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("many").alias("many")).filter(F.col("many") >= least)
    ).toPandas()  # at most COMMON rows: their counts add up to the total at most
    order = Order(common["shingle"].to_numpy(np.int64).view(U), common["many"].to_numpy(np.int64))

    regions = written(with_pivots(replicas(rows, order, words, percent)))
    nodes = first.filter("size > 0").select("node", "size", "sketch").dropDuplicates(["node"])
    nodes = written(nodes.join(regions.select("node").distinct(), "node", "left_semi"))

    # every node and the smallest of its pivots; and the regions of just two nodes
    stars = regions.groupBy("node").agg(F.min("pivot").alias("a")).filter("node <> a").select("a", F.col("node").alias("b"))
    two = regions.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("spread").alias("spread"), F.max("node").alias("b"), F.min("node").alias("a"))
    stars = stars.unionByName(two.filter("n = 2 AND NOT spread").select("a", "b"))
    # the parts of a common shingle's region meet at the smallest of their pivots
    tops = regions.filter("spread").select("key", "pivot").distinct()
    lead = tops.groupBy("key").agg(F.min("pivot").alias("a"))
    stars = stars.unionByName(tops.join(lead, "key").filter("pivot <> a").select("a", F.col("pivot").alias("b"))).distinct()
    links = cut(verified(screened(stars, nodes, percent), rows, places, words, percent))
    larger = regions.join(two.filter("n > 2 OR spread").select("key"), "key", "left_semi")
    members = by_size(larger, percent).select(
        F.xxhash64("key", "bits").alias("key"),
        "node",
        "size",
        "bits",
        F.lit(False).alias("final"),
    )
    found = cut(components(links))
    many = links.count()
    first_time = True

    while True:
        # of equal regions one is joined
        different = (
            members.groupBy("key")
            .agg(
                F.count("*").alias("n"),
                F.bit_xor(F.xxhash64("node", "bits")).alias("x"),
                F.sum(F.hash("node", "bits").cast("long")).alias("s"),
                F.bool_or("final").alias("final"),
            )
            .filter("n > 1")
            .groupBy("n", "x", "s")
            .agg(F.min("key").alias("key"), F.bool_or("final").alias("last"))
        )
        held = members.select("key", "node", "size", "bits").join(different.select("key", "n", "last"), "key")
        held = held.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        held = written(held)
        # regions of one component are finished
        open_regions = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        held = held.join(open_regions.filter("low <> high").select("key"), "key")
        small = (F.col("n") <= region) | F.col("last")
        columns = ["key", "node", "size", "bits"]
        large = held.filter(~small).select(*columns)
        others = rest = None
        if not large.isEmpty():
            others, rest = _divided(large, nodes, percent, region)
        if first_time:
            # likeliest pairs first: most components meet by them
            possible = cut(_joined_in_tasks(held.filter(small), nodes, percent, 1))
            pending = held.join(possible.filter("more").select("key").distinct(), "key", "left_semi")
            pending = pending.select(*columns, F.col("last").alias("final"))
            rest = pending if rest is None else rest.unionByName(pending)
            pairs = possible.select("a", "b")
            fresh = verified(pairs if others is None else pairs.unionByName(others), rows, places, words, percent)
        else:
            fresh = _linked_in_tasks(held.filter(small), nodes, rows, places, words, percent)
            if others is not None:
                fresh = fresh.unionByName(verified(others, rows, places, words, percent))
        links = cut(links.unionByName(fresh).distinct())
        before, many = many, links.count()
        if many > before:
            found = cut(components(links))
        first_time = False
        if rest is None:
            break
        members = written(rest)
        if members.isEmpty():
            break

    placed = places.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # without shingles a row is alone
    placed = placed.withColumn("component", F.when(F.col("size") > 0, F.col("component")))
    smallest = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("lowest"))
    return placed.join(smallest, "component", "left").select(
        "id",
        "hash",
        F.col("size").alias("n_shingles"),
        "component",
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("component_id"),
    )


def keep_one(docs: DataFrame, *, id_column="doc_id", text_column="text", **options) -> DataFrame:
    """``docs`` with one row of each group of similar texts, the one with the smallest
    id; rows without shingles stay. Same columns."""
    own_id, own_hash = free_name(docs, "id_of_row"), free_name(docs, "hash_of_text")
    known = docs.withColumns({own_id: F.col(id_column), own_hash: F.xxhash64(text_of(text_column))})
    groups = similar_groups(docs, id_column=id_column, text_column=text_column, **options)
    alone = groups.filter("component IS NULL").select("id", "hash").distinct()
    lowest = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "hash")).alias("at")
    kept = groups.filter("component IS NOT NULL").groupBy("component").agg(lowest).select("at.id", "at.hash")

    def among(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("id").alias("kept_id"), F.col("hash").alias("kept_hash"))
        return known.join(rows, known[own_id].eqNullSafe(rows["kept_id"]) & (known[own_hash] == rows["kept_hash"]), "left_semi")

    # rows that repeat id and text are one group member that is there several times
    return among(alone).unionByName(among(kept).dropDuplicates([own_id, own_hash])).drop(own_id, own_hash)


def op10_jaccard_join(spark, folder: str) -> DataFrame:
    return similar_groups(documents(spark, folder)).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
