"""Exact duplicates by composable polynomial fingerprints.

A text is cut into chunks; each chunk has the value of its bytes as a polynomial
at a fixed point, modulo a prime. The value of two neighbouring pieces follows
from theirs: ``value(a + b) = value(a) * point ** len(b) + value(b)``, so chunks of
a huge text are worked out apart from each other and put together afterwards.
Two primes of 31 bits and the length make up a fingerprint.

Equal fingerprints are a proposal only. Every member of a group is compared with
the group's first row chunk by chunk, in a join that never holds more than one
chunk of either text, and what differs forms groups of its own until nothing
differs. Only fingerprints and the texts of proposed copies are shuffled; the
chunks of a first row are repeated once for about ``SHARE`` members, which are dealt
by a hash of id and text, so a hot group is spread over many tasks. The chunks of
one text are worked out one after another in one task.

Cases: a null text is empty and equal to other empty ones. Rows with a null id or
with an id that is used twice take part as rows of their own; the row with the
smallest id stays (null last), and of rows that share that id just one stays. An empty table
gives an empty result. Other columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamwarden.llm.columns import cut, documents, free_name, slices, text_of

PRIMES = (2_147_483_647, 2_147_483_629)
POINTS = (1_103_515_245, 1_812_433_253)
CHUNK = 1 << 16  # bytes; a chunk's sum of products stays below 2**63
SHARE = 256  # members that share one copy of their first row's chunks


def normalised(text: str) -> bytes:
    """``text`` in UTF-8, each run of ASCII white space replaced by one space."""
    for blank in "\t\n\v\f\r":
        if blank in text:
            text = text.replace(blank, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.encode("utf-8", "surrogatepass")


@lru_cache(maxsize=8)
def _powers(point: int, prime: int) -> np.ndarray:
    """point ** 0 ... point ** CHUNK, by doubling."""
    powers = np.ones(1, dtype=np.int64)
    while len(powers) <= CHUNK:
        step = pow(point, len(powers), prime)
        powers = np.concatenate([powers, powers * step % prime])
    return powers[: CHUNK + 1]


def chunk_values(data: bytes, primes=PRIMES, points=POINTS) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Length and value of each chunk of ``data``."""
    flat = np.frombuffer(data, dtype=np.uint8)
    for start in range(0, len(flat), CHUNK):
        piece = flat[start : start + CHUNK].astype(np.int64)
        size = len(piece)
        yield size, tuple(
            int(np.dot(piece, _powers(x, p)[size - 1 :: -1])) % p
            for x, p in zip(points, primes, strict=True)
        )


def join_values(left, right, primes=PRIMES, points=POINTS):
    """(length, values) of two pieces put together."""
    size = right[0]
    return left[0] + size, tuple(
        (a * pow(x, size, p) + b) % p for a, b, x, p in zip(left[1], right[1], points, primes, strict=True)
    )


def fingerprint(data: bytes, primes=PRIMES, points=POINTS) -> tuple[int, tuple[int, ...]]:
    whole = (0, (0,) * len(primes))
    for piece in chunk_values(data, primes, points):
        whole = join_values(whole, piece, primes, points)
    return whole


def exact_groups(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", primes=PRIMES) -> DataFrame:
    """One row per distinct (id, text) of ``docs``: its mark ``hash``, ``times`` it
    occurs, ``keep_id`` and ``is_first`` (it is the row that stays), ``group_size``
    in rows, and ``digest``, the SHA-256 of the normalised text.

    ``primes`` is for tests: small ones make different texts collide.
    """
    rows = _rows(docs, id_column, text_column)
    id_type = rows.schema["id"].dataType.simpleString()

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, sizes, digests = [], [], []
            for text in batch.column(2).to_pylist():
                data = normalised(text)
                size, (a, b) = fingerprint(data, primes)
                values.append(a << 31 | b)
                sizes.append(size)
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(values, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                names=["id", "hash", "mark", "size", "digest"],
            )

    marked = cut(
        rows.mapInArrow(marks, f"id {id_type}, hash long, mark long, size long, digest string")
        .groupBy("id", "hash", "mark", "size", "digest")
        .agg(F.count("*").alias("times"))
    )
    # the smallest id, null last
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "hash")).alias("first")

    # (mark, size, part) is a group; part tells apart what collided in an earlier round
    grouped = marked.withColumn("part", F.lit(0))
    settled = None
    while True:
        place = ["mark", "size", "part"]
        groups = grouped.groupBy(*place).agg(first, F.count("*").alias("n"))
        placed = cut(
            grouped.join(groups, place).select(
                grouped["*"],
                F.col("first.id").alias("keep_id"),
                F.col("first.hash").alias("keep_hash"),
                (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash"))).alias("is_first"),
                "n",
            )
        )
        other = _differing(rows, placed)
        checked = cut(_same_row(placed, other, "left").withColumn("differs", F.coalesce("differs", F.lit(False))))
        agreed = checked.filter("NOT differs")
        settled = agreed if settled is None else settled.unionByName(agreed)
        rest = checked.filter("differs")
        if rest.isEmpty():
            break
        grouped = rest.select("id", "hash", "mark", "size", "digest", "times", (F.col("part") + 1).alias("part"))
    settled = settled.drop("n", "differs")
    sizes = settled.groupBy("mark", "size", "part").agg(F.sum("times").alias("group_size"))
    return settled.join(sizes, ["mark", "size", "part"])


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, hash, text): a row is known by its id and a hash of its text, so that
    it is found again however a later scan deals the rows out."""
    text = text_of(text_column)
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _same_row(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({"id": "right_id", "hash": "right_hash"})
    on = left["id"].eqNullSafe(right["right_id"]) & (left["hash"] == right["right_hash"])
    joined = left.join(right, on, how)
    return joined if how == "left_semi" else joined.drop("right_id", "right_hash")


def _pieces(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The chunks of all rows in groups of several, each with its ``share``."""
    group = ["mark", "size", "part"]
    shares = F.ceil(F.col("n") / SHARE)
    own_share = F.pmod(F.xxhash64("id", "hash"), shares).alias("own_share")
    copies = placed.filter("n > 1").select("id", "hash", *group, shares.alias("shares"), own_share, "is_first")
    id_type = placed.schema["id"].dataType.simpleString()
    names = ["id", "hash", *group, "share", "chunk", "bytes", "is_first"]
    schema = f"id {id_type}, hash long, mark long, size long, part int, share long, chunk int, bytes binary, is_first boolean"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found):
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        found, size = [], 0
        types = None
        for batch in slices(batches):
            if types is None:
                long = pa.int64()
                types = [batch.schema.field("id").type, long, long, long, pa.int32(), long, pa.int32(), pa.binary(), pa.bool_()]
            for own_id, own_hash, *place, shares, own_share, is_first, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = normalised(text)
                # a first row's chunks go to every share of its members
                for share in range(shares) if is_first else (own_share,):
                    for number, start in enumerate(range(0, max(len(data), 1), CHUNK)):
                        piece = data[start : start + CHUNK]
                        found.append((own_id, own_hash, *place, share, number, piece, is_first))
                        size += len(piece)
                        if size > 8 << 20 or len(found) >= 10_000:
                            yield batch_of(found)
                            found, size = [], 0
        if found:
            yield batch_of(found)

    return (
        _same_row(copies, rows)
        .select("id", "hash", *group, "shares", "own_share", "is_first", "text")
        .mapInArrow(chunks, schema)
    )


def _differing(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, hash, differs) of the rows that are not the first of their group."""
    group = ["mark", "size", "part"]
    pieces = _pieces(rows, placed)
    place = [*group, "share", "chunk"]
    own = pieces.filter("NOT is_first").drop("is_first")
    model = pieces.filter("is_first").select(*place, F.col("bytes").alias("first_bytes"))
    # the sizes are equal, so both sides have as many chunks
    return own.join(model, place).groupBy("id", "hash").agg(F.bool_or(F.col("bytes") != F.col("first_bytes")).alias("differs"))


def keep_first(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows whose text an earlier row has; same columns."""
    own_id, own_hash = free_name(docs, "id_of_row"), free_name(docs, "hash_of_text")
    known = docs.withColumns({own_id: F.col(id_column), own_hash: F.xxhash64(text_of(text_column))})
    first = exact_groups(docs, id_column=id_column, text_column=text_column).filter("is_first")

    def among(firsts: DataFrame) -> DataFrame:
        firsts = firsts.select(F.col("id").alias("first_id"), F.col("hash").alias("first_hash"))
        on = known[own_id].eqNullSafe(firsts["first_id"]) & (known[own_hash] == firsts["first_hash"])
        return known.join(firsts, on, "left_semi")

    once = among(first.filter("times = 1"))
    repeated = among(first.filter("times > 1")).dropDuplicates([own_id, own_hash])
    return once.unionByName(repeated).drop(own_id, own_hash)


def op2_exact_dedup(spark, folder: str) -> DataFrame:
    found = exact_groups(documents(spark, folder))
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"),
        "is_first",
        F.col("digest").alias("text_sha256"),
    ).select("doc_id", "keep_id", "group_size", (F.col("is_first") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
"""
