"""Repeated passages removed with suffix automata over shards of reference text.

A window is ``window`` consecutive words. A word goes if a window covers it whose words
also start in a document with a smaller id.

1. Every window chooses its *anchor*, the gram of ``gram`` words with the smallest hash in
   it (the leftmost of equal ones). Equal windows choose the same gram at the same
   offset. Neighbouring windows with one anchor make up a *piece* of text. Only thin rows
   (id, place, hash of the anchor, hash of the piece) are shuffled; equal pieces become one
   row with their smallest and largest id, combined before the shuffle.
2. Pieces whose anchor occurs in one document only are done. Of the others, the text is
   taken from the piece's first document: this is the reference.
3. Reference pieces are sharded by anchor, so windows that may be equal meet in one shard. A
   shard is an automaton of at most ``SHARD`` words: its pieces are streamed through it by
   falling age (smallest id first). The matching statistics tell for each window the
   document that had it first; windows that are new are appended, and a state
   remembers the document that made it.
4. First documents of the windows go back to all documents with that piece by a join of
   thin rows, and each document drops the words of windows that are older than itself.

An anchor with more than ``HOT`` different pieces (a passage that very many documents
surround with words of their own) is divided: pieces are cut in two by the offset of the
anchor within the window, and each half is sharded by the longer core that all its
windows have in common. This repeats while needed; with one offset left all pieces of a
core are equal, so no shard has to hold more than a bounded text. The automata are
built where the shard's rows lie instead of being sent to every machine: all documents
are reference here, and sending each shard to each document would grow with the square.

Cases: a null or empty text has no words; a text shorter than a window loses nothing. A row
with a null id loses nothing and is no reference. Rows that share an id are judged
each by its own words, never against each other. An empty table gives an empty result.
Other columns are untouched. Memory: some 40 bytes a word of the longest text, and an
automaton of ``SHARD`` words. Anchors and pieces are told apart by two 64-bit hashes;
windows are compared by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from streamwarden.llm.columns import documents, free_name, slices, text_of, written

WINDOW = 50
GRAM = 16
SHARD = 100_000  # words in one automaton
HOT = 1024  # different pieces of one anchor
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Codes(dict):
    """64-bit codes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


class _Hashes:
    """Hashes of any stretch of a text's words, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, words: list[bytes], codes: _Codes):
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        up, _ = _powers(len(words))
        values = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
        np.cumsum(values * up, out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        _, down = _powers(len(self.sums))
        value = (self.sums[end] - self.sums[start]) * down[start]
        value = (value ^ (value >> np.uint64(29))) * _MIX + (end - start).astype(np.uint64)
        return value ^ (value >> np.uint64(32))


_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for ordinary lengths, made anew for long texts."""
    if _kept and len(_kept[0]) >= n:
        return _kept[0][:n], _kept[1][:n]
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if n <= 1 << 17:
        _kept[:] = made
    return made[0][:n], made[1][:n]


def _smallest(values: np.ndarray, each: int) -> np.ndarray:
    """Place of the smallest of ``each`` neighbours from every place on, the leftmost of equal ones.

    The place stands in for the lowest 15 bits of a value, so minima of doubling width find it.
    """
    low = np.uint64(0x7FFF)
    best = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    width = 1
    while width * 2 <= each:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < each:
        best = np.minimum(best[: len(values) - each + 1], best[each - width :])
    return (best & low).astype(np.int64)


def _pieces(hashes: _Hashes, count: int, window: int, gram: int):
    """(start, windows, offset of the anchor, anchor hash, piece hash) of a text's pieces, as arrays."""
    starts = np.arange(count - gram + 1)
    grams = hashes.of(starts, starts + gram)
    each = window - gram + 1
    anchor = np.empty(count - window + 1, dtype=np.int64)
    for a in range(0, len(anchor), 1 << 14):
        anchor[a : a + (1 << 14)] = a + _smallest(grams[a : a + (1 << 14) + each - 1], each)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    windows = np.diff(first, append=len(anchor))
    place = anchor[first]
    return first, windows, place - first, grams[place], hashes.of(first, first + windows + window - 1)


def marks(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, start, windows, at, key, piece) of every piece; ``rows`` has ``id`` and ``text``."""
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            codes = _Codes()
            row, parts = [], []
            for number, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.split()  # of bytes: the six ASCII blanks
                if len(words) >= window:
                    found = _pieces(_Hashes(words, codes), len(words), window, gram)
                    row.append(np.full(len(found[0]), number))
                    parts.append(found)
            if not parts:
                continue
            start, windows, at, key, piece = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.concatenate(row))),
                    pa.array(start.astype(np.int32)),
                    pa.array(windows.astype(np.int32)),
                    pa.array(at.astype(np.int32)),
                    pa.array(key.view(np.int64)),
                    pa.array(piece.view(np.int64)),
                ],
                names=["id", "start", "windows", "at", "key", "piece"],
            )

    return rows.filter("id is not null").mapInArrow(
        find, f"id {kind}, start int, windows int, at int, key long, piece long"
    )


class Automaton:
    """Suffix automaton of word sequences; each state knows the document that made it first."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner: list = [None]

    def _add(self, length: int, owner, links: dict) -> int:
        self.next.append(links)
        self.link.append(0)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.length) - 1

    def append(self, words: list[bytes], owner) -> None:
        """Owners must come by rising id: what is there already is older."""
        step, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            state = last
            target = step[state].get(word)
            if target is not None and length[target] == length[state] + 1:
                last = target
                continue
            if target is not None:
                last = self._split(state, word, target)
                continue
            new = self._add(length[state] + 1, owner, {})
            while state >= 0 and word not in step[state]:
                step[state][word] = new
                state = link[state]
            if state >= 0:
                target = step[state][word]
                link[new] = target if length[target] == length[state] + 1 else self._split(state, word, target)
            last = new

    def _split(self, state: int, word: bytes, old: int) -> int:
        copy = self._add(self.length[state] + 1, self.owner[old], dict(self.next[old]))
        self.link[copy] = self.link[old]
        self.link[old] = copy
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def owners(self, words: list[bytes], window: int) -> list:
        """For each window of ``words`` the owner of its oldest occurrence, or None."""
        step, link, length, owner = self.next, self.link, self.length, self.owner
        found = []
        state = size = 0
        for place, word in enumerate(words, 1):
            while state and word not in step[state]:
                state = link[state]
                size = length[state]
            if word in step[state]:
                state = step[state][word]
                size += 1
            while state and length[link[state]] >= window:
                state = link[state]
                size = length[state]
            if place >= window:
                found.append(owner[state] if size >= window else None)
        return found


def judge(shard: list[tuple], window: int) -> Iterator[tuple]:
    """(key, piece, first document of each window) for the rows (key, piece, id, text) of a shard."""
    known = Automaton()
    once = {r[:2]: r for r in shard}  # rows that share an id may have given a piece twice
    for key, piece, owner, text in sorted(once.values(), key=lambda r: r[2]):
        words = text.split(b" ")
        found = known.owners(words, window)
        a = 0
        while a < len(found):
            b = a
            while b < len(found) and found[b] is None:
                b += 1
            if b > a:
                known.append(words[a : b + window - 1], owner)
            a = b + 1
        yield key, piece, [owner if f is None else f for f in found]


def _judged(reference: DataFrame, window: int) -> DataFrame:
    """(key, piece, firsts): shards of whole anchors, each an automaton of its own."""
    kind = reference.schema["id"].dataType.simpleString()
    arrow = to_arrow_type(reference.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard):
            keys, pieces, firsts = zip(*judge(shard, window), strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(pieces, pa.int64()), pa.array(firsts, pa.list_(arrow))],
                names=["key", "piece", "firsts"],
            )

        shard, words = [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            for row in zip(*columns, texts, strict=True):
                if words >= SHARD and row[0] != shard[-1][0]:
                    yield out(shard)
                    shard, words = [], 0
                shard.append(row)
                words += row[3].count(b" ") + 1
        if shard:
            yield out(shard)

    dealt = reference.select("key", "piece", "id", "body").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"key long, piece long, firsts array<{kind}>")


def _halves(reference: DataFrame, window: int, low: int, high: int) -> DataFrame:
    """Pieces cut in two by the anchor's offset in the window (``low`` to ``high``), under the hash
    of the core that all windows of a half share; ``side`` and the parent's names go along."""
    kind = reference.schema["id"].dataType.simpleString()
    middle = (low + high) // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            codes = _Codes()
            rows = []
            names = ("key", "piece", "id", "body", "at")
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                key, piece, owner, body, at = row
                words = body.encode().split(b" ")
                hashes = _Hashes(words, codes)
                count = len(words) - window + 1  # window k has its anchor at offset at - k
                for side, a, b in ((0, middle + 1, high), (1, low, middle)):
                    first, last = max(at - b, 0), min(at - a, count - 1)
                    if first > last:
                        continue
                    core = hashes.of(np.array([at - a]), np.array([at - b + window]))
                    own = hashes.of(np.array([first]), np.array([last + window]))
                    rows.append(
                        (
                            int(core.view(np.int64)[0]),
                            int(own.view(np.int64)[0]),
                            owner,
                            b" ".join(words[first : last + window]).decode(),
                            at - first,
                            key,
                            piece,
                            side,
                        )
                    )
            yield pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in rows], schema=schema)

    fields = ("key", "piece", "id", "body", "at", "parent_key", "parent_piece", "side")
    arrow = to_arrow_type(reference.schema["id"].dataType)
    schema = pa.schema(
        list(
            zip(
                fields,
                (pa.int64(), pa.int64(), arrow, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32()),
                strict=True,
            )
        )
    )
    return reference.select("key", "piece", "id", "body", "at").mapInArrow(
        cut, f"key long, piece long, id {kind}, body string, at int, parent_key long, parent_piece long, side int"
    )


def _firsts(reference: DataFrame, window: int, low: int, high: int, hot: int) -> DataFrame:
    """(key, piece, firsts) of all reference pieces; anchors with too many pieces are divided first."""
    kind = reference.schema["id"].dataType.simpleString()
    crowded = written(
        reference.groupBy("key").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > hot).select("key")
    )
    if low == high or crowded.isEmpty():
        return _judged(reference, window)
    halves = written(_halves(reference.join(crowded, "key", "left_semi"), window, low, high))
    middle = (low + high) // 2
    sides = []
    for side, (a, b) in enumerate(((middle + 1, high), (low, middle))):
        half = halves.filter(F.col("side") == side)
        pieces = written(half.groupBy("key", "piece", "at").agg(F.min("id").alias("id"), F.min("body").alias("body")))
        own = _firsts(pieces, window, a, b, hot)
        parents = half.select("key", "piece", "parent_key", "parent_piece").distinct()
        sides.append(
            parents.join(own, ["key", "piece"]).select(
                F.col("parent_key").alias("key"), F.col("parent_piece").alias("piece"), F.col("firsts").alias(f"side{side}")
            )
        )
    none = F.expr(f"cast(array() as array<{kind}>)")
    whole = sides[0].join(sides[1], ["key", "piece"], "full").select(
        "key", "piece", F.concat(F.coalesce("side0", none), F.coalesce("side1", none)).alias("firsts")
    )
    return _judged(reference.join(crowded, "key", "left_anti"), window).unionByName(whole)


def _reference(rows: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(key, piece, id, body, at): text of the pieces of ``found`` from their first documents."""
    kind = rows.schema["id"].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            codes = _Codes()
            rows, bodies, chosen = [], [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            cuts = _Cuts(batch.column(2))
            for number, text in enumerate(texts):
                words = text.split()
                own, start, end = cuts.of(number, words, codes, window)
                bodies.extend(b" ".join(words[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True))
                chosen.append(own)
                rows.append(np.full(len(own), number))
            chosen = pa.array(np.concatenate(chosen))
            yield pa.RecordBatch.from_arrays(
                [
                    cuts.cells["key"].take(chosen),
                    cuts.cells["piece"].take(chosen),
                    batch.column(0).take(pa.array(np.concatenate(rows))),
                    pa.array(bodies, pa.binary()).cast(pa.string()),
                    cuts.cells["at"].take(chosen),
                ],
                names=["key", "piece", "id", "body", "at"],
            )

    cuts = found.groupBy("id").agg(F.collect_list(F.struct("key", "piece", "start", "windows", "at")).alias("cuts"))
    return rows.join(cuts, "id").mapInArrow(take, f"key long, piece long, id {kind}, body string, at int")


class _Cuts:
    """A batch's lists of pieces as flat columns."""

    def __init__(self, lists: pa.ListArray):
        self.ends = lists.offsets.to_numpy()
        self.missing = lists.is_null().to_numpy(zero_copy_only=False)
        names = [f.name for f in lists.type.value_type]
        self.cells = dict(zip(names, lists.values.flatten(), strict=True))
        self.start = self.cells["start"].to_numpy().astype(np.int64)
        self.size = self.cells["windows"].to_numpy().astype(np.int64)
        self.piece = self.cells["piece"].to_numpy()

    def of(self, row: int, words: list[bytes], codes: _Codes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, start, end) of the pieces of this very text among those listed for its id."""
        listed = np.arange(0 if self.missing[row] else self.ends[row], 0 if self.missing[row] else self.ends[row + 1])
        start = self.start[listed]
        end = start + self.size[listed] + window - 1
        inside = end <= len(words)
        if not inside.all():
            listed, start, end = listed[inside], start[inside], end[inside]
        if not len(listed):
            return listed, start, end
        own = _Hashes(words, codes).of(start, end).view(np.int64) == self.piece[listed]
        return listed[own], start[own], end[own]


def remove_repeats(
    docs: DataFrame, *, id_column="doc_id", text_column="text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the words that stay, one space between)."""
    work = free_name(docs, "row")
    others = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept")]
    whole = docs.select(
        F.col(id_column).alias("id"), text_of(text_column).alias("text"), F.struct(*others).alias(work)
    )
    rows = whole.select("id", "text")
    thin = written(marks(rows, window, gram))
    pieces = thin.groupBy("key", "piece").agg(
        F.min(F.struct("id", "start", "windows", "at")).alias("first"), F.max("id").alias("last")
    )
    shared = (
        pieces.groupBy("key")
        .agg(F.min("first.id").alias("lowest"), F.max("last").alias("highest"))
        .filter("lowest < highest")
        .select("key")
    )
    found = pieces.join(shared, "key").select("key", "piece", "first.*")
    reference = written(_reference(rows, found, window))
    firsts = _firsts(reference, window, 0, window - gram, hot)
    older = (
        thin.join(firsts, ["key", "piece"])
        .filter(F.exists("firsts", lambda f: f < F.col("id")))
        .withColumn(
            "gone",  # null: all windows of the piece
            F.expr("if(forall(firsts, f -> f < id), null, filter(sequence(0, windows - 1), k -> firsts[k] < id))"),
        )
        .groupBy("id")
        .agg(F.collect_list(F.struct("piece", "start", "windows", "gone")).alias("cuts"))
    )
    kind = whole.schema[work].dataType.simpleString()

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            codes = _Codes()
            counts, removed, kept = [], [], []
            cuts = _Cuts(batch.column(2))
            gone = cuts.cells["gone"]
            partly = gone.is_valid().to_numpy(zero_copy_only=False)
            ends, offsets = gone.offsets.to_numpy(), gone.values.to_numpy().astype(np.int64)
            for number, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.split()
                counts.append(len(words))
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                own, start, end = cuts.of(number, words, codes, window)
                some = partly[own]
                np.add.at(edges, start[~some], 1)
                np.add.at(edges, end[~some], -1)
                for piece, begin in zip(own[some].tolist(), start[some].tolist(), strict=True):
                    first = begin + offsets[ends[piece] : ends[piece + 1]]
                    edges[first] += 1
                    edges[first + window] -= 1
                stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(words if len(stay) == len(words) else [words[k] for k in stay.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(3),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=[work, "n_words", "n_removed", "kept"],
            )

    result = (
        whole.join(older, "id", "left")
        .select("id", "text", "cuts", work)
        .mapInArrow(drop, f"`{work}` {kind}, n_words long, n_removed long, kept string")
    )
    return result.select(f"`{work}`.*", "n_words", "n_removed", "kept")


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(documents(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
with texts as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), windows as (
    select doc_id, i, md5_number(array_to_string(words[i:i + 49], ' ')) as content
    from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from texts where len(words) >= 50)
), firsts as (
    select content, min(doc_id) as first_id from windows group by content
), older as (
    select doc_id, i from windows join firsts using (content) where first_id < doc_id
), places as (
    select doc_id, words[i] as word, i from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from texts)
), judged as (
    select doc_id, places.i, word,
        count(older.i) over (partition by doc_id order by places.i rows between 49 preceding and current row) as covers
    from places left join older using (doc_id, i)
)
select texts.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(removed, 0) as bigint) as n_removed,
    sha256(coalesce(kept, '')) as kept_sha256
from texts left join (
    select doc_id, count(*) filter (covers > 0) as removed,
        string_agg(word, ' ' order by i) filter (covers = 0) as kept
    from judged group by doc_id
) using (doc_id)
"""
