"""Runs of periodically repeated words, by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q, at least ``least`` long and three
periods long, that cannot be extended. A text's words are appended to a suffix automaton
one after another. The automaton's suffix links form a tree, kept as a link-cut
tree whose preferred paths carry the place where their strings ended last. Appending word
i recolours the path from the root to the state of the whole prefix; where a path
segment with last place j is met, its deepest state is the longest suffix that
ends at i and at j, of length L. With d = i - j <= L this is a square of period d,
and the stretch from j - L + 1 to i repeats with period d. Where L >= 2 * d no shorter
period is possible (its occurrence would have been the last one), and L is exact, so the
stretch cannot be extended to the left; the last i that shows it is its end.

Before that, stretches that can hold a run are found by arithmetic on arrays: in a run, all
words lie in grams of ``2 * least / 3`` words that occur again at the distance of the
period, which is at most a third of the run. What no such gram covers is in no run. Equal
hashes of unequal grams would only make a stretch longer.

The work is a projection: no shuffle, and a text is read by one task. Memory is about 100
bytes a word of the longest stretch plus a few arrays over the words of one text; the
time grows as n log n. Batches are cut so that long texts come few at a time.

Cases: a null or empty text has no words, no runs, and an empty collapsed text. Rows with
null or repeated ids are rows of their own. An empty table gives an empty result. Other
columns are untouched.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamwarden.llm.columns import documents, free_name, slices, text_of

LEAST = 24  # words
BLANKS = r"[\x20\x09-\x0D]+"
RUN = "struct<start:long,length:long,period:long>"


class _Forest:
    """Suffix automaton whose link tree is a link-cut tree coloured by last end places.

    State 0 is "none" and state 1 the root. A state's first transition lies in arrays,
    further ones in a dictionary. ``mark`` holds a preferred path's place at the root of its
    splay tree. Splay trees are ordered by depth: left is nearer to the root.
    """

    def __init__(self, size: int):
        room = [0] * (2 * size + 2)
        self.length = array("i", room)
        self.link = array("i", room)
        self.word = array("i", [-1]) * len(room)
        self.target = array("i", room)
        self.more: dict[tuple[int, int], int] = {}
        self.branches: dict[int, list[int]] = {}
        self.up = array("i", room)
        self.left = array("i", room)
        self.right = array("i", room)
        self.mark = array("i", [-1]) * len(room)
        self.states = 2
        self.last = 1

    def _step(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.target[state]
        return self.more.get((state, word), 0)

    def _point(self, state: int, word: int, target: int) -> None:
        if self.word[state] in (word, -1):
            self.word[state] = word
            self.target[state] = target
            return
        if (state, word) not in self.more:
            self.branches.setdefault(state, []).append(word)
        self.more[state, word] = target

    def append(self, word: int) -> int:
        """The state of the whole prefix, linked into the tree but not yet coloured."""
        new, state = self.states, self.last
        self.states += 1
        self.length[new] = self.length[state] + 1
        while state and not self._step(state, word):
            self._point(state, word, new)
            state = self.link[state]
        if not state:
            above = 1
        else:
            above = self._step(state, word)
            if self.length[above] != self.length[state] + 1:
                above = self._split(state, word, above)
        self.link[new] = self.up[new] = above
        self.last = new
        return new

    def _split(self, state: int, word: int, old: int) -> int:
        """A copy of ``old`` for its shorter strings, put between it and its link."""
        copy = self.states
        self.states += 1
        self.length[copy] = self.length[state] + 1
        self.link[copy] = self.link[old]
        self.word[copy] = self.word[old]
        self.target[copy] = self.target[old]
        for other in self.branches.get(old, ()):
            self._point(copy, other, self.more[old, other])
        while state and self._step(state, word) == old:
            self._point(state, word, copy)
            state = self.link[state]
        self.link[old] = copy
        # the strings of the copy ended last where those of ``old`` did: it joins the path of
        # ``old`` right above it
        self._splay(old)
        nearer = self.left[old]
        self.left[old] = copy
        self.up[copy] = old
        self.left[copy] = nearer
        if nearer:
            self.up[nearer] = copy
        return copy

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            inner = right[x]
            left[y] = inner
            right[x] = y
        else:
            inner = left[x]
            right[y] = inner
            left[x] = y
        if inner:
            up[inner] = y
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[x] = z
        up[y] = x
        self.mark[x] = self.mark[y]  # used where x ends as the root of the splay tree

    def recolour(self, state: int, place: int) -> list[tuple[int, int]]:
        """Give the path from the root to ``state`` the place; (last place, length) of its old segments."""
        met = []
        up, right, mark, length = self.up, self.right, self.mark, self.length
        below, x = 0, state
        while x:
            self._splay(x)
            if mark[x] >= 0:
                met.append((mark[x], length[x]))
            deeper = right[x]
            if deeper:
                mark[deeper] = mark[x]  # keeps its place as a path of its own
            right[x] = below
            below = x
            x = up[x]
        mark[below] = place
        return met


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) -> last word of each stretch of three periods or more."""
    forest = _Forest(len(words))
    found: dict[tuple[int, int], int] = {}
    for place, word in enumerate(words):
        for before, size in forest.recolour(forest.append(word), place):
            period = place - before
            if size >= 2 * period:
                found[before - size + 1, period] = place
    return found


def _repeats(codes: np.ndarray, gram: int, reach: int) -> np.ndarray:
    """Which places lie in a gram that occurs again no more than ``reach`` places away."""
    with np.errstate(over="ignore"):
        hashed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        hashed ^= hashed >> np.uint64(29)
        width, rolled = 1, hashed
        while width * 2 <= gram:
            rolled = (rolled[:-width] * np.uint64(0xBF58476D1CE4E5B9)) ^ (rolled[width:] + np.uint64(width))
            rolled ^= rolled >> np.uint64(31)
            width *= 2
        if width < gram:  # two overlapping halves make up the rest
            rolled = (rolled[: len(codes) - gram + 1] * np.uint64(0x94D049BB133111EB)) ^ rolled[gram - width :]
    order = np.argsort(rolled, kind="stable")
    same = (rolled[order[1:]] == rolled[order[:-1]]) & (np.diff(order) <= reach)
    starts = np.zeros(len(codes) + 1, dtype=np.int64)
    hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    starts[hit] += 1
    starts[hit + gram] -= 1
    return np.cumsum(starts[:-1]) > 0


def _stretches(codes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of stretches outside of which no word is in a run."""
    gram = 2 * least // 3
    if len(codes) < least:
        return []
    covered = np.diff(_repeats(codes, gram, len(codes) // 3).astype(np.int8), prepend=0, append=0)
    bounds = zip(np.flatnonzero(covered == 1).tolist(), np.flatnonzero(covered == -1).tolist(), strict=True)
    return [(a, b) for a, b in bounds if b - a >= least]


def find_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if len(words) < least:
        return []
    known: dict = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(words) - len(known) < least * 2 // 3:  # two thirds of a run are words seen before
        return []
    runs = []
    for start, end in _stretches(codes, least):
        for (first, period), last in squares(codes[start:end].tolist()).items():
            size = last - first + 1
            if size >= max(least, 3 * period):
                runs.append((start + first, size, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, size, period in runs:
        edges[start + period] += 1
        edges[start + size] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def periodic_runs(
    docs: DataFrame, *, text_column="text", runs_column="runs", collapsed_column="collapsed", least: int = LEAST
) -> DataFrame:
    """``docs`` with its runs (an array of ``RUN`` by start, then period) and the collapsed text."""
    if least % 3:
        raise ValueError("least must be a multiple of three")
    work = free_name(docs, "periodic")
    others = [c for c in docs.columns if c.lower() not in (runs_column.lower(), collapsed_column.lower())]
    rows = docs.select(F.struct(*others).alias(work), text_of(text_column).alias("text"))
    kind = rows.schema[work].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            runs, texts = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.split()  # of bytes: the six ASCII blanks
                found = find_runs(words, least)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(collapse(words, found) if found else words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(
                        runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                    ),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=[work, "runs", "collapsed"],
            )

    found = rows.mapInArrow(scan, f"`{work}` {kind}, runs array<{RUN}>, collapsed string")
    return found.select(f"`{work}`.*", F.col("runs").alias(runs_column), F.col("collapsed").alias(collapsed_column))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts repeat a stretch of their words up to the end.

    With h = crc32(doc_id) and g = h div 10, the texts with h divisible by 10 keep
    their first a = g % n words; from there on their next p words are repeated.
    """
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    rows = docs.select("doc_id", text_of("text").alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    repeated = F.expr(
        "concat_ws(' ', slice(words, 1, int(a)), slice(flatten(array_repeat("
        "slice(words, int(a) + 1, int(p)), int((n - a + p - 1) div p))), 1, int(n - a)))"
    )
    return (
        rows.select("*", F.expr("h div 10").alias("g"), F.when(F.expr("h % 10 = 0"), words).alias("words"))
        .select("*", F.size("words").cast("long").alias("n"))
        .select("*", F.expr("case when n > 0 then g % n end").alias("a"))
        .select("*", F.expr("case when n > 0 then 1 + (n - a) div (3 + g % 8) end").alias("p"))
        .select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))
    )


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_repeats(documents(spark, folder)))
    # runs come by start, then period: of equal exponents the first stays
    best = F.expr(
        "aggregate(slice(runs, 2, greatest(size(runs), 1)), get(runs, 0), "
        "(b, r) -> if(r.length * b.period > b.length * r.period, r, b))"
    )
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
