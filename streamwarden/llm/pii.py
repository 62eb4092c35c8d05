"""Personal data by a semi-Markov conditional random field.

Base spans follow four plain rules and always stay. The field looks at the places
where a digit or an at sign stands (words with one, and neighbours of that kind).
Elsewhere no candidate segment exists, so the best labelling of a whole text falls
apart into those islands exactly. Candidate segments of at most ``MOST_TOKENS`` tokens
are scored as wholes (digits, groups, separators, check sums, what stands around
them); dynamic programming over positions and types picks boundaries and types
together, and what it finds beside the base spans is added when its posterior
probability is ``SURE`` or more.

Training data are islands of ``SAMPLE_DOCS`` documents (those with the smallest hash
of their id, a documented bound), ``SAMPLE_ISLANDS`` of them with and as many without a
base span. Base spans are their labels; of each labelled island a rewritten copy
(other separators, no plus) is learned too, so that the field knows spans which the
rules do not.

Cases: a null text is empty and has no spans. Rows are handled one by one, so null
or repeated ids and repeated rows are kept as they are; an empty table gives an
empty result (the field is then untrained and adds nothing); other columns play no
part. Texts are read whole; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamwarden.llm.columns import documents, free_name, slices, text_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
SAMPLE_ISLANDS = 200
MOST_TOKENS = 20
SURE = 0.9
EPOCHS = 15
RATE = 0.1
DECAY = 1e-3

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried once, at its first digit; later starts would fail alike.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
WORD = re.compile(r"\S*")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(piece: str) -> str:
    return "".join(DIGIT.findall(piece))


def _is_card(piece: str) -> bool:
    return 14 <= len(d := _digits(piece)) <= 19 and luhn(d)


def base_spans(text: str) -> list[Span]:
    """Spans of the four rules, by start and then kind."""
    spans: list[Span] = []
    end = 0
    if "@" in text:
        for found in DOMAIN.finditer(text):
            start = found.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < found.start():
                end = found.end()
                spans.append(("email", start, end))
    if DIGIT.search(text):
        for found in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found[0].split(".")):
                spans.append(("ip", *found.span()))
        spans += [("card", *f.span()) for f in CARD.finditer(text) if _is_card(f[0])]
        if "+" in text:
            spans += [("phone", *f.span()) for f in PHONE.finditer(text) if 10 <= len(_digits(f[0])) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words that hold a digit or an at sign, each one blank apart."""
    at, size = 0, len(text)
    while found := TRIGGER.search(text, at):
        start = found.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = WORD.match(text, found.end()).end()
        while end + 1 < size:
            following = WORD.match(text, end + 1).end()
            if following == end + 1 or not TRIGGER.search(text, end + 1, following):
                break
            end = following
        yield start, end
        at = end


FEATURES = (
    "bias", "digits<7", "digits7-9", "digits10-15", "digits14-19", "digits>19", "luhn", "four_parts", "octets", "plus",
    "bracket", "spaces", "dots", "hyphens", "even_groups", "one_group", "at_sign", "letters", "domain_end", "glued_left",
    "glued_right", "long_group", "regular", "tokens",
)


def span_features(text: str, start: int, end: int) -> np.ndarray:
    piece = text[start:end]
    groups = re.findall(r"[0-9]+", piece)
    digits = "".join(groups)
    n = len(digits)
    sizes = {len(g) for g in groups}
    letters = any(c.isalpha() for c in piece)
    between = re.findall(r"[^0-9]+", piece)
    values = {
        "bias": 1,
        "digits<7": n < 7,
        "digits7-9": 7 <= n <= 9,
        "digits10-15": 10 <= n <= 15,
        "digits14-19": 14 <= n <= 19,
        "digits>19": n > 19,
        "luhn": 14 <= n <= 19 and luhn(digits),
        "four_parts": piece.count(".") == 3 and len(groups) == 4 and not letters,
        "octets": len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        "plus": piece[0] == "+",
        "bracket": "(" in piece and ")" in piece,
        "spaces": " " in piece,
        "dots": "." in piece,
        "hyphens": "-" in piece,
        "even_groups": len(groups) > 2 and len(sizes) == 1,
        "one_group": len(groups) == 1,
        "at_sign": piece.count("@") == 1,
        "letters": letters,
        "domain_end": bool(re.search(r"[a-z0-9]@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{1,6}$", piece, re.I)),
        "glued_left": start > 0 and (text[start - 1].isalnum() or text[start - 1] in "+@._%-"),
        "glued_right": end < len(text) and (text[end].isalnum() or text[end] in "@_" or text[end : end + 2].strip(".-")[:1].isalnum()),
        "long_group": bool(groups) and max(map(len, groups)) > 6,
        "regular": len(set(between)) <= 1 and all(len(x) == 1 for x in between) and min(sizes, default=0) >= 3,
        "tokens": min(len(TOKEN.findall(piece)), MOST_TOKENS) / MOST_TOKENS,
    }
    return np.array([float(values[name]) for name in FEATURES])


# What a segment of each kind must have at least; short of that no weight helps.
NEEDED = (("domain_end",), ("four_parts", "octets"), ("luhn", "regular"), ("digits10-15",))


class Lattice:
    """Token borders of an island and its candidate segments."""

    def __init__(self, text: str):
        self.text = text
        self.borders = [0, *(m.end() for m in TOKEN.finditer(text))]
        tokens = [text[a:b] for a, b in zip(self.borders, self.borders[1:], strict=False)]
        self.segments: list[tuple[int, int]] = []
        for i, first in enumerate(tokens):
            if not (first[0].isalnum() or first in "+("):
                continue
            digits = 0
            at_signs = 0
            for j in range(i, min(i + MOST_TOKENS, len(tokens))):
                token = tokens[j]
                digits += len(token) if token[0] in "0123456789" else 0
                at_signs += token == "@"
                if at_signs > 1 or (token.isspace() and (at_signs or token != " ")):
                    break
                if not (token[0].isalnum() or token in "@+()._%- "):
                    break
                if token[0].isalnum() and (at_signs or 4 <= digits <= 19) and (at_signs or token[0] in "0123456789"):
                    if at_signs or not any(t[0].isalpha() for t in tokens[i : j + 1]):
                        self.segments.append((i, j + 1))
        spots = self.borders
        rows = [span_features(text, spots[i], spots[j]) for i, j in self.segments]
        self.rows = np.array(rows).reshape(-1, len(FEATURES))
        self.allowed = np.stack([self.rows[:, [FEATURES.index(n) for n in needed]].all(axis=1) for needed in NEEDED], axis=1)
        self.ending: dict[int, list[int]] = {}
        for number, (_, j) in enumerate(self.segments):
            self.ending.setdefault(j, []).append(number)


STATES = len(KINDS) + 1  # the last one: outside


class Field:
    """Weights of segment features by type and of neighbouring types."""

    def __init__(self):
        self.weights = np.zeros((len(KINDS), len(FEATURES)))
        self.steps = np.zeros((STATES, STATES))

    def _scores(self, lattice: Lattice) -> np.ndarray:
        return np.where(lattice.allowed, lattice.rows @ self.weights.T, -np.inf)

    def marginals(self, lattice: Lattice):
        """log of the sum over all segmentations, P(segment, type), expected neighbours."""
        scores, size = self._scores(lattice), len(lattice.borders)
        out = STATES - 1
        forward = np.full((size, STATES), -np.inf)
        forward[0, out] = 0
        entering: list = [None] * len(lattice.segments)
        for j in range(1, size):
            forward[j, out] = _log_sum(forward[j - 1] + self.steps[:, out])
            for number in lattice.ending.get(j, ()):
                i = lattice.segments[number][0]
                entering[number] = np.array([_log_sum(forward[i] + self.steps[:, y]) for y in range(out)])
                forward[j, :out] = np.logaddexp(forward[j, :out], entering[number] + scores[number])
        total = _log_sum(forward[-1])
        backward = np.full((size, STATES), -np.inf)
        backward[-1] = 0
        neighbours = np.zeros((STATES, STATES))
        chances = np.zeros_like(scores)
        starting: dict[int, list[int]] = {}
        for number, (i, _) in enumerate(lattice.segments):
            starting.setdefault(i, []).append(number)
        for i in range(size - 2, -1, -1):
            ways = backward[i + 1, out] + self.steps[:, out]
            backward[i] = ways
            neighbours[:, out] += np.exp(forward[i] + ways - total)
            for number in starting.get(i, ()):
                j = lattice.segments[number][1]
                each = self.steps[:, :out] + (scores[number] + backward[j, :out])[None, :]
                chance = np.exp(forward[i][:, None] + each - total)
                neighbours[:, :out] += chance
                chances[number] = chance.sum(axis=0)
                backward[i] = np.logaddexp(backward[i], _log_sum(each, axis=1))
        return total, chances, neighbours

    def best(self, lattice: Lattice) -> list[tuple[int, int]]:
        """(segment, type) of the best segmentation."""
        scores, size, out = self._scores(lattice), len(lattice.borders), STATES - 1
        value = np.full((size, STATES), -np.inf)
        value[0, out] = 0
        back: dict[tuple[int, int], tuple[int, int, int]] = {}
        for j in range(1, size):
            ways = value[j - 1] + self.steps[:, out]
            came = int(np.argmax(ways))
            value[j, out], back[j, out] = ways[came], (j - 1, came, -1)
            for number in lattice.ending.get(j, ()):
                i = lattice.segments[number][0]
                ways = value[i][:, None] + self.steps[:, :out]
                came = ways.argmax(axis=0)
                for y in range(out):
                    new = ways[came[y], y] + scores[number, y]
                    if new > value[j, y]:
                        value[j, y], back[j, y] = new, (i, int(came[y]), number)
        j, y = size - 1, int(np.argmax(value[-1]))
        found = []
        while j > 0:
            i, came, number = back[j, y]
            if number >= 0:
                found.append((number, y))
            j, y = i, came
        return found[::-1]

    def train(self, examples: list[tuple[str, list[Span]]], epochs=EPOCHS, rate=RATE, decay=DECAY) -> Field:
        """Maximum likelihood of the labelled segmentations."""
        known = []
        for text, spans in examples:
            lattice = Lattice(text)
            place = {b: n for n, b in enumerate(lattice.borders)}
            number_of = {segment: n for n, segment in enumerate(lattice.segments)}
            gold = [(number_of.get((place.get(a), place.get(b))), KINDS.index(kind)) for kind, a, b in spans]
            if len(lattice.segments) and all(n is not None and lattice.allowed[n, y] for n, y in gold):
                known.append((lattice, gold))
        squares = [np.full_like(self.weights, 1e-6), np.full_like(self.steps, 1e-6)]
        order = random.Random(1)
        for _ in range(epochs if known else 0):
            order.shuffle(known)
            for lattice, gold in known:
                _, chances, neighbours = self.marginals(lattice)
                slope = -(chances.T @ lattice.rows)
                at, last = 0, STATES - 1
                steps = -neighbours
                for number, y in gold:
                    slope[y] += lattice.rows[number]
                    i, j = lattice.segments[number]
                    if i > at:
                        steps[last, -1] += 1
                        steps[-1, -1] += i - at - 1
                        last = STATES - 1
                    steps[last, y] += 1
                    at, last = j, y
                if len(lattice.borders) - 1 > at:
                    steps[last, -1] += 1
                    steps[-1, -1] += len(lattice.borders) - 2 - at
                for value, change, square in ((self.weights, slope, squares[0]), (self.steps, steps, squares[1])):
                    change -= decay * value
                    square += change**2
                    value += rate * change / np.sqrt(square)
        return self

    def spans(self, text: str) -> list[Span]:
        """What the best segmentation has and the posterior supports."""
        lattice = Lattice(text)
        if not lattice.segments or not self.weights.any():
            return []
        chosen = self.best(lattice)
        if not chosen:
            return []
        _, chances, _ = self.marginals(lattice)
        return [
            (KINDS[y], lattice.borders[lattice.segments[n][0]], lattice.borders[lattice.segments[n][1]])
            for n, y in chosen
            if chances[n, y] >= SURE
        ]


def _log_sum(values: np.ndarray, axis: int = 0):
    return np.logaddexp.reduce(values, axis=axis)


def _apart(spans: list[Span]) -> list[Span]:
    """Spans without overlaps, longer ones first."""
    kept: list[Span] = []
    for span in sorted(spans, key=lambda s: (s[1] - s[2], KINDS.index(s[0]))):
        if all(span[2] <= other[1] or span[1] >= other[2] for other in kept):
            kept.append(span)
    return sorted(kept, key=lambda s: s[1])


def rewritten(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The island with its numbers written another way, which no rule covers."""
    made, at, shifted = "", 0, []
    for kind, start, end in spans:
        made += text[at:start]
        piece = text[start:end]
        if kind == "phone":
            piece = re.sub(r"^\+[0-9]{1,3}[ .-]?(?=.*[0-9]{3})", "", piece) if len(_digits(piece)) > 10 else piece[1:]
        elif kind == "card":
            digits = _digits(piece)
            piece = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        shifted.append((kind, len(made), len(made) + len(piece)))
        made += piece
        at = end
    return made + text[at:], shifted


def learn(docs: DataFrame, *, id_column="doc_id", text_column="text") -> Field:
    """A field trained on islands of the documents' sample."""
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    chosen = rows.filter("id IS NOT NULL").select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, labelled = [], []
            for text in batch.column("text").to_pylist():
                for start, end in islands(text):
                    piece = text[start:end]
                    # learning needs no huge islands; labelling takes them all
                    if len(piece) <= 400:
                        found.append(piece)
                        labelled.append(bool(base_spans(piece)))
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(found, pa.string()), "labelled": pa.array(labelled, pa.bool_())}
            )

    # SAMPLE_DOCS ids at most, whatever the table's size
    pieces = rows.join(F.broadcast(chosen), "id").select("text").mapInArrow(cut_out, "piece string, labelled boolean")
    pieces = pieces.persist()
    by_hash = [F.xxhash64("piece"), F.col("piece")]
    sample = []
    for labelled in (True, False):
        part = pieces.filter(F.col("labelled") == labelled).select("piece").orderBy(*by_hash).limit(SAMPLE_ISLANDS).collect()
        sample += [r.piece for r in part]
    pieces.unpersist()
    examples = []
    for piece in sample:
        spans = _apart(base_spans(piece))
        examples.append((piece, spans))
        if spans:
            examples.append(rewritten(piece, spans))
    return Field().train(examples)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans) of one text."""
    base = base_spans(text)
    added, at = [], 0
    for start, end in islands(text):
        while at < len(base) and base[at][2] <= start:
            at += 1
        near = [s for s in base[at:] if s[1] < end] if at < len(base) and base[at][1] < end else []
        for kind, a, b in field.spans(text[start:end]):
            span = (kind, a + start, b + start)
            if all(span[2] <= s[1] or span[1] >= s[2] for s in near):
                added.append(span)
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame, field: Field, *, id_column="doc_id", text_column="text") -> DataFrame:
    """Counts, digest of the base spans, and all spans of every text."""
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: dict = {f"n_{kind}": [] for kind in KINDS} | {"base_sha256": [], "spans": []}
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text, field)
                for kind in KINDS:
                    columns[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                columns["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns["spans"].append(joined(every))
            types = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            arrays = [pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *columns])

    id_type = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return rows.mapInArrow(marked, f"doc_id {id_type}, {counts}, base_sha256 string, spans string")


def masked(text: str, field: Field) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    made, at = [], 0
    for kind, start, end in all_spans(text, field)[1]:
        if start >= at:
            made += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*made, text[at:]])


def mask(docs: DataFrame, *, id_column="doc_id", text_column="text", length_column="n_chars") -> DataFrame:
    """``docs`` with personal data replaced; same columns, a null text stays null.

    Where there is a column of text lengths, it follows the new text.
    """
    field = learn(docs, id_column=id_column, text_column=text_column)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else masked(t, field))

    new = free_name(docs, "masked_text")
    out = docs.withColumn(new, cleaned(F.col(text_column)))
    columns = {text_column: F.col(new)}
    if length_column in docs.columns:
        length_type = docs.schema[length_column].dataType
        columns[length_column] = F.when(F.col(new).isNull(), F.col(length_column)).otherwise(F.length(new).cast(length_type))
    return out.withColumns(columns).select(*docs.columns)


def op4_pii_semi_crf(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return find(docs, learn(docs))
