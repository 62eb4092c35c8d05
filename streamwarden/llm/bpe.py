"""Byte-pair encoding and decoding in batched numpy merge rounds.

Words of a batch that were not seen before lie in one flat array of symbols. In
each round every neighbouring pair is looked up by binary search over the sorted
pair keys, the lowest rank of each word is merged wherever it stands in that word
(left to right, never overlapping), and words without a known pair leave the array.
Words longer than ``LONG`` bytes take a queue of pairs instead, because rounds over
one huge word would be quadratic.

Texts are cut before each single space that stands before another character; the
split pattern never joins what lies on both sides of such a cut, so a piece is
encoded once and then taken from a bounded table. Ids of a whole slice of
documents are gathered from that table in one step. A special token is taken out
of the text first, as the tokenizer library does.

Cases: a null text is empty and has no ids; repeated rows give repeated results;
an empty table gives an empty one; other columns play no part. Texts are processed
whole, at most a slice of about 4 MB (one row at least) at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamwarden.llm.columns import documents, give_back, slices, text_of

VOCABULARY = "byte_bpe_50k.json"
LONG = 256  # bytes
BLOCK = 16_384  # words merged together
MOST_PIECES = 400_000  # pieces kept by a worker
MOST_CHARS = 16 << 20
SLICE = 4 << 20  # working arrays are some 20 times that
NONE = np.iinfo(np.int64).max
CUT = re.compile(r"(?= \S)")
# Fixed value: the split pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the rest follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in shown else extra))
        extra += byte not in shown
    return letters


@dataclass
class Vocabulary:
    """What encoding needs of a vocabulary file; small, so it travels with the tasks."""

    byte_ids: np.ndarray
    keys: np.ndarray  # left id * width + right id, ascending
    ranks: np.ndarray
    merged: np.ndarray
    width: int
    token_bytes: list[bytes]
    special: dict[str, int]
    name: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = file.read()
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        ids = model["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        width = max([*ids.values(), *special.values()]) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * width + ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        token_bytes = [b""] * width
        for token, number in ids.items():
            token_bytes[number] = bytes(byte_of[c] for c in token)
        for token, number in special.items():
            token_bytes[number] = token.encode()
        return cls(
            np.array([ids[letter] for letter in letters], dtype=np.int64),
            keys[order],
            order.astype(np.int64),
            np.array([ids[a + b] for a, b in pairs], dtype=np.int64)[order],
            width,
            token_bytes,
            special,
            hashlib.sha256(content.encode()).hexdigest(),
        )

    @cached_property
    def pair_of(self) -> dict[int, tuple[int, int]]:
        return {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist(), strict=True)}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such pair) and merged id of each pair."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE), self.merged[at]


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the number of ids of each."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(words), dtype=np.int64)
    begin = 0
    for end in (*(i for i, word in enumerate(words) if len(word) > LONG), len(words)):
        for at in range(begin, end, BLOCK):
            block = words[at : min(at + BLOCK, end)]
            ids, counts[at : at + len(block)] = _rounds(block, vocabulary)
            parts.append(ids)
        if end < len(words):
            parts.append(merge_long(words[end], vocabulary))
            counts[end] = len(parts[-1])
        begin = end + 1
    return np.concatenate([np.zeros(0, np.int64), *parts]), counts


def _rounds(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    done_symbols, done_words = [], []
    if len(symbols):
        rank, merged = vocabulary.look_up(symbols[:-1], symbols[1:])
        rank, merged = np.append(np.where(word[1:] == word[:-1], rank, NONE), NONE), np.append(merged, 0)
    while len(symbols):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(symbols)))
        finished = best == NONE
        if finished.any():
            done_symbols.append(symbols[finished])
            done_words.append(word[finished])
            left = ~finished
            symbols, word, rank, merged, best = symbols[left], word[left], rank[left], merged[left], best[left]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == best)
        near = np.flatnonzero(np.diff(at) == 1)
        if len(near):  # of touching places of one pair (a a a) every other one counts
            fresh = np.append(True, np.diff(at) > 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        symbols[at] = merged[at]
        stays = np.ones(len(symbols), dtype=bool)
        stays[at + 1] = False
        symbols, word, rank, merged = symbols[stays], word[stays], rank[stays], merged[stays]
        # only pairs that touch a merged symbol are looked up again
        at -= np.arange(len(at))
        changed = np.unique(np.concatenate([at, at - 1]))
        changed = changed[(changed >= 0)]
        last = changed == len(symbols) - 1
        after = np.where(last, changed, changed + 1)
        new_rank, new_merged = vocabulary.look_up(symbols[changed], symbols[after])
        rank[changed] = np.where(last | (word[changed] != word[after]), NONE, new_rank)
        merged[changed] = new_merged
    flat = np.concatenate([np.zeros(0, np.int64), *done_symbols])
    owner = np.concatenate([np.zeros(0, np.int64), *done_words])
    return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def merge_long(word: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """One long word: pairs wait in a queue by rank and place."""
    symbols = vocabulary.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
    size, width, pair_of = len(symbols), vocabulary.width, vocabulary.pair_of
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    queue: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < size:
            key = symbols[i] * width + symbols[j]
            if key in pair_of:
                heapq.heappush(queue, (pair_of[key][0], i, key))

    for i in range(size):
        offer(i)
    while queue:
        _, i, key = heapq.heappop(queue)
        j = after[i] if symbols[i] >= 0 else size
        if j >= size or symbols[i] * width + symbols[j] != key:
            continue
        symbols[i], symbols[j] = pair_of[key][1], -1
        after[i] = after[j]
        if after[i] < size:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return np.array([s for s in symbols if s >= 0], dtype=np.int64)


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray):
    """The entries ``number`` of a table of runs, one after another, and their ends."""
    sizes = size[number]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start[number] - (ends - sizes), sizes)], ends


class Encoder:
    """Encodes arrays of texts; its table of pieces is bounded.

    ``library`` leaves new pieces to tiktoken instead of merge rounds.
    """

    def __init__(self, vocabulary: Vocabulary, library: bool = False):
        self.vocabulary = vocabulary
        self.words = regex.compile(PATTERN)
        contents = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, contents))})") if contents else None
        self.library = None
        if library:
            import tiktoken

            ordinary = {t: i for i, t in enumerate(vocabulary.token_bytes) if t and i not in vocabulary.special.values()}
            self.library = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ordinary, special_tokens={})
            self.opens = np.array([t[:1] == b" " for t in vocabulary.token_bytes])
        self.clear()

    def clear(self) -> None:
        self.table: dict[str, int] = {}
        self.chars = 0
        self.waiting: list[str] = []
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _number(self, piece: str) -> int:
        number = self.table.setdefault(piece, len(self.table))
        if number == len(self.table) - 1 and len(self.waiting) < len(self.table) - len(self.size):
            self.waiting.append(piece)
            self.chars += len(piece)
        return number

    def _by_cuts(self, text: str) -> list[int]:
        """Numbers of a text's pieces, whatever white space it has."""
        numbers = []
        parts = self.special.split(text) if self.special else [text]
        for i, part in enumerate(parts):
            if i % 2:
                numbers.append(-1 - self.vocabulary.special[part])
            else:
                numbers += map(self._number, CUT.split(part))
        return numbers

    def _encode_waiting(self) -> None:
        pieces = self.waiting
        if not pieces:
            return
        if self.library is not None:
            ids, ends = self._by_library(pieces)
        else:
            found = list(map(self.words.findall, pieces))
            distinct: dict[str, int] = {}
            number = np.array([distinct.setdefault(w, len(distinct)) for piece in found for w in piece], dtype=np.int64)
            ids, sizes = merge_words([w.encode("utf-8", "surrogatepass") for w in distinct], self.vocabulary)
            ids, word_ends = gathered(ids, np.cumsum(sizes) - sizes, sizes, number)
            ends = np.concatenate([[0], word_ends])[np.cumsum(list(map(len, found)))]
        sizes = np.diff(ends, prepend=0)
        self.start = np.concatenate([self.start, ends - sizes + len(self.flat)])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.waiting = []

    def _by_library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that start with their only space follow from one call for all:
        just their first id opens with a space."""
        plain = np.array([p[:1] == " " and p.count(" ") == 1 and len(p) <= LONG for p in pieces])
        joined = self.library.encode_to_numpy("".join(p for p, one in zip(pieces, plain, strict=True) if one))
        joined = joined.astype(np.int64)
        starts = np.flatnonzero(self.opens[joined])
        runs = iter(np.split(joined, starts[1:])) if len(starts) else iter(())
        if len(starts) == plain.sum() == len(pieces):
            return joined, np.append(starts[1:], len(joined))
        parts = []
        for piece, one in zip(pieces, plain, strict=True):
            if one:
                parts.append(next(runs))
            else:
                words = self.words.findall(piece)
                parts.append(merge_words([w.encode("utf-8", "surrogatepass") for w in words], self.vocabulary)[0])
        return np.concatenate(parts), np.cumsum(list(map(len, parts)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids end."""
        if len(self.table) > MOST_PIECES or self.chars > MOST_CHARS:
            self.clear()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        bounds = split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        pieces = split.flatten().dictionary_encode()
        at = pieces.indices.to_numpy().astype(np.int64)
        distinct = pieces.dictionary.to_pylist()
        # a space before white space is no cut; a special token is looked for by itself
        odd = np.array([not p or p[0].isspace() or bool(self.special and self.special.search(p)) for p in distinct], dtype=bool)
        head = np.zeros(len(at), dtype=bool)
        head[bounds[:-1]] = True
        unusual = np.logical_or.reduceat(odd[at] & ~head, bounds[:-1]) | self._special_heads(distinct, at[bounds[:-1]])
        used = np.zeros(len(distinct), dtype=bool)
        used[at[~head & ~np.repeat(unusual, np.diff(bounds))]] = True
        number_of = np.zeros(len(distinct), dtype=np.int64)
        wanted = np.flatnonzero(used)
        number_of[wanted] = [self._number(f" {distinct[i]}") for i in wanted.tolist()]
        number = number_of[at]
        number[bounds[:-1]] = [self._number(distinct[i]) for i in at[bounds[:-1]].tolist()]
        if unusual.any():
            parts = np.split(number, bounds[1:-1])
            for i in np.flatnonzero(unusual).tolist():
                parts[i] = np.array(self._by_cuts(texts[i].as_py()), dtype=np.int64)
            number = np.concatenate(parts)
            bounds = np.cumsum([0, *map(len, parts)])
        self._encode_waiting()
        return self._gather(number, bounds)

    def _special_heads(self, distinct: list[str], heads: np.ndarray) -> np.ndarray:
        return np.array([bool(self.special and self.special.search(distinct[i])) for i in heads.tolist()], dtype=bool)

    def _gather(self, number: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fixed = np.flatnonzero(number < 0)
        fixed_ids = -1 - number[fixed]
        number[fixed] = 0
        size = self.size[number]
        size[fixed] = 1
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(ends[-1]) + np.repeat(self.start[number] - ends[:-1], size)
        take[ends[fixed]] = 0
        ids = self.flat[take] if len(self.flat) else np.zeros(len(take), np.uint32)
        ids[ends[fixed]] = fixed_ids
        return ids, ends[bounds[1:]]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(vocabulary: Vocabulary, library: bool = False) -> Encoder:
    """One encoder for each worker, kept between tasks."""
    key = (vocabulary.name, library)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, library)
    return _ENCODERS[key]


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, text_at: int, library: bool = False):
    """(slice of rows, ids, ends) for each slice of the batches."""
    encoder = encoder_of(vocabulary, library)
    for batch in slices(batches, SLICE):
        yield batch, *encoder.encode(batch.column(text_at))
    give_back()


def digests(docs: DataFrame, *, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes and decodes every text; id, number of ids and both digests."""
    vocabulary = Vocabulary.load(path or vocabulary_path())
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))

    def both(batches):
        for batch, ids, ends in encoded(batches, vocabulary, 1):
            encoder = encoder_of(vocabulary)
            of_ids, of_text, begin = [], [], 0
            for end in ends.tolist():
                own = ids[begin:end]
                of_ids.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(encoder.decode(own).encode()).hexdigest())
                begin = end
            counts = pa.array(np.diff(ends, prepend=0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), counts, pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(both, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, *, path: str | None = None, text_column: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of its text in the array column ``to``."""
    vocabulary = Vocabulary.load(path or vocabulary_path())

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        import pandas as pd

        found = []
        for begin in range(0, len(texts), 256):
            part = pa.array(texts.iloc[begin : begin + 256], pa.string())
            ids, ends = encoder_of(vocabulary).encode(part)
            found += np.split(ids.astype(np.int32), ends[:-1])
        return pd.Series(found, index=texts.index, dtype=object)

    return docs.withColumn(to, ids_of(text_of(text_column)))


def decode(docs: DataFrame, *, path: str | None = None, ids_column: str = "ids", to: str = "text") -> DataFrame:
    """``docs`` with the text of its ids in ``to``; null ids give a null text."""
    vocabulary = Vocabulary.load(path or vocabulary_path())

    @F.pandas_udf("string")
    def text_of_ids(arrays):
        encoder = encoder_of(vocabulary)
        return arrays.map(lambda ids: None if ids is None else encoder.decode(np.asarray(ids)))

    return docs.withColumn(to, text_of_ids(ids_column))


def op8_bpe_encoding_decoding(spark, folder: str) -> DataFrame:
    return digests(documents(spark, folder))
