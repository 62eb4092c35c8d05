"""Marginal likelihood of texts under a unigram model of subwords.

The pieces are those of an existing vocabulary (its byte strings without inner
blanks and capitals). A word with its leading blank can be cut into pieces in many
ways; its probability is the sum over all of them, worked out by the forward
recursion in log space over every place of the word, for all new words of a slice
at once. A text is its words and one end, so its probability is their product.

The piece scores start from the vocabulary's own order (a piece of rank r weighs
1 / (r + ``RANK_SHIFT``)) and take one expectation step over the distinct words of
all training texts with their counts; ``PRIOR`` pieces' worth of the starting scores
keep unseen pieces possible. Pieces and end sum up to one.

Word counts are exact. Words are counted inside the tasks first and then by
aggregation. Words with at least 1 / ``FREQUENT`` of all tokens (there cannot be more
than ``FREQUENT`` of them) are looked up in each task; for all rarer ones the counts
come by a join, in which a rare word has few rows by construction. Words are
matched by a 64-bit hash in that join.

Cases: a null text is empty and scores its end alone. Rows are scored one by one, so
null and repeated ids stay as they are; a null id belongs to the fold of the empty
text. Without training texts counts are 0 and the starting scores hold. An empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamwarden.llm.bpe import Vocabulary, vocabulary_path
from streamwarden.llm.columns import cut, documents, slices, text_of
from streamwarden.llm.jaccard import BACK, BYTE_VALUES, STEP, U, _power_table, mixed, word_hashes

FREQUENT = 2_000_000
RANK_SHIFT = 10
PRIOR = 1000.0
FOLDS = 5
SLICE = 2 << 20  # bytes of text taken at once; working arrays are some 40 times that
CELLS = 1_000_000  # lattice cells worked on at once
REMEMBERED = 500_000  # words whose score a task keeps from slice to slice, 16 bytes each
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END = 0  # the hash of the empty word


def usable_pieces(vocabulary: Vocabulary) -> list[bytes]:
    """Pieces a lower-cased word with its leading blank can have, in the vocabulary's order."""
    found = []
    for number, token in enumerate(vocabulary.token_bytes):
        plain = token[1:] if token[:1] == b" " else token
        capital = any(65 <= b <= 90 for b in token)
        blank = any(b == 32 or 9 <= b <= 13 for b in plain)
        if token and not capital and not blank and number not in vocabulary.special.values():
            found.append(token)
    return found


def _prefix_sums(matrix: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers of the place, one row per word."""
    values = BYTE_VALUES[matrix] * _power_table(STEP, matrix.shape[1])[: matrix.shape[1]]
    return np.concatenate([np.zeros((len(matrix), 1), U), np.cumsum(values, axis=1, dtype=U)], axis=1)


@dataclass
class Pieces:
    """Sorted hashes of the pieces, and a bitmap that rules most strings out."""

    hashes: np.ndarray
    index: np.ndarray
    longest: int
    bitmap: np.ndarray
    count: int

    MASK = (1 << 22) - 1

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        hashes = np.zeros(len(pieces), dtype=U)
        with np.errstate(over="ignore"):
            for i, piece in enumerate(pieces):
                hashes[i] = mixed(_prefix_sums(np.frombuffer(piece, np.uint8)[None, :])[0, -1:])[0]
        order = np.argsort(hashes)
        bitmap = np.zeros(cls.MASK + 1, dtype=bool)
        bitmap[(hashes & U(cls.MASK)).astype(np.int64)] = True
        return cls(hashes[order], order, max(map(len, pieces)), bitmap, len(pieces))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, -1 where there is none."""
        flat = hashes.reshape(-1)
        found = np.full(len(flat), -1, dtype=np.int32)
        maybe = np.flatnonzero(self.bitmap[(flat & U(self.MASK)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, flat[maybe]), self.count - 1)
        found[maybe] = np.where(self.hashes[at] == flat[maybe], self.index[at], -1)
        return found.reshape(hashes.shape)


def _groups(starts: np.ndarray, sizes: np.ndarray, longest: int):
    """Words of one length at a time, as many as fit into ``CELLS``."""
    order = np.argsort(sizes, kind="stable")
    if not len(order):  # a slice without words, or with remembered ones only
        return
    bounds = np.flatnonzero(np.append(True, np.diff(sizes[order]) > 0))
    for a, b in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
        size = int(sizes[order[a]])
        step = max(1, CELLS // (size * min(size, longest)))
        for start in range(a, b, step):
            yield size, order[start : min(start + step, b)]


def _lattice(data: np.ndarray, starts: np.ndarray, size: int, pieces: Pieces) -> np.ndarray:
    """Piece number by word, end place - 1 and length - 1; -1 where there is none."""
    matrix = data[starts[:, None] + np.arange(size)]
    sums = _prefix_sums(matrix)
    width = min(size, pieces.longest)
    ends, lengths = np.meshgrid(np.arange(1, size + 1), np.arange(1, width + 1), indexing="ij")
    valid = lengths <= ends
    ends, lengths = ends[valid], lengths[valid]
    begins = ends - lengths
    hashes = mixed((sums[:, ends] - sums[:, begins]) * _power_table(BACK, size + 1)[begins])
    found = np.full((len(starts), size, width), -1, dtype=np.int32)
    found[:, ends - 1, lengths - 1] = pieces.find(hashes)
    return found


def _log_sum(values: np.ndarray) -> np.ndarray:
    top = values.max(axis=1)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(values - top[:, None]).sum(axis=1))


def _forward(logs: np.ndarray) -> np.ndarray:
    rows, size, width = logs.shape
    forward = np.full((rows, size + 1), -np.inf)
    forward[:, 0] = 0
    for end in range(1, size + 1):
        m = min(end, width)
        forward[:, end] = _log_sum(forward[:, end - m : end][:, ::-1] + logs[:, end - 1, :m])
    return forward


def _logs(found: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.where(found >= 0, scores[found], -np.inf)


def word_scores(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces: Pieces, scores: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability, summed over all its segmentations."""
    out = np.zeros(len(starts))
    with np.errstate(over="ignore"):
        for size, chosen in _groups(starts, sizes, pieces.longest):
            out[chosen] = _forward(_logs(_lattice(data, starts[chosen], size, pieces), scores))[:, -1]
    return out


def expected_counts(data, starts, sizes, times: np.ndarray, pieces: Pieces, scores: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of all words."""
    total = np.zeros(pieces.count)
    with np.errstate(over="ignore"):
        for size, chosen in _groups(starts, sizes, pieces.longest):
            found = _lattice(data, starts[chosen], size, pieces)
            logs = _logs(found, scores)
            forward = _forward(logs)
            width = logs.shape[2]
            backward = np.full_like(forward, -np.inf)
            backward[:, size] = 0
            for begin in range(size - 1, -1, -1):
                m = min(size - begin, width)
                ends = begin + np.arange(1, m + 1)
                ways = logs[:, ends - 1, np.arange(m)]
                backward[:, begin] = _log_sum(backward[:, ends] + ways)
                use = np.exp(forward[:, begin, None] + ways + backward[:, ends] - forward[:, -1:]) * times[chosen][:, None]
                number = found[:, ends - 1, np.arange(m)]
                real = number >= 0
                total += np.bincount(number[real], weights=use[real], minlength=pieces.count)
    return total


def _spread(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words in one lower-cased array, a blank before each, and their starts."""
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    total = int(ends[-1]) if len(ends) else 0
    take = np.arange(total) + np.repeat(starts - begins - 1, sizes + 1)
    made = LOWER[data[np.maximum(take, 0)]] if total else np.zeros(0, np.uint8)
    made[begins] = 32
    return made, begins


class Words:
    """The words of a slice of texts: hash of each, where each text's words end."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        limits = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.data = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
        with np.errstate(over="ignore"):
            self.hashes, starts = word_hashes(self.data)
        self.bounds = np.searchsorted(starts, limits)
        self.distinct, first, self.number, self.times = np.unique(
            self.hashes, return_index=True, return_inverse=True, return_counts=True
        )
        blank = np.append(np.flatnonzero((self.data == 32) | ((self.data >= 9) & (self.data <= 13))), len(self.data))
        self.starts = starts[first]
        self.sizes = blank[np.searchsorted(blank, self.starts)] - self.starts


def held_out(id_column: str, fold: int = 1):
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % FOLDS == fold


def word_counts(rows: DataFrame) -> DataFrame:
    """(hash, word, many) over all texts; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "word", "many"]
        for batch in slices(batches, SLICE):
            words = Words(batch.column(0).to_pylist())
            made, begins = _spread(words.data, words.starts, words.sizes)
            bytes_of = np.delete(made, begins) if len(begins) else made
            offsets = np.concatenate([[0], np.cumsum(words.sizes)]).astype(np.int32)
            column = pa.BinaryArray.from_buffers(
                pa.binary(), len(words.sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(bytes_of.tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.distinct.view(np.int64)), column, pa.array(words.times.astype(np.int64))], names=names
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([END], pa.int64()), pa.array([b""], pa.binary()), pa.array([batch.num_rows], pa.int64())], names=names
            )

    counted = rows.select("text").mapInArrow(count, "hash long, word binary, many long")
    return counted.groupBy("hash", "word").agg(F.sum("many").alias("many"))


def train(counts: DataFrame, pieces: list[bytes]) -> tuple[np.ndarray, float]:
    """Natural log scores of the pieces, and of the end."""
    start = 1 / (np.arange(len(pieces)) + RANK_SHIFT)
    start /= start.sum()
    table, scores = Pieces.of(pieces), np.log(start)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(scores))
        for batch in batches:
            words = batch.column(0).to_pylist()
            sizes = np.array(list(map(len, words)), dtype=np.int64)
            data = np.frombuffer(b"".join(words), dtype=np.uint8)
            made, begins = _spread(data, np.cumsum(sizes) - sizes, sizes)
            total += expected_counts(made, begins, sizes + 1, batch.column(1).to_numpy(), table, scores)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(used.astype(np.int64)), "many": pa.array(total[used])})

    expected = counts.filter(F.length("word") > 0).select("word", "many").mapInArrow(expect, "piece long, many double")
    found = expected.groupBy("piece").agg(F.sum("many").alias("many")).toPandas()  # a row per piece at most
    many = PRIOR * start
    many[found["piece"].to_numpy()] += found["many"].to_numpy()
    ends = (counts.filter(F.col("hash") == END).agg(F.sum("many")).first()[0] or 0) + 1
    total = many.sum() + ends
    return np.log(many / total), float(np.log(ends / total))


def score(docs: DataFrame, *, path: str | None = None, id_column="doc_id", text_column="text") -> DataFrame:
    """Both scores of every text; see the module's text for the columns' meaning."""
    pieces = usable_pieces(Vocabulary.load(path or vocabulary_path()))
    rows = docs.select(
        F.col(id_column).alias("id"), text_of(text_column).alias("text"), held_out(id_column).alias("held_out")
    )
    counts = cut(word_counts(rows.filter("NOT held_out").select("text")))
    tokens, kinds = (x or 0 for x in counts.agg(F.sum("many"), F.count("*")).first())
    scores, end_score = train(counts, pieces)
    table = Pieces.of(pieces)
    least = max(1, -(-tokens // FREQUENT))
    known = counts.filter(F.col("many") >= least).select("hash", "many").toPandas()  # FREQUENT rows at most
    known = known.sort_values("hash")
    known_hashes, known_counts = known["hash"].to_numpy(np.int64), known["many"].to_numpy(np.int64)
    weight = tokens + 0.5 * (kinds + 1)
    end_at = np.searchsorted(known_hashes, END)
    end_known = end_at < len(known_hashes) and known_hashes[end_at] == END
    if not end_known and tokens:  # the end can be rarer than the frequent words
        end_count = counts.filter(F.col("hash") == END).agg(F.sum("many")).first()[0] or 0
    else:
        end_count = int(known_counts[end_at]) if end_known else 0
    id_type = rows.schema["id"].dataType.simpleString()
    schema = (
        f"row long, is_word boolean, key long, n long, id {id_type}, held_out boolean, "
        "n_tokens long, n_known long, base_score double, score double"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        told, told_logs = np.zeros(0, np.int64), np.zeros(0)
        for batch in slices(batches, SLICE):
            row = batch.column(0).to_numpy()
            words = Words(batch.column(2).to_pylist())
            own = words.distinct.view(np.int64)
            logs = np.zeros(len(own))
            fresh = np.ones(len(own), dtype=bool)
            if len(told):
                at = np.minimum(np.searchsorted(told, own), len(told) - 1)
                fresh = told[at] != own
                logs = np.where(fresh, 0, told_logs[at])
            made, begins = _spread(words.data, words.starts[fresh], words.sizes[fresh])
            logs[fresh] = word_scores(made, begins, words.sizes[fresh] + 1, table, scores)
            if len(told) + fresh.sum() <= REMEMBERED:
                told, told_logs = np.append(told, own[fresh]), np.append(told_logs, logs[fresh])
                order = np.argsort(told)
                told, told_logs = told[order], told_logs[order]
            many = np.zeros(len(own), np.int64)
            if len(known_hashes):
                at = np.minimum(np.searchsorted(known_hashes, own), len(known_hashes) - 1)
                many = np.where(known_hashes[at] == own, known_counts[at], 0)
            base = np.where(many > 0, np.log10((many + 0.5) / weight), 0) if len(own) else np.zeros(0)
            edges = words.bounds

            def per_text(values, edges=edges, number=words.number):
                sums = np.concatenate([[0], np.cumsum(values[number])])
                return sums[edges[1:]] - sums[edges[:-1]]

            n_tokens = np.diff(edges) + 1
            n_known = per_text((many > 0).astype(np.int64)) + (end_count > 0)
            # summed text by text: a running sum over a whole slice would lose digits
            text_base = np.array([base[words.number[a:b]].sum() for a, b in zip(edges[:-1], edges[1:], strict=True)])
            text_score = np.array([logs[words.number[a:b]].sum() for a, b in zip(edges[:-1], edges[1:], strict=True)])
            end_base = np.log10((end_count + 0.5) / weight)
            rows_here = len(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row),
                    pa.array(np.zeros(rows_here, bool)),
                    pa.array(row),
                    pa.array(np.zeros(rows_here, np.int64)),
                    batch.column(1),
                    batch.column(3),
                    pa.array(n_tokens.astype(np.int64)),
                    pa.array(n_known.astype(np.int64)),
                    pa.array(text_base + end_base),
                    pa.array((text_score + end_score) / np.log(10)),
                ],
                names=names,
            )
            # the rarer words of each text, to be counted by the join
            rare = np.flatnonzero(many[words.number] == 0)
            if len(rare):
                text_number = np.searchsorted(edges, rare, side="right") - 1
                pair = text_number * len(own) + words.number[rare]
                pairs, times = np.unique(pair, return_counts=True)
                text_number, word = np.divmod(pairs, len(own))
                none = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row[text_number]),
                        pa.array(np.ones(none, bool)),
                        pa.array(own[word]),
                        pa.array(times.astype(np.int64)),
                        pa.nulls(none, batch.column(1).type),
                        *(pa.nulls(none, t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())),
                    ],
                    names=names,
                )

    # the number holds within this one pass only
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text", "held_out")
    parts = numbered.mapInArrow(read, schema)
    rarer = counts.filter(F.col("many") < least).select(F.col("hash").alias("key"), F.lit(True).alias("is_word"), "many")
    many = F.coalesce("many", F.lit(0))
    joined = parts.join(rarer, ["key", "is_word"], "left").select(
        "row",
        "id",
        "held_out",
        "n_tokens",
        F.when(F.col("is_word"), F.when(many > 0, F.col("n")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(F.col("is_word"), F.col("n") * F.log10((many + 0.5) / F.lit(float(weight)))).otherwise(F.col("base_score")).alias("base"),
        "score",
    )
    return (
        joined.groupBy("row")
        .agg(
            F.max("id").alias("doc_id"),
            F.bool_or("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.sum("base").alias("base_score"),
            F.max("score").alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
    )


def op9_subword_lattice(spark, folder: str) -> DataFrame:
    return score(documents(spark, folder))
