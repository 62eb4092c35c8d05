import math
import zlib
from collections import Counter

import numpy as np
import pytest

from streamwarden.llm import lattice_lm as L
from streamwarden.llm.bpe import Vocabulary, vocabulary_path
from tests.llm.fixtures import SCHEMA, odd_documents, odd_frame


@pytest.fixture(scope="module")
def pieces():
    return L.usable_pieces(Vocabulary.load(vocabulary_path()))


def segmentations(word, logs):
    if not word:
        yield 0.0, ()
    for end in range(1, len(word) + 1):
        if word[:end] in logs:
            for rest, found in segmentations(word[end:], logs):
                yield logs[word[:end]] + rest, (word[:end], *found)


def test_forward_and_expected_counts_equal_enumeration(pieces):
    scores = np.log(1 / (np.arange(len(pieces)) + 5) / sum(1 / (np.arange(len(pieces)) + 5)))
    logs = dict(zip(pieces, scores.tolist(), strict=True))
    words = [b"the", b"straining", b"x", "größe".encode(), b"12.50", b"the"]
    times = np.array([3, 1, 2, 1, 1, 4])
    sizes = np.array(list(map(len, words)))
    made, begins = L._spread(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
    table = L.Pieces.of(pieces)
    got = L.word_scores(made, begins, sizes + 1, table, scores)
    uses: Counter = Counter()
    for word, many, one in zip(words, times, got, strict=True):
        every = list(segmentations(b" " + word, logs))
        whole = math.log(sum(math.exp(s) for s, _ in every))
        assert abs(whole - one) < 1e-9
        for s, found in every:
            for piece in found:
                uses[piece] += many * math.exp(s - whole)
    expected = L.expected_counts(made, begins, sizes + 1, times, table, scores)
    for number, piece in enumerate(pieces):
        assert abs(expected[number] - uses[piece]) < 1e-9


@pytest.mark.parametrize("frequent", [10, 2_000_000])
def test_base_scores_of_odd_rows(spark, monkeypatch, frequent, pieces):
    """Both ways a count can come: looked up in the task, or by the join."""
    monkeypatch.setattr(L, "FREQUENT", frequent)
    kept = {}
    train = L.train

    def keep(*args):
        kept["model"] = train(*args)
        return kept["model"]

    monkeypatch.setattr(L, "train", keep)
    rows = odd_documents()
    got = L.score(odd_frame(spark, rows)).collect()
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i, *_ in rows}
    tokens = [((t or "").encode().lower().split() + [b""]) for _, t, _ in rows]
    counts: Counter = Counter()
    for (i, *_), own in zip(rows, tokens, strict=True):
        if fold[i] != 1:
            counts.update(own)
    total, kinds = sum(counts.values()), len(counts)
    scores, end = kept["model"]
    assert abs(np.exp(scores).sum() + math.exp(end) - 1) < 1e-9
    logs = dict(zip(pieces, scores.tolist(), strict=True))

    def marginal(word):
        word = b" " + word
        forward = [0.0]
        for j in range(1, len(word) + 1):
            ways = [forward[i] + logs[word[i:j]] for i in range(max(0, j - 130), j) if word[i:j] in logs]
            top = max(ways)
            forward.append(top + math.log(sum(math.exp(w - top) for w in ways)))
        return forward[-1]

    def line(i, out, n, known, train_tokens, base, score):
        return f"{i} {out} {n} {known} {train_tokens} {base:.6f} {score:.6f}"

    wanted = [
        line(
            i,
            fold[i] == 1,
            len(own),
            sum(counts[w] > 0 for w in own),
            total,
            sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own),
            (sum(marginal(w) for w in own[:-1]) + end) / math.log(10),
        )
        for (i, *_), own in zip(rows, tokens, strict=True)
    ]
    assert sorted(wanted) == sorted(line(*r) for r in got)


def test_slices_without_new_words(spark, monkeypatch):
    """Each row is a slice: texts without words, and texts whose words the task has scored before."""
    monkeypatch.setattr(L, "SLICE", 1)
    texts = ["", "Some words", None, "some WORDS some", " \t", "words", "some words"]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in L.score(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [len((t or "").split()) + 1 for t in texts]
    end = got[0].score
    some, words = got[3].score - got[1].score, got[5].score - end
    for i, text in enumerate(texts):
        own = (text or "").lower().split()
        assert abs(got[i].score - end - some * own.count("some") - words * own.count("words")) < 1e-9


def test_texts_without_any_word(spark):
    got = L.score(spark.createDataFrame([(1, "", None), (2, None, None)], SCHEMA)).collect()
    assert [(r.n_tokens, r.score) for r in got] == [(1, got[0].score)] * 2


def test_empty_table(spark):
    assert L.score(spark.createDataFrame([], SCHEMA)).count() == 0
