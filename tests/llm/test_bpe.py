import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from streamwarden.llm import bpe
from tests.llm.fixtures import SCHEMA, odd_documents, odd_frame

PARTS = [
    "a", "b", "the", " ", "  ", "\n", " \n", "\t", " ", "é", "中文", "👍🏽", "١٢", "²", "Ⅷ", "_", "'s", "'ll",
    "<|endoftext|>", "...", "!", "1", "23", "​", "\x1c", "\x85", " ", "a" * 300, "xyz" * 200, "ß", "﻿", "\x00",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(bpe.vocabulary_path())


@pytest.mark.parametrize("by_library", [False, True])
def test_ids_equal_the_tokenizer_library(library, vocabulary, by_library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["", " ", "a"]
    encoder = bpe.Encoder(vocabulary, by_library)
    for begin in range(0, len(texts), 100):
        part = texts[begin : begin + 100]
        ids, ends = encoder.encode(pa.array(part, pa.string()))
        for text, own in zip(part, np.split(ids, ends[:-1]), strict=True):
            wanted = library.encode(text, add_special_tokens=False).ids
            assert own.tolist() == wanted
            assert encoder.decode(own) == library.decode(wanted, skip_special_tokens=False) == text


def test_long_words_follow_the_same_merges(vocabulary):
    rng = random.Random(5)
    for _ in range(30):
        word = bytes(rng.choice(b"abcethe in") for _ in range(rng.randint(1, 200)))
        assert bpe.merge_long(word, vocabulary).tolist() == bpe.merge_words([word], vocabulary)[0].tolist()


def test_table_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 10)
    encoder = bpe.Encoder(vocabulary)
    for n in range(20):
        encoder.encode(pa.array([f"word{n} other{n} more{n}"]))
        assert len(encoder.table) <= 10 + 3


def test_digests_of_odd_rows(spark, library):
    rows = odd_documents()
    found = bpe.digests(odd_frame(spark, rows)).collect()
    wanted = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        wanted.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in found)
    assert bpe.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_round_trip_of_columns(spark):
    frame = odd_frame(spark)
    back = bpe.decode(bpe.encode(frame, to="ids"), ids_column="ids", to="back").collect()
    assert len(back) == len(odd_documents()) and all(r.back == (r.text or "") for r in back)
