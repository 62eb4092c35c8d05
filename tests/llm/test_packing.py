import random
import zlib

import numpy as np

from streamwarden.llm import bpe, packing
from tests.llm.fixtures import SCHEMA, odd_documents, odd_frame


def one_by_one(lengths, capacity):
    """The rule over single pieces, a bin at a time."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        own, gap = [], capacity
        for n in list(left):
            if n <= gap:
                own.append(n)
                left.remove(n)
                gap -= n
        if gap and len(own) > 1:
            room, best = gap + own[-1], None
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if a + b <= room and (best is None or a + b > sum(best)):
                        best = (a, b)
            if best and sum(best) > own[-1]:
                left.append(own.pop())
                left.sort(reverse=True)
                for n in best:
                    left.remove(n)
                    own.append(n)
        bins.append(own)
    return bins


def test_counts_give_the_bins_of_single_pieces():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        bins = packing.fill(np.bincount(lengths, minlength=capacity + 1), capacity)
        spread = sorted(n for kind, repeats in bins for n, many in kind for _ in range(many * repeats))
        assert spread == sorted(lengths)
        assert all(sum(n * many for n, many in kind) <= capacity for kind, _ in bins)
        assert sum(repeats for _, repeats in bins) == len(one_by_one(lengths, capacity))


def test_swap_fills_the_gap():
    # 6 + 3 leaves 1; the 3 makes room for 2 + 2
    bins = packing.fill(np.bincount([6, 3, 2, 2], minlength=11), 10)
    assert [dict(kind) for kind, _ in bins][0] == {6: 1, 2: 2}


def check_places(rows, capacity):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin)


def test_pieces_and_places_of_odd_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    rows = odd_documents()
    capacity = 64
    got = packing.pack(packing.pieces(odd_frame(spark, rows), capacity=capacity), capacity=capacity).collect()
    wanted = []
    for doc_id, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        marks = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False)):
            wanted.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(str, wanted)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    used = check_places(got, capacity)
    assert used <= sum(w[3] for w in wanted) // capacity + 3


def test_one_hot_length(spark):
    items = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "IF(id % 3 = 0, 5, id % 7 + 1) AS length")
    got = packing.pack(items.selectExpr("doc_id", "piece", "CAST(length AS long) AS length"), capacity=10).collect()
    assert len(got) == 3000 and len({r.doc_id for r in got}) == 3000
    assert check_places(got, 10) == -(-sum(r.length for r in got) // 10)


def test_empty_table(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], SCHEMA))).count() == 0
