import hashlib
import random
import re

from streamwarden.llm import exact_dedup as E
from tests.llm.fixtures import SCHEMA, odd_documents, odd_frame


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_normalised_is_the_contracts_rule():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(" \t\n\v\f\rab  é") for _ in range(rng.randint(0, 20)))
        assert E.normalised(text).decode() == plain(text)


def test_fingerprints_of_parts_combine():
    rng = random.Random(2)
    data = rng.randbytes(3 * E.CHUNK + 17)
    values = []
    for prime, point in zip(E.PRIMES, E.POINTS, strict=True):
        value = 0
        for byte in data:
            value = (value * point + byte) % prime
        values.append(value)
    assert E.fingerprint(data) == (len(data), tuple(values))
    for cut in (0, 1, 1000, E.CHUNK, len(data)):
        assert E.join_values(E.fingerprint(data[:cut]), E.fingerprint(data[cut:])) == E.fingerprint(data)


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(plain(text), []).append(doc_id)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def check(spark, rows, primes=E.PRIMES):
    found = E.exact_groups(odd_frame(spark, rows), primes=primes).collect()
    wanted = expected(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in wanted.items()}
    assert sum(r.times for r in found) == len(rows)
    for r in found:
        assert (r.keep_id, r.group_size) == by_digest[r.digest]
    assert sum(r.is_first for r in found) == len(wanted)


def test_groups_of_odd_rows(spark):
    check(spark, odd_documents())


def test_equal_fingerprints_of_different_texts_are_told_apart(spark):
    rows = [(i, t * 2, None) for i, t in enumerate(["ab", "ba", "cd", "ab", "dc", "xy", "ab", "cd"])]
    check(spark, rows, primes=(2, 2))


def test_hot_group_of_long_copies(spark, monkeypatch):
    monkeypatch.setattr(E, "SHARE", 3)
    check(spark, [(i, "long words " * 9000 + ("x" if i == 5 else "y"), None) for i in range(12)])


def test_hot_group_fills_its_shares(spark, monkeypatch):
    monkeypatch.setattr(E, "SHARE", 25)
    seen = []
    pieces_of = E._pieces

    def pieces(rows, placed):
        seen.extend(pieces_of(rows, placed).collect())
        return pieces_of(rows, placed)

    monkeypatch.setattr(E, "_pieces", pieces)
    check(spark, [(i, "same words", None) for i in range(200)])
    members = [r.share for r in seen if not r.is_first]
    assert len(members) == 199
    assert set(members) == {r.share for r in seen if r.is_first} == set(range(8))
    assert max(members.count(share) for share in range(8)) < 60


def test_keep_first_keeps_columns_and_one_row_each(spark):
    rows = odd_documents()
    kept = E.keep_first(odd_frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "id"]
    got = kept.collect()
    assert sorted(plain(r.text) for r in got) == sorted(expected(rows))
    assert {plain(r.text): r.doc_id for r in got} == {t: v[0] for t, v in expected(rows).items()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert E.exact_groups(empty).count() == 0
    assert E.keep_first(empty).count() == 0
