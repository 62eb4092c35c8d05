import hashlib
import random
import re
import zlib

import pytest

from streamwarden.llm import periodic as P
from tests.llm.fixtures import odd_documents, odd_frame


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words, least):
    """Every run by comparing each word with the one a period before it."""
    n = len(words)
    stretches = {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(least, 3 * q):
                stretches.setdefault((start, i - start), q)  # the smallest period comes first
    runs = sorted((s, m, q) for (s, m), q in stretches.items())
    return sorted(runs, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    return [w for k, w in enumerate(words) if not any(s + q <= k < s + m for s, m, q in runs)]


def samples(rng):
    for _ in range(1500):
        letters = "abc"[: rng.randint(1, 3)]
        words = []
        while len(words) < rng.randint(0, 90):
            part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            words += part * rng.choice([1, 1, 2, 3, 4, 7])
            words += words[-rng.randint(1, 12) :]
        yield words


@pytest.mark.parametrize("least", [3, 6, 24])
def test_squares_of_the_automaton_are_the_runs(least):
    for words in samples(random.Random(least)):
        codes = [ord(w) for w in words]
        found = [(s, last - s + 1, q) for (s, q), last in P.squares(codes).items()]
        found = sorted((r for r in found if r[1] >= max(least, 3 * r[2])), key=lambda r: (r[0], r[2]))
        assert found == plain_runs(words, least)


@pytest.mark.parametrize("least", [6, 24])
def test_stretches_lose_no_run(least):
    rng = random.Random(10 + least)
    for words in samples(rng):
        filler = [f"w{k}" for k in range(rng.randint(0, 20))]
        words = filler + words + filler[::-1] + words[:40]
        runs = P.find_runs(words, least)
        assert runs == plain_runs(words, least)
        assert P.collapse(words, runs) == plain_collapse(words, runs)


def test_words_of_one_kind_and_long_texts():
    assert P.find_runs(["a"] * 24) == [(0, 24, 1)]
    assert P.find_runs(["a"] * 23) == []
    rng = random.Random(5)
    part = [str(rng.random()) for _ in range(20_000)]
    words = part[:777] + part * 4 + part[:5]
    assert P.find_runs(words) == [(0 if words[776] == part[-1] else 777, 80_005, 20_000)]
    assert P.find_runs(["x"] * 100_000 + ["y"]) == [(0, 100_000, 1)]


def test_odd_rows(spark):
    rows = odd_documents()
    rows += [(200, " ".join(["one", "two", "three"] * 12), "x"), (201, "\ta b\n" * 30 + "c", None), (None, "q " * 30, None)]
    docs = odd_frame(spark, rows).withColumnRenamed("id", "RUNS").withColumnRenamed("RUNS", "periodic")
    found = P.periodic_runs(docs).collect()
    assert len(found) == len(rows)
    wanted = []
    for doc_id, text, extra in rows:
        words = split(text)
        runs = plain_runs(words, 24)
        wanted.append((doc_id, text, extra, tuple(runs), " ".join(plain_collapse(words, runs))))
    got = [(r.doc_id, r.text, r.periodic, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    assert P.periodic_runs(odd_frame(spark, [])).collect() == []


def test_query_on_the_smallest_table(spark):
    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in P.op11_periodic_runs(spark, folder).collect()}
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(table)
    some = 0
    for doc_id, text in table:
        words = split(text)
        n = len(words)
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words, 24)
        some += len(runs)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        r = found[doc_id]
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2]) and r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(plain_collapse(words, runs)).encode()).hexdigest()
    assert some > 5
