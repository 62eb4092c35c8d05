import random
import re

import pytest

from streamwarden.llm import substrings as S
from tests.llm.fixtures import odd_documents, odd_frame, prose


def plain(rows, window):
    """(n_words, n_removed, kept) of each row, by a dictionary of all windows."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text, *_ in rows]
    first = {}
    for (doc_id, *_), words in zip(rows, split, strict=True):
        for k in range(len(words) - window + 1):
            content = tuple(words[k : k + window])
            if doc_id is not None:
                first[content] = min(first.get(content, doc_id), doc_id)
    out = []
    for (doc_id, *_), words in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[k : k + window])] < doc_id:
                gone.update(range(k, k + window))
        out.append((doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def check(spark, rows, window=50, gram=16, hot=S.HOT, parts=3):
    frame = odd_frame(spark, rows).repartition(parts)
    found = S.remove_repeats(frame, window=window, gram=gram, hot=hot).collect()
    got = sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in found)
    assert got == sorted(str(r) for r in plain(rows, window))
    return found


def passages(rng, rows, shared, words):
    """Texts of own words with shared passages of several lengths put in, some of them twice."""
    vocabulary = [f"w{k}" for k in range(words)]
    some = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 40))] for _ in range(shared)]
    out = []
    for k in range(rows):
        text = []
        for _ in range(rng.randint(1, 8)):
            part = rng.choice(some)
            cut = rng.randint(0, len(part) - 1)
            text += rng.choice([part, part[cut:], part[: cut + 1]])
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        out.append((k, " ".join(text), None))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_shared_passages_and_divided_anchors(spark, hot):
    rng = random.Random(hot)
    check(spark, passages(rng, 150, 12, 40), window=10, gram=4, hot=hot)


def test_few_words_and_repeats_within_a_text(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))), None) for k in range(120)]
    rows += [(200, "a " * 80, None), (199, "b " * 80, None), (201, "a b " * 50, None)]
    check(spark, rows, window=10, gram=4, hot=3)


def test_odd_rows(spark):
    rng = random.Random(4)
    shared = prose(rng, 70)
    rows = odd_documents()
    rows += [(50, shared, None), (51, f"own {shared} words", None), (51, f"other {shared[20:]} words", None)]
    rows += [(51, prose(rng, 90), None), (None, shared, None), (52, shared.replace(" ", "\n\t "), None)]
    check(spark, rows)
    assert S.remove_repeats(odd_frame(spark, [])).collect() == []


def test_clashing_columns_stay(spark):
    frame = odd_frame(spark).selectExpr("doc_id", "text", "id", "id as row", "id as key", "id as piece", "id as cuts")
    found = S.remove_repeats(frame)
    assert found.columns == [*frame.columns, "n_words", "n_removed", "kept"]
    assert found.count() == frame.count()


def test_automaton_knows_the_oldest_owner():
    rng = random.Random(3)
    for _ in range(200):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))] for _ in range(6)]
        known = S.Automaton()
        for owner, words in enumerate(texts):
            known.append(words, owner)
        asked = [rng.choice([b"a", b"b", b"c"]) for _ in range(40)]
        for window in (1, 3, 5):
            wanted = []
            for k in range(len(asked) - window + 1):
                part = asked[k : k + window]
                wanted.append(
                    next((o for o, t in enumerate(texts) if any(t[i : i + window] == part for i in range(len(t)))), None)
                )
            assert known.owners(asked, window) == wanted


def test_one_long_text_and_a_copy(spark):
    rng = random.Random(6)
    text = " ".join(str(rng.randint(0, 5000)) for _ in range(150_000))
    check(spark, [(1, text, None), (2, f"{text[1000:]} end", None)])
