import hashlib
import random
import re

import numpy as np
import pytest

from streamwarden.llm import pii
from tests.llm.fixtures import SCHEMA, odd_documents, odd_frame


def by_rules(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
        if 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_rules():
    rng = random.Random(3)
    parts = [*"0123456789" * 2, ".", ".", "@", "a", "b.", "-", " ", "+", "(", ")", "4111111111111111", "a@b.c", "1.2.3.4", "é", "+1 (555) 123-4567", "_", "٣"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == by_rules(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 100_000, "1." * 100_000, "@" * 100_000, "a" * 100_000 + "@", "+1" + " " * 100_000, "+1" * 50_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    examples = []
    for _ in range(60):
        digits = [rng.randint(0, 9) for _ in range(15)]
        check = next(d for d in range(10) if pii.luhn("".join(map(str, [*digits, d]))))
        card = "".join(map(str, [*digits, check]))
        phone = f"+1 ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        for piece in (card, phone, ip, f"ab{rng.randint(1, 99)}@mail.example.com", f"{rng.randint(1, 10**6)}", f"{rng.randint(1, 9)}.0.", f"x{rng.randint(1, 10**9)}y"):
            spans = pii.base_spans(piece)
            examples.append((piece, spans))
            if spans:
                examples.append(pii.rewritten(piece, spans))
    return pii.Field().train(examples)


def test_marginals_equal_enumeration(field):
    """Forward and backward sums against a list of all segmentations."""
    for text in ("1.2.3.4", "a@b.co 12", "(555) 123-4567"):
        lattice = pii.Lattice(text)
        scores, out = field._scores(lattice), pii.STATES - 1
        size = len(lattice.borders) - 1

        def walk(at, last, lattice=lattice, scores=scores, size=size, out=out):
            if at == size:
                yield 0.0, ()
                return
            for rest, found in walk(at + 1, out):
                yield rest + field.steps[last, out], found
            for n, (i, j) in enumerate(lattice.segments):
                if i == at:
                    for y in range(out):
                        if lattice.allowed[n, y]:
                            for rest, found in walk(j, y):
                                yield rest + field.steps[last, y] + scores[n, y], ((n, y), *found)

        every = list(walk(0, out))
        total, chances, _ = field.marginals(lattice)
        logs = np.array([s for s, _ in every])
        whole = np.logaddexp.reduce(logs)
        assert abs(total - whole) < 1e-9
        for n, y in np.ndindex(*chances.shape):
            wanted = sum(np.exp(s - whole) for s, found in every if (n, y) in found)
            assert abs(chances[n, y] - wanted) < 1e-9
        assert tuple(field.best(lattice)) == every[int(np.argmax(logs))][1]


def test_field_adds_what_the_rules_cannot_see(field):
    text = "pay 4111.1111.1111.1111 or call (555) 123-4567 soon, v2.0. 12345678 2024-01-05"
    base, every = pii.all_spans(text, field)
    assert base == []
    assert [(k, text[a:b]) for k, a, b in every] == [("card", "4111.1111.1111.1111"), ("phone", "(555) 123-4567")]


def test_odd_rows(spark, field):
    rows = odd_documents()
    got = pii.find(odd_frame(spark, rows), field).collect()
    wanted = []
    for doc_id, text, _ in rows:
        base = by_rules(text or "")
        counts = [sum(s[0] == k for s in base) for k in pii.KINDS]
        wanted.append((doc_id, *counts, hashlib.sha256(pii.joined(base).encode()).hexdigest()))
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)[:6]) for r in got)
    for r in got:
        assert all(s in r.spans.split(",") for s in pii.joined(by_rules(dict((i, t) for i, t, _ in rows[:15]).get(r.doc_id) or "")).split(",")) or r.doc_id in (3, None)


def test_masking_keeps_columns(spark):
    frame = odd_frame(spark).selectExpr("doc_id", "text", "length(text) AS n_chars", "id")
    masked = pii.mask(frame)
    assert masked.columns == frame.columns
    rows = masked.collect()
    assert len(rows) == len(odd_documents()) and sum(r.text is None for r in rows) == 2
    for r in rows:
        assert by_rules(r.text or "") == [] and (r.text is None or r.n_chars == len(r.text))
    assert any("<EMAIL>" in (r.text or "") and "<IP>" in r.text for r in rows)
    assert pii.mask(spark.createDataFrame([], SCHEMA)).count() == 0
