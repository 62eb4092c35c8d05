import textwrap

from streamwarden.llm import licences
from streamwarden.llm.licence_texts import LONG_TEXTS, NOTICES, TEXTS
from tests.llm.fixtures import SCHEMA, odd_documents, odd_frame


def test_whole_texts_in_other_guises(spark):
    mit = TEXTS["MIT"]
    rows = [
        (1, mit, None),
        (2, f"MIT Licence\n\nCopyright (c) 2020 Somebody\nAll rights reserved.\n\n{mit.upper()}", None),
        (3, "# " + mit.replace("\n", "\n# ").replace('"', "'"), None),
        (4, mit.replace("sublicense", "sub-license"), None),
        (5, mit + " And more.", None),
        (6, "x\n" + NOTICES["MIT"] + "\ny\nlicensed under cc by-nc 4.0\n" + NOTICES["MIT"], None),
        (7, NOTICES["GPL-3.0-only"], None),
        (8, TEXTS["BSD-3-Clause"], None),
        (9, "licensed to kill", None),
    ]
    got = {r.doc_id: r for r in licences.scan(odd_frame(spark, rows)).collect()}
    assert [got[i].text_licence for i in range(1, 10)] == ["MIT"] * 4 + [None, None, "GPL-3.0-only", "BSD-3-Clause", None]
    assert (got[6].n_notices, got[6].notices) == (3, "CC-BY-NC-4.0,MIT")
    assert got[1].text_digest == got[3].text_digest == got[4].text_digest
    assert got[9].n_notices == 0 and got[9].notices == ""


def wrapped(text, width):
    """``text`` with its paragraphs filled to ``width``; on one line for None."""
    if width is None:
        return " ".join(text.split())
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in text.split("\n\n"))


def test_wrapping_does_not_matter(spark):
    cases = [(n, w, wrapped(t, w)) for n, t in TEXTS.items() for w in [None, *range(20, 121, 4), 300]]
    got = licences.scan(odd_frame(spark, [(i, t, None) for i, (_, _, t) in enumerate(cases)])).collect()
    assert [(cases[r.doc_id][:2], r.text_licence) for r in got if r.text_licence != cases[r.doc_id][0]] == []
    assert len({r.text_digest for r in got}) == len(TEXTS)


def test_long_texts_are_known(spark):
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {n for n, _ in LONG_TEXTS}
    cases = [(n, w, t if w == 0 else wrapped(t, w)) for n, t in LONG_TEXTS for w in [0, None, *range(20, 121, 9), 300]]
    cases += [(n, "terms", t.split("END OF TERMS")[0]) for n, t in LONG_TEXTS]
    cases += [("Apache-2.0-header", 0, TEXTS["Apache-2.0-header"])]
    got = licences.scan(odd_frame(spark, [(i, t, None) for i, (_, _, t) in enumerate(cases)])).collect()
    assert len(got) == len(cases)
    assert [(cases[r.doc_id][:2], r.text_licence) for r in got if r.text_licence != cases[r.doc_id][0]] == []


def test_known_digests_differ(spark):
    known = licences.known_digests(spark)
    assert known.select("known_digest", "whole").distinct().count() == known.count()


def test_only_notices_are_dropped(spark):
    mit = TEXTS["MIT"]
    notices = [
        "Copyright (c) 2020 Somebody",
        "© 2019-2021 Somebody and others. All rights reserved.",
        "(C) Copyright 1999 Somebody",
        " * Copyright: 2001, 2003 Somebody\n * All rights reserved.",
        "Copyright <YEAR> <HOLDER>",
        "Copyright (c) Somebody Inc.",
        "Copyright Somebody and other contributors\nCopyright Others\r",
    ]
    words = [
        "copyright holders may use this text in",
        "(c) You must retain all notices;",
        "Words above\ncopyright notice and this permission notice",
        "Copyright (c) 2020 Somebody. " + "Words of a licence. " * 20,
    ]
    rows = [(i, f"MIT License\n\n{n}\n\n{mit}", None) for i, n in enumerate(notices)]
    rows += [(100 + i, f"x\n{w}\ny", None) for i, w in enumerate(words)]
    rows += [(200 + i, f"x {' '.join(w.split())} y", None) for i, w in enumerate(words)]
    rows += [(300, "x\ny", None)]
    got = {r.doc_id: r for r in licences.scan(odd_frame(spark, rows)).collect()}
    assert [got[i].text_licence for i in range(len(notices))] == ["MIT"] * len(notices)
    for i in range(len(words)):
        assert got[100 + i].text_digest == got[200 + i].text_digest != got[300].text_digest


def test_every_notice_has_the_mark():
    assert all(licences.MARK in text.lower() for text in NOTICES.values())


def test_odd_rows(spark):
    got = licences.scan(odd_frame(spark)).collect()
    assert len(got) == len(odd_documents())
    empty = {r.text_digest for r in got if r.doc_id in (0, 1, 2)}
    assert len(empty) == 1
    assert licences.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_has_no_python(spark):
    plan = licences.scan(odd_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
