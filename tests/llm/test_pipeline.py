import re

import pytest

import corpus_pipeline
from streamwarden.llm import bpe, packing
from tests.llm.fixtures import WORDS
from tests.llm.test_jaccard import brute_force, family
from tests.llm.test_packing import check_places
from tests.llm.test_pii import by_rules


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad texts, copies, near copies, personal data, a null and an empty text."""
    place = tmp_path_factory.mktemp("tables")
    texts = family(1, 40, 2) + family(2, 20, 6) + family(4, 10, 1)
    texts += [texts[0], texts[0].replace(" ", "\n", 3), None, "", f"{WORDS[0]} reach a.b@c.de and 10.0.0.1 today please now"]
    texts += [" | ".join(f"{w}%%%" for w in t.split()) for t in family(3, 25, 40)]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    labels = [(i, int("%%%" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{place}/labels.parquet")
    return str(place)


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    results = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if name != "best-fit packing":
            assert docs.columns == columns
        results.append(docs.collect())
    kept, single, apart, masked, packed = results

    assert {r.doc_id for r in kept} <= {r.doc_id for r in before}
    assert not any("%%%" in (r.text or "") for r in kept)
    assert {r.doc_id for r in before if "%%%" not in (r.text or "") and len((r.text or "").split()) > 5} <= {r.doc_id for r in kept}

    plain = {}
    for r in sorted(kept, key=lambda r: r.doc_id):
        plain.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert sorted(map(str, plain.values())) == sorted(map(str, single))

    ordered = sorted(single, key=lambda r: r.doc_id)
    sets, roots = brute_force([r.text for r in ordered])
    assert {r.doc_id for r in apart} == {ordered[i].doc_id for i in range(len(ordered)) if roots[i] == i}

    assert {r.doc_id for r in masked} == {r.doc_id for r in apart}
    for r in masked:
        assert by_rules(r.text or "") == [] and (r.text is None or r.n_chars == len(r.text))

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    lengths = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in masked}
    assert sum(r.length for r in packed) == sum(lengths.values())
    assert check_places(packed, packing.CAPACITY) <= sum(lengths.values()) // packing.CAPACITY + 2


def test_run_is_the_stages_in_a_row(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0
