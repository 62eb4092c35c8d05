from collections import Counter

from streamwarden.llm import bpe, token_counts
from tests.llm.fixtures import SCHEMA, odd_documents, odd_frame


def test_answers_of_odd_rows(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "BLOCK", 16)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in odd_documents()]
    counts = token_counts.histogram(odd_frame(spark))
    sums = token_counts.suffix_sums(counts).persist()
    rows = sums.collect()
    assert {r.n_tokens: r.documents for r in rows} == Counter(lengths)
    for r in rows:
        n = r.n_tokens
        assert r.documents_up_to == sum(x <= n for x in lengths)
        assert r.documents_longer == sum(x > n for x in lengths)
        assert r.tokens_up_to == sum(x for x in lengths if x <= n)
        assert r.tokens_longer == sum(x for x in lengths if x > n)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
        assert r.total == sum(lengths)
    limits = [0, 1, 2, 5, 50, 77, 1000, 10**6]
    for r in token_counts.at_limits(sums, limits).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in lengths)
        assert r.documents_longer == sum(x > r.context_limit for x in lengths)
    shares = [0.01, 0.5, 0.9, 1.0]
    for r in token_counts.quantiles(sums, shares).collect():
        assert r.n_tokens == min(x for x in lengths if sum(y <= x for y in lengths) >= r.share * len(lengths))


def test_empty_table(spark):
    sums = token_counts.suffix_sums(token_counts.histogram(spark.createDataFrame([], SCHEMA)))
    assert sums.count() == 0
    assert token_counts.at_limits(sums, [10]).count() == 0
    assert token_counts.quantiles(sums, [0.5]).count() == 0
