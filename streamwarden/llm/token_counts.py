"""Token counts from an exact histogram of encoded lengths.

Documents are counted by their number of ids inside the tasks that encode them;
only (length, count) rows are shuffled. Suffix sums over the histogram then answer
every context limit: what is kept when texts are cut at the limit, how many are
longer, the whole total, and any quantile. A total cut at a limit that no text
has as its length follows from the next smaller length, so the histogram's rows
answer all limits.

Suffix sums are taken in two steps, inside blocks of ``BLOCK`` lengths and over
the blocks: a text has less than 2**31 ids, so there are at most 2**31 / BLOCK
blocks, whatever the number of documents.

Cases: a null text is empty and has length 0; repeated rows count each time; an
empty table gives an empty histogram and no answers; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamwarden.llm.bpe import Vocabulary, encoded, vocabulary_path
from streamwarden.llm.columns import cut, documents, text_of

BLOCK = 1024


def histogram(docs: DataFrame, *, path: str | None = None, text_column: str = "text") -> DataFrame:
    """(n_tokens, documents): how many texts have each encoded length."""
    vocabulary = Vocabulary.load(path or vocabulary_path())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for _, _, ends in encoded(batches, vocabulary, 0, library=True):
            found.update(np.diff(ends, prepend=0).tolist())
        if found:
            yield pa.RecordBatch.from_pydict({"n_tokens": [*found.keys()], "documents": [*found.values()]})

    return (
        docs.select(text_of(text_column).alias("text"))
        .mapInArrow(counted, "n_tokens long, documents long")
        .groupBy("n_tokens")
        .agg(F.sum("documents").alias("documents"))
    )


def suffix_sums(counts: DataFrame) -> DataFrame:
    """The histogram with, for each length as a limit: texts and ids up to it, texts
    and ids beyond it, the total when texts are cut at it, and the whole total."""
    counts = cut(counts)  # read twice below; a row per length
    blocks = counts.withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "tokens": F.col("n_tokens") * F.col("documents")})
    below = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = (
        blocks.groupBy("block")
        .agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(below), F.lit(0)).alias("later_documents"),
            F.coalesce(F.sum("t").over(below), F.lit(0)).alias("later_tokens"),
            F.sum("d").over(whole).alias("all_documents"),
            F.sum("t").over(whole).alias("all_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.join(later, "block")
        .withColumns(
            {
                "documents_longer": F.coalesce(F.sum("documents").over(inside), F.lit(0)) + F.col("later_documents"),
                "tokens_longer": F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("later_tokens"),
            }
        )
        .select(
            "n_tokens",
            "documents",
            (F.col("all_documents") - F.col("documents_longer")).alias("documents_up_to"),
            (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_up_to"),
            "documents_longer",
            "tokens_longer",
            (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("documents_longer")).alias(
                "truncated_total"
            ),
            F.col("all_tokens").alias("total"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, documents_longer, truncated_total, total) for any limits."""
    lookup = [
        F.max(F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "documents_longer", "tokens_up_to"))).alias(f"l{i}")
        for i, limit in enumerate(limits)
    ]
    answers = sums.agg(F.max("total").alias("total"), F.sum("documents").alias("every"), *lookup)
    each = [
        F.struct(
            F.lit(int(limit)).alias("context_limit"),
            F.coalesce(F.col(f"l{i}.documents_longer"), F.col("every")).alias("documents_longer"),
            (
                F.coalesce(F.col(f"l{i}.tokens_up_to"), F.lit(0))
                + F.lit(int(limit)) * F.coalesce(F.col(f"l{i}.documents_longer"), F.col("every"))
            ).alias("truncated_total"),
            F.col("total"),
        )
        for i, limit in enumerate(limits)
    ]
    return answers.filter("every > 0").select(F.inline(F.array(*each)))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of texts do not exceed."""
    count = F.col("documents_up_to") + F.col("documents_longer")
    found = sums.agg(
        *[F.min(F.when(F.col("documents_up_to") >= F.lit(float(s)) * count, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    )
    each = [F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)]
    return found.select(F.inline(F.array(*each))).filter("n_tokens IS NOT NULL")


def op5_length_histogram(spark, folder: str) -> DataFrame:
    return suffix_sums(histogram(documents(spark, folder)))
