"""A training-data pipeline over ``documents``: each stage works on all that the one
before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
the next documents. All but the last keep the columns of ``documents``; the last packs
what is left. The stages' own modules say what each does with nulls, empty and long
texts, repeated rows, empty tables and further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamwarden.llm import exact_dedup, jaccard, packing, pii, quality
from streamwarden.session import cut, prepare


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below its threshold."""
    labels = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.keep_good(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text (white space aside) the one with the smallest id stays."""
    prepare(spark)
    return exact_dedup.keep_first(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    prepare(spark)
    return jaccard.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    prepare(spark)
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    prepare(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_similar),
    ("PII", mask_personal_data),
    ("best-fit packing", pack_sequences),
]

# Learned models and tokenizer ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage keeps is written to the checkpoint folder once."""
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    *others, (_, last) = STAGES
    for _, stage in others:
        docs = cut(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
