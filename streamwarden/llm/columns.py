"""Small shared helpers: clash-free column names, row numbers, batches of text.

Every operator keeps the columns it is given. Working columns carry a prefix that
is lengthened until no given column has it (Spark's names ignore case).
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamwarden.session import cut, use_checkpoint_dir

__all__ = ["cut", "documents", "free_name", "give_back", "slices", "text_of", "written"]


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table in the same shared folder; for the larger ones."""
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until ``df`` has no column of that name."""
    taken = {name.lower() for name in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(name: str = "text"):
    """Null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most_bytes``: long texts come few at a time.

    A single row is never split, so a piece holds one row at least.
    """
    for batch in batches:
        rows, size = batch.num_rows, max(batch.get_total_buffer_size(), 1)
        step = max(1, min(rows, rows * most_bytes // size)) if rows else 1
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker lives on for later stages, and what
    one stage needed at its peak would count in all that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
