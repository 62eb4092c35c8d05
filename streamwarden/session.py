"""Session settings every job relies on."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime settings, safe to set on a session somebody else created.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a batch of long texts is held by the JVM and by the Python worker, beside what is made of it
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

# Settings for sessions made here. Recording a call site for every column
# operation costs seconds on long expressions; it can only be switched off at start.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder the cluster names.

    A local folder is made only where all of Spark is one process, as in tests; a
    cluster without the setting is an error, since each machine would write to its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df):
    """Write ``df`` to the checkpoint folder and read it back.

    Used where later passes must see exactly the same rows in the same
    partitions, also after an executor is lost.
    """
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a write deletes its shuffle files when it ends, instead of leaving them until the
    driver happens to collect its garbage. For frames that are not used again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def kept(df: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """``df`` as Parquet in the checkpoint folder and its bytes there, for as long as the block runs.

    For wide rows that are read more than once: by columns they take a fraction of what ``cut``
    takes, and a reader meets the columns it asks for. Rows do not stay in their partitions.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        with shuffles_dropped(spark):
            df.write.option("compression", "zstd").parquet(place)
        yield spark.read.schema(df.schema).parquet(place), store.getContentSummary(folder).getLength()
    finally:
        store.delete(folder, True)


def bounded_side(df, most_rows: int = 100_000, most_bytes: int = 32 << 20):
    """A join side, written once and marked for broadcast only where it was counted to be small.

    Beyond the bound it is left to Spark, which then shuffles both sides.
    """
    from pyspark.sql import functions as F

    df = cut(df)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return F.broadcast(df) if size.n <= most_rows and (size.b or 0) <= most_bytes else df


def local_session(cores: int | str = "*", app: str = "streamwarden", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
    )
    for name, value in {**RUNTIME_SETTINGS, **START_SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
