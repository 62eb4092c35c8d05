"""Readers for the tables the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamwarden.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether anything has been written there; a store that fails is an error, not a no."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``ts`` as an instant (files hold it without a zone)."""
    raw = table(spark, folder, "events")
    return raw.withColumn("ts", raw.ts.cast("timestamp"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "orders")
    return raw.withColumn("o_orderdate", raw.o_orderdate.cast("timestamp"))


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "lineitem")
    return raw.withColumn("l_shipdate", raw.l_shipdate.cast("timestamp"))
