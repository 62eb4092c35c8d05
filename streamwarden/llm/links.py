"""Connected components of links between rows, by alternating large and small stars.

Each step hooks the neighbours of every row to the smallest of them; the number of
steps grows with the logarithm of the longest chain. Every step is an aggregate
(combined before its shuffle) and a join of thin rows, written to the checkpoint
folder; nothing but two numbers per step reaches the driver. Steps run in as many tasks
as the links fill: each task of a shuffle leaves files of its own, and few links in many
tasks take more room by their files than by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamwarden.llm.columns import cut

LINKS_A_TASK = 1 << 16


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """For each row, its larger neighbours hook to its smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    hooked = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hooked.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """For each row, itself and its smaller neighbours hook to the smallest."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    hooked = edges.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hooked.unionByName(low.select("a", F.col("low").alias("b"))).coalesce(tasks).distinct().coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every row that has a link; ``links`` has ``a`` and ``b``."""
    edges = cut(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    tasks = -(-edges.count() // LINKS_A_TASK) or 1
    seen = None
    while True:
        edges = cut(_small_star(_large_star(edges, tasks), tasks))
        # unchanged: every row points at a smallest one, whatever order rows come in
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == seen:
            break
        seen = state
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
