"""Isolation forest: trees are grown in parallel, the model is a table of nodes."""

from __future__ import annotations

import hashlib
import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from streamwarden.operators.features import FEATURE_NAMES, training_window
from streamwarden.operators.route import stable_id
from streamwarden.sources.tables import exists

TREES, SAMPLE, SEED = 100, 256, 42
MIN_SAMPLES, WINDOW = 50, 2000
NODES = "tree int, node int, feature int, threshold double, left int, right int, rows int, sample int"


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def draw(*parts) -> float:
    """A number in [0, 1) that follows from its parts alone, so that any engine can draw it again."""
    text = "|".join(str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2.0**52


def grow(points: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, rows) of one tree; feature -1 marks a leaf.

    The root is node 1, the children of node n are 2 n and 2 n + 1. A node draws the feature
    among those that vary in it, and the threshold between their bounds, from its own number.
    """
    limit = max(1, math.ceil(math.log2(max(len(points), 2))))
    nodes: list[tuple] = []
    waiting = [(1, np.arange(len(points)))]
    while waiting:
        node, inside = waiting.pop(0)
        low, high = points[inside].min(axis=0), points[inside].max(axis=0)
        varied = np.flatnonzero(high > low)
        if node.bit_length() > limit or len(inside) <= 1 or not len(varied):
            nodes.append((node, -1, 0.0, -1, -1, len(inside)))
            continue
        feature = int(varied[int(draw(seed, tree, node, "feature") * len(varied))])
        bound = float(low[feature] + draw(seed, tree, node, "threshold") * (high[feature] - low[feature]))
        below = points[inside, feature] <= bound
        nodes.append((node, feature, bound, 2 * node, 2 * node + 1, len(inside)))
        waiting += [(2 * node, inside[below]), (2 * node + 1, inside[~below])]
    return nodes


def _tree(group: pd.DataFrame) -> pd.DataFrame:
    tree = int(group["tree"].iloc[0])
    ordered = group.sort_values(["draw", "row_key"])
    points = np.stack(ordered["features"].to_numpy()).astype("float64")
    nodes = grow(points, int(group["seed"].iloc[0]), tree)
    out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "rows"])
    return out.assign(tree=tree, sample=len(points))[["tree", "node", "feature", "threshold", "left", "right", "rows", "sample"]]


def fit(window: DataFrame, row_key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Node table of a forest over a training window (features, row_key).

    Each tree draws its sample by a hash of the row's key, so neither row order
    nor partitioning changes the model. No task ever holds more than one sample.
    """
    draws = window.select(F.col(row_key).cast("string").alias("row_key"), "features").withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    )
    ticket = F.md5(F.concat_ws("|", F.lit(seed), "tree", "row_key"))
    drawn = draws.withColumn("draw", ticket).withColumn("seed", F.lit(seed))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("draw", "row_key"))
    return drawn.withColumn("place", place).where(F.col("place") <= sample).groupBy("tree").applyInPandas(_tree, NODES)


class Forest:
    """Arrays of one model, small enough to travel with a task."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        self.trees = []
        for _, t in nodes.groupby("tree"):
            place = {-1: -1} | {n: k for k, n in enumerate(t["node"])}
            sides = [t[side].map(place).to_numpy() for side in ("left", "right")]
            self.trees.append((t["feature"].to_numpy(), t["threshold"].to_numpy(), *sides, t["rows"].to_numpy()))
        self.sample = int(nodes["sample"].iloc[0])

    def decision(self, points: np.ndarray) -> np.ndarray:
        """Below zero means anomalous."""
        depth = np.zeros(len(points))
        rows = np.arange(len(points))
        for feature, threshold, left, right, size in self.trees:
            at = np.zeros(len(points), dtype="int64")
            inner = feature[at] >= 0
            while inner.any():
                here, who = at[inner], rows[inner]
                below = points[who, feature[here]] <= threshold[here]
                at[inner] = np.where(below, left[here], right[here])
                depth[inner] += 1
                inner = feature[at] >= 0
            depth += average_path(size[at])
        mean = depth / len(self.trees)
        return 0.5 - 2.0 ** (-mean / max(float(average_path(self.sample)), 1e-12))


def load(nodes: DataFrame) -> Forest:
    """A model's nodes on the driver: fewer than two per sampled row and tree, whatever the data's size."""
    table = nodes.toPandas()
    if table.duplicated(["tree", "node"]).any():
        raise ValueError("a model has a node twice; its version was not written whole")
    return Forest(table)


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``anomaly_score`` and ``is_anomaly``; scored in Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            points = np.stack(batch.to_numpy()).astype("float64") if len(batch) else np.zeros((0, 1))
            yield pd.Series(forest.decision(points))

    return df.withColumn("anomaly_score", decide("features")).withColumn("is_anomaly", F.col("anomaly_score") < 0)


def anomaly_messages(scored: DataFrame, order_id: Column, detected_at: Column) -> DataFrame:
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    body = F.struct(
        F.lit("anomaly_detected").alias("event_type"),
        stable_id(order_id, F.to_json("features")).alias("report_id"),
        F.lit("isolation_forest_anomaly").alias("monitor_name"),
        order_id.alias("order_id"),
        F.map_from_arrays(names, F.col("features")).alias("features"),
        "anomaly_score",
        detected_at.alias("detected_at"),
    )
    return scored.where("is_anomaly").select(F.lit("anomaly-alerts").alias("topic"), F.to_json(body).alias("value"))


def training_rows(stored: DataFrame, orders: DataFrame, created: str, tie: str, size: int = WINDOW):
    """Stored features when there are enough of them, else features of validated orders."""
    newest = training_window(stored, created, tie, size)
    if newest.count() >= MIN_SAMPLES:
        return newest, "order_features"
    return training_window(orders, created, tie, size), "validated_orders"


def retrain(stored: DataFrame, orders: DataFrame, created: str, tie: str, size: int = WINDOW):
    """(status, nodes or None). Fewer than 50 rows train nothing."""
    window, source = training_rows(stored, orders, created, tie, size)
    n = window.count()
    if n < MIN_SAMPLES:
        return {"status": "skipped", "reason": f"only {n} samples in {source}, need {MIN_SAMPLES}"}, None
    return {"status": "retrained", "n_samples": n, "source": source}, fit(window, tie)


def save(nodes: DataFrame, folder: str, version: int, n_samples: int, trained_at: str) -> None:
    """Write a model version to folders of its own: nodes first, then the metadata that
    makes it visible. Saving a version again replaces it."""
    spark = nodes.sparkSession
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes/model_version={version}")
    meta = spark.createDataFrame(
        [(trained_at, n_samples, list(FEATURE_NAMES))], "trained_at string, n_samples int, feature_names array<string>"
    )
    meta.coalesce(1).write.mode("overwrite").parquet(f"{folder}/models/model_version={version}")


def newest(spark, folder: str, before: int | None = None) -> Forest | None:
    """The latest version (below ``before``) trained on the expected features; others are passed over."""
    if not exists(spark, f"{folder}/models"):
        return None
    models = spark.read.parquet(f"{folder}/models").where(F.col("feature_names") == F.array(*[F.lit(n) for n in FEATURE_NAMES]))
    if before is not None:
        models = models.where(F.col("model_version") < before)
    row = models.agg(F.max("model_version").alias("version")).first()
    if row.version is None:
        return None
    return load(spark.read.parquet(f"{folder}/nodes/model_version={row.version}"))
