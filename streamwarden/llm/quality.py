"""Quality by positive-unlabelled learning with a non-negative risk.

Trusted good texts (label 1) and unlabelled web text train a linear scorer; bad
texts are never shown as such. With the share ``prior`` of good texts, the risk is

    prior * E_good[loss(+)] + max(0, E_all[loss(-)] - prior * E_good[loss(-)])

The second term estimates the risk on bad texts and must not fall below zero: while
it does, a step goes against it alone. The prior is estimated as the share of good
texts among the labelled rows of the training folds; without labelled bad ones
``DEFAULT_PRIOR`` holds.

Features are shares of neighbouring character classes over the whole text, how often
words and lines repeat, and length; no label, language, source or id enters. They
are worked out in one pass per text. Training sees ``GOOD`` good and ``UNLABELLED``
unlabelled rows at most, those with the smallest hash of their id, a documented bound;
all rows are scored.

Cases: a null text is empty and gets a score like any text. Without a good row to
learn from every score is the prior. A row with a null id counts as held out; repeated
ids are scored each, a doc whose labels disagree is not a trusted one, labels of
unknown documents do nothing. Empty tables give empty results; other columns play
no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamwarden.llm.columns import documents, free_name, give_back, text_of

FOLDS = 5
GOOD = 4000
UNLABELLED = 8000
THRESHOLD = 0.3
DEFAULT_PRIOR = 0.5
STEPS = 400
RATE = 0.05
DECAY = 1e-3

CLASSES = 20


def _class_table() -> np.ndarray:
    """A class for each byte: letters, digits, blanks, stops, single marks, the rest."""
    table = np.full(256, 19)
    for number, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r")):
        table[list(members)] = number
    for number, members in enumerate((b".", b",", b";:!?", b"'\"", b"()[]{}<>", b"-_/\\", b"|", b"%", b"&", b"$", b"*", b"#", b"@=+~^`"), 5):
        table[list(members)] = number
    table[128:] = 18
    return table


TABLE = _class_table()
WIDTH = CLASSES * CLASSES + 6


def features(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass")
    row = np.zeros(WIDTH, dtype=np.float32)
    kind = TABLE[np.frombuffer(data, dtype=np.uint8)]
    if len(kind) > 1:
        pairs = np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES)
        row[:-6] = np.sqrt(pairs / (len(kind) - 1))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    if words:
        seen = Counter(words)
        row[-6] = len(seen) / len(words)
        row[-5] = max(seen.values()) / len(words)
        row[-4] = min(len(data) / len(words), 50) / 10
        row[-3] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    if lines:
        row[-2] = len(set(lines)) / len(lines)
    row[-1] = np.log1p(len(words)) / 5
    return row


def _slopes(scores: np.ndarray, sign: int) -> np.ndarray:
    """Derivative of log(1 + exp(-sign * score))."""
    return -sign / (1 + np.exp(np.clip(sign * scores, -60, 60)))


def _loss(scores: np.ndarray, sign: int) -> float:
    return float(np.logaddexp(0, -sign * scores).mean())


def fit(good: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps=STEPS, rate=RATE, decay=DECAY):
    """(centre, spread, weights, offset) of the scorer with the least non-negative risk."""
    centre, spread = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    spread = np.where(spread > 1e-6, spread, np.inf)  # what never varies has no say
    g, u = (good - centre) / spread, (unlabelled - centre) / spread
    g, u = (np.concatenate([np.clip(x, -8, 8), np.ones((len(x), 1))], axis=1) for x in (g, u))
    weights = np.zeros(g.shape[1])
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        sg, su = g @ weights, u @ weights
        on_bad = u.T @ _slopes(su, -1) / len(u) - prior * (g.T @ _slopes(sg, -1)) / len(g)
        if _loss(su, -1) - prior * _loss(sg, -1) >= 0:
            slope = prior * (g.T @ _slopes(sg, 1)) / len(g) + on_bad
        else:
            slope = -on_bad
        slope[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return centre, spread, weights[:-1], float(weights[-1])


def held_out(id_column: str, fold: int = 0):
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % FOLDS == fold


def train(docs: DataFrame, labels: DataFrame, *, id_column="doc_id", text_column="text", label_column="quality", prior=None):
    """A column function: text column to score."""
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).filter(
        F.col("id").isNotNull() & ~held_out("id")
    )
    trusted = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
        .filter(F.col("id").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
    )
    known = rows.select("id").join(trusted.filter("low = high"), "id")
    shares = known.agg(F.count("*"), F.sum(F.when(F.col("low") == 1, 1).otherwise(0))).first()
    if prior is None:
        total, ones = shares[0] or 0, shares[1] or 0
        prior = (ones + 1) / (total + 2) if 0 < ones < total else DEFAULT_PRIOR
    by_hash = [F.xxhash64("id"), F.col("id")]
    good_ids = known.filter("low = 1").select("id").orderBy(*by_hash).limit(GOOD).withColumn("good", F.lit(True))
    other_ids = rows.select("id").orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(UNLABELLED).withColumn("good", F.lit(False))
    wanted = good_ids.unionByName(other_ids)

    @F.pandas_udf("binary")
    def row_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).tobytes())

    # at most GOOD + UNLABELLED ids on this side, whatever the tables' size
    seen = rows.join(F.broadcast(wanted), "id").select("good", row_of("text").alias("row")).collect()
    parts = [np.array([np.frombuffer(r.row, dtype=np.float32) for r in seen if r.good == good]) for good in (True, False)]
    del seen
    if not len(parts[0]) or not len(parts[1]):
        model = None
    else:
        model = fit(parts[0].astype(np.float64), parts[1].astype(np.float64), prior)
    del parts
    give_back()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(float(prior), index=texts.index, dtype="float64")
        centre, spread, weights, offset = model
        found = np.zeros(len(texts))
        for i, text in enumerate(texts):
            found[i] = np.clip((features(text) - centre) / spread, -8, 8) @ weights + offset
        return pd.Series(1 / (1 + np.exp(-np.clip(found, -60, 60))), index=texts.index)

    return lambda column: score(text_of(column))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold=THRESHOLD, text_column="text", **names) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; same columns."""
    score = train(docs, labels, text_column=text_column, **names)
    mark = free_name(docs, "quality_score")
    return docs.withColumn(mark, score(text_column)).filter(F.col(mark) >= threshold).drop(mark)


def op1_quality_classifier(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    score = train(docs, spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet"))
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )
