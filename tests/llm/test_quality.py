import random
import zlib

import numpy as np

from streamwarden.llm import quality
from tests.llm.fixtures import SCHEMA, odd_documents, odd_frame, prose


def corpus():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = " | ".join(prose(rng, 60).split()) if bad else prose(rng, 80) + "."
        rows.append((i, text, None))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy_and_folds(spark):
    rows, labels = corpus()
    docs, known = odd_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    score = quality.train(docs, known)
    got = docs.select("doc_id", quality.held_out("doc_id").alias("out"), score("text").alias("score")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    right = [(r.score >= quality.THRESHOLD) == (r.doc_id % 6 != 0) for r in got if r.out]
    assert sum(right) >= 0.97 * len(right)


def test_risk_ignores_the_bad_labels(spark):
    """Only the prior depends on label 0; with a given prior, bad rows are never read."""
    rows, labels = corpus()
    docs = odd_frame(spark, rows)
    good_only = spark.createDataFrame([x for x in labels if x[1]], "doc_id long, quality int")
    score = quality.train(docs, good_only, prior=5 / 6)
    got = docs.select("doc_id", score("text").alias("score")).collect()
    right = [(r.score >= quality.THRESHOLD) == (r.doc_id % 6 != 0) for r in got]
    assert sum(right) >= 0.97 * len(right)


def test_negative_part_is_not_chased():
    rng = np.random.default_rng(1)
    good = rng.normal(1, 1, (200, 3))
    unlabelled = np.concatenate([rng.normal(1, 1, (150, 3)), rng.normal(-3, 1, (50, 3))])
    centre, spread, weights, offset = quality.fit(good, unlabelled, 0.75)
    scores = np.clip((unlabelled - centre) / spread, -8, 8) @ weights + offset
    assert (scores[:150] > 0).mean() > 0.95 and (scores[150:] < 0).mean() > 0.95


def test_odd_rows_and_no_labels(spark):
    frame = odd_frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    score = quality.train(frame, none)
    assert {r.s for r in frame.select(score("text").alias("s")).collect()} == {quality.DEFAULT_PRIOR}
    some = spark.createDataFrame([(1, 1), (4, 1), (6, 0), (7, 1), (7, 0), (None, 1), (999, 1), (8, None), (10, 1)], "doc_id long, quality int")
    kept = quality.keep_good(frame, some, threshold=0.0)
    assert kept.columns == frame.columns and kept.count() == len(odd_documents())
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.keep_good(empty, some).count() == 0
