"""The stored index of answered prompts."""

import numpy as np
from pyspark.sql import functions as F

from streamwarden.operators import answers as A
from streamwarden.streaming.answering import AnswerCache, answer_stream, hit_counts

PROMPT = "id long, embedding array<double>, cheap string, strong string, timestamp timestamp"


def prompts(spark, vectors, start=0):
    rows = [(start + k, [float(x) for x in v], "unclear" if k % 3 == 0 else f"cheap {k}", f"strong {k}") for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, PROMPT.replace(", timestamp timestamp", ""))
    return df.withColumn("timestamp", F.timestamp_seconds("id"))


def vectors(seed, n, groups=12):
    """Groups of directions far apart, with members close to each other."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(groups, 8))
    return centres[rng.integers(0, groups, n)] * rng.uniform(0.5, 3, (n, 1)) + rng.normal(scale=0.02, size=(n, 8))


def test_second_run_is_all_hits_and_equals_the_full_comparison(spark, tmp_path):
    cache = AnswerCache(str(tmp_path / "cache"), block=16)
    first, second = prompts(spark, vectors(2, 120)), prompts(spark, vectors(3, 60), 1000)
    made = cache.answer(first.drop("timestamp"), "run", 0)
    assert made.where("cache_hit").isEmpty()
    again = cache.answer(first.drop("timestamp"), "run", 1).collect()
    assert all(r.cache_hit for r in again) and len(again) == 120
    mixed = second.unionByName(prompts(spark, np.eye(8)[:3], 2000))
    got = {(r.prompt_id, r.cache_id) for r in cache.nearest(mixed.select("id", "embedding")).collect()}
    full = A.nearest(mixed.select("id", "embedding"), cache.entries.read(spark).select("id", "embedding"))
    assert got == {(r.prompt_id, r.cache_id) for r in full.collect()} and len(got) == 60
    answers = {r.prompt_id: r for r in cache.answer(mixed.drop("timestamp"), "run", 2).collect()}
    assert {k for k, r in answers.items() if not r.cache_hit} == {2000, 2001, 2002}
    assert answers[2000].model_used == "strong" and answers[2001].model_used == "cheap"


def test_only_visited_cells_are_read(spark, tmp_path):
    cache = AnswerCache(str(tmp_path / "cache"))
    cache.answer(prompts(spark, vectors(2, 200)).drop("timestamp"), "run", 0)
    one = A.usable(prompts(spark, vectors(3, 1)).select("id", "embedding")).withColumn("dims", F.size("unit"))
    seen, cells, places = cache.visits(one, "run", 1)
    assert 1 <= len(places) < len(cells)
    files = cache.entries.read(spark, places).inputFiles()
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in files} == set(places)


def test_stream_runs_again_and_counts_hits(spark, tmp_path):
    cache, source, out = AnswerCache(str(tmp_path / "cache")), str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        prompts(spark, vectors(5, 40), part * 100).coalesce(1).write.mode("append").parquet(source)
        answer_stream(spark.readStream.schema(PROMPT).parquet(source), cache, out, str(tmp_path / "c")).awaitTermination(240)
    answers = spark.read.parquet(f"{out}/answers")
    assert answers.where("batch = 0 and cache_hit").isEmpty() and answers.where("batch > 0 and not cache_hit").isEmpty()
    assert cache.entries.read(spark).count() == 40
    counts = hit_counts(spark, out).collect()
    assert sum(r.hit_count for r in counts) == 80
    # the last batch once more, as after a failure: it sees the index it saw before
    before = cache.entries.latest(spark).version
    cache.answer(prompts(spark, vectors(5, 40), 200).drop("timestamp"), str(tmp_path / "c"), 2)
    assert cache.entries.latest(spark).version == before and cache.entries.read(spark).count() == 40


def test_odd_vectors_match_nothing_and_are_not_stored(spark, tmp_path):
    cache = AnswerCache(str(tmp_path / "cache"))
    rows = [(1, None, "a", "b"), (2, [0.0, 0.0], "a", "b"), (3, [1.0, 0.0], "a", "b"), (4, [1.0, 0.0], "c", "d"), (5, [1.0], "a", "b")]
    odd = spark.createDataFrame(rows, PROMPT.replace(", timestamp timestamp", ""))
    assert cache.answer(odd.limit(0), "run", 0).isEmpty()
    made = cache.answer(odd, "run", 1).collect()
    assert len(made) == 5 and not any(r.cache_hit for r in made)
    assert sorted(r.id for r in cache.entries.read(spark).collect()) == [3, 5]
    hits = {r.prompt_id: r.cache_id for r in cache.answer(odd, "run", 2).collect() if r.cache_hit}
    assert hits == {3: 3, 4: 3, 5: 5}
