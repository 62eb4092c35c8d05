"""The keyed table: what a batch reads, and what stays after a batch that broke off anywhere."""

import pytest

from streamwarden.sources.keyed_table import KeyedTable, add_rows, replace_rows

SCHEMA = "k string, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(table, spark):
    return sorted((tuple(r) for r in table.read(spark).collect()), key=str)


def test_inserts_keep_first_arrivals_and_all_null_keys(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), SCHEMA, buckets=8, most_parts=2)
    expected = {}
    nulls = 0
    for batch in range(5):
        new = [(f"k{i % 13}" if i % 4 else None, batch * 100 + i) for i in range(20)]
        for k, v in new:
            nulls += k is None
            if k is not None:
                expected.setdefault(k, v)
        table.insert_if_absent(rows(spark, *new), "run", batch, ["v"])
        got = held(table, spark)
        assert {(k, v) for k, v in got if k} == set(expected.items())
        assert len(got) == len(expected) + nulls
    assert all(len(parts) <= 3 for parts in table.latest(spark).parts.values())


def test_batch_of_one_key_reads_one_bucket(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), SCHEMA, buckets=16)
    table.insert_if_absent(rows(spark, *[(f"k{i}", i) for i in range(400)]), "run", 0, ["v"])
    assert len(table.files(table.latest(spark))) == 16
    one = rows(spark, ("k7", 1), ("k7", 2))
    touched = table.touched(one)
    assert len(touched) == 1
    files = table.read(spark, touched).inputFiles()
    assert len(files) == 1 and f"_bucket={touched[0]}/" in files[0]
    assert [tuple(r) for r in table.lookup(one).collect()] == [("k7", 7)]
    made = table.upsert(rows(spark, ("k7", 70)), "run", 1, replace_rows("k"))
    assert [b for b, parts in made.parts.items() if made.version in parts] == touched
    assert ("k7", 70) in held(table, spark) and len(held(table, spark)) == 400


@pytest.mark.parametrize("step", ["data", "manifest"])
@pytest.mark.parametrize("kind", ["insert", "upsert"])
def test_broken_batch_is_made_anew(spark, tmp_path, monkeypatch, step, kind):
    table = KeyedTable(str(tmp_path / "t"), ("k",), SCHEMA, buckets=4, most_parts=1)

    def put(pairs, batch):
        if kind == "insert":
            return table.insert_if_absent(rows(spark, *pairs), "run", batch, ["v"])
        return table.upsert(rows(spark, *pairs), "run", batch, replace_rows("k"))

    put([("a", 1), ("b", 2)], 0)
    before = held(table, spark)
    if step == "manifest":  # data is written, the manifest is not

        def broken(*_):
            raise RuntimeError("killed")

        with monkeypatch.context() as patch:
            patch.setattr(KeyedTable, "_commit", broken)
            with pytest.raises(RuntimeError):
                put([("b", 5), ("c", 3)], 1)
        assert held(table, spark) == before  # a reader sees nothing of it
    else:  # everything is written, the stream's own commit is not
        put([("b", 5), ("c", 3)], 1)
    put([("b", 5), ("c", 3)], 1)
    wanted = [("a", 1), ("b", 2 if kind == "insert" else 5), ("c", 3)]
    assert held(table, spark) == wanted
    assert table.latest(spark).version == 2
    put([("c", 9)], 2)
    assert dict(held(table, spark))["c"] == (3 if kind == "insert" else 9)


def test_lost_checkpoint_adds_nothing_twice(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), SCHEMA, buckets=4)
    table.insert_if_absent(rows(spark, ("a", 1)), "first", 0, ["v"])
    table.insert_if_absent(rows(spark, ("b", 2)), "first", 1, ["v"])
    table.insert_if_absent(rows(spark, ("a", 1), ("b", 2), ("c", 3)), "second", 0, ["v"])
    assert held(table, spark) == [("a", 1), ("b", 2), ("c", 3)]


def test_sets_empty_batches_and_other_bucket_counts(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), SCHEMA, buckets=4)
    assert held(table, spark) == []
    table.upsert(rows(spark, ("a", 1), ("a", 1)), "run", 0, add_rows)
    table.upsert(rows(spark, ("a", 1), ("a", 2)), "run", 1, add_rows)
    table.upsert(spark.createDataFrame([], SCHEMA), "run", 2, add_rows)
    assert held(table, spark) == [("a", 1), ("a", 2)]
    with pytest.raises(ValueError):
        KeyedTable(table.path, ("k",), SCHEMA, buckets=5).read(spark)


def test_vacuum_keeps_what_the_newest_versions_hold(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), SCHEMA, buckets=4)
    assert table.vacuum(spark) == 0
    for batch in range(5):
        table.upsert(rows(spark, ("a", batch), (f"b{batch}", batch)), "run", batch, replace_rows("k"))
    before = held(table, spark)
    assert table.vacuum(spark, keep=2) > 0
    assert held(table, spark) == before and len(before) == 6
    table.upsert(rows(spark, ("a", 40)), "run", 4, replace_rows("k"))  # the last batch again, as after a failure
    assert dict(held(table, spark))["a"] == 40 and table.latest(spark).version == 5
    with pytest.raises(ValueError):
        table.vacuum(spark, keep=1)
