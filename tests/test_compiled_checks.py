"""Conditions are compiled: none stands inside a generator or in the argument of a lambda function."""

import re
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from streamwarden.contracts import orders_contract
from streamwarden.operators import heal as H
from streamwarden.operators import drift as D
from streamwarden.operators.ordered import cells
from streamwarden.operators.validate import with_violations
from streamwarden.streaming.drift_summaries import ROWS, Summaries

DOCS = ['{"order_id": "O-1", "order_total": "5"}', "[1]", "{", "null", '{"order_id": null, "payment_method": "x"}']


def operators(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if re.match(rf"[\s:+-]*(\*\(\d+\) )?{name} ", line)]


def test_checks_are_not_walked_through_for_every_row(spark):
    docs = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "id long, value string").withColumn("doc", F.try_parse_json("value"))
    judged = with_violations(docs.withColumn("at", F.current_timestamp()), orders_contract(), "doc", "at")
    requests = docs.select("id", F.col("doc").try_cast("map<string,variant>").alias("record")).where("record is not null")
    found = H.diagnosed(requests, orders_contract())
    for df in (judged.where(F.size("violations") > 0), found):
        assert operators(df, "Generate") and all("CASE" not in line for line in operators(df, "Generate"))
        assert all("filter(array(" not in line for line in operators(df, "Project"))
    got = {r.id: r.violations for r in judged.collect()}
    assert got[1] == got[3] == ["not_an_object"] and got[2] == ["malformed_json"]
    assert "type_mismatch:order_total:expected_float" in got[0] and "missing_required_field:order_id" in got[4]


def test_cells_are_unpivoted_without_a_walk_through_a_list(spark):
    """The counts of the cells, and that no list's places are taken out by a lambda function."""
    start, nan = datetime(2024, 1, 1), float("nan")
    kinds = [(1.0, "a"), (None, None), (nan, "b"), (0.0, "a"), (-0.0, ""), (1.0, "1.0")]
    rows = [(start + timedelta(hours=7 * i) if i % 9 else None, *kinds[i % 6], None if i % 4 else i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, x double, name string, value int")
    stored = Summaries("unused", D.DriftSettings("m", "at", ("x", "value"), ("name", "value")), 86400)
    counts = stored.counts_of(df)
    fields = cells(df, ["x", "value"], lambda name, value: {"high": value > 1, "of": F.lit(name)}, ["at"])
    for made in (counts, fields, cells(df, ["x", "value"], lambda name, value: {})):
        assert "lambdafunction" not in made._jdf.queryExecution().executedPlan().toString()
    wanted: Counter = Counter()
    for at, x, name, value in rows:
        if at is None:
            continue
        day = (at - datetime(1970, 1, 1)).days
        wanted[day, ROWS, None, None] += 1
        wanted.update((day, c, float(v) + 0.0, None) for c, v in (("x", x), ("value", value)) if v is not None and v == v)
        wanted.update((day, c, None, str(v)) for c, v in (("name", name), ("value", value)) if v is not None)
    got = [tuple(r) for r in counts.collect()]
    assert counts.columns == ["period", "column", "value", "category", "n"] and len(got) == len(wanted)
    assert {r[:4]: r[4] for r in got} == dict(wanted)
    held = [(at, c, float(v), v > 1, c) for at, x, _, value in rows for c, v in (("x", x), ("value", value)) if v is not None and v == v]
    assert Counter(tuple(r) for r in fields.collect()) == Counter(held)
