"""Contracts, validation, masking, repair."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from streamwarden import contracts as C
from streamwarden.functions import json_values as J
from streamwarden.operators import heal as H
from streamwarden.operators.catalog import fingerprint_of
from streamwarden.operators.mapping import apply_mapping, checked_rules
from streamwarden.operators.mask import masked_json
from streamwarden.operators.validate import violations

CONTRACT = C.from_document(
    {
        "contract_name": "t_v1",
        "fields": [
            {"name": "id", "type": "string", "required": True},
            {"name": "total", "type": "float", "required": True},
            {"name": "count", "type": "int"},
            {"name": "ok", "type": "boolean"},
            {"name": "level", "type": "int", "allowed_values": [1, 2]},
            {"name": "who", "type": "string", "pii": True},
            {"name": "note", "type": "string", "pii": True, "masking_strategy": "redact"},
            {"name": "free", "type": "blob"},
        ],
        "quality_rules": [
            {"rule": "range_check", "field": "total", "min": 0, "max": 10},
            {"rule": "not_null", "fields": ["ref"]},
            {"rule": "freshness", "field": "seen", "max_delay_minutes": 15},
        ],
    }
)
AS_OF = "2024-05-01T12:00:00Z"
GOOD = {"id": "a", "total": 1, "ref": 0}


def found(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", violations(J.parse_json(F.col("t")), CONTRACT, F.lit(AS_OF).cast("timestamp")).alias("v"))
    return [r.v for r in out.orderBy("i").collect()]


def test_violations_of_odd_records(spark):
    cases = [
        (GOOD, []),
        ({**GOOD, "total": None}, ["missing_required_field:total"]),
        ({**GOOD, "total": "1"}, ["type_mismatch:total:expected_float"]),
        ({**GOOD, "total": True}, ["type_mismatch:total:expected_float"]),
        ({**GOOD, "total": 11}, ["range_check:total:above_max"]),
        ({**GOOD, "count": 3.0}, ["type_mismatch:count:expected_int"]),
        ({**GOOD, "count": 12345678901234567890}, []),
        ({**GOOD, "level": 1.0}, ["type_mismatch:level:expected_int"]),
        ({**GOOD, "level": True}, ["type_mismatch:level:expected_int"]),
        ({**GOOD, "level": "1"}, ["type_mismatch:level:expected_int", "invalid_value:level:1"]),
        ({**GOOD, "level": 7}, ["invalid_value:level:7"]),
        ({**GOOD, "ok": "true", "free": [1], "extra": 1}, ["type_mismatch:ok:expected_boolean"]),
        ({"id": "a", "total": 1}, ["not_null:ref"]),
        ({**GOOD, "seen": "2024-05-01T11:50:00"}, []),
        ({**GOOD, "seen": "2024-05-01T11:00:30Z"}, ["freshness:seen:delay_59m"]),
        ({**GOOD, "seen": "2024-05-01T13:00:00+02:00"}, ["freshness:seen:delay_60m"]),
        ({**GOOD, "seen": "soon"}, ["freshness:seen:unparseable_timestamp"]),
        ({**GOOD, "seen": ""}, []),
    ]
    assert found(spark, *[json.dumps(r) for r, _ in cases]) == [v for _, v in cases]
    assert found(spark, "{oops", "[1]", "3") == [["malformed_json"], ["not_an_object"], ["not_an_object"]]


def test_masking(spark):
    rows = [({"id": "a", "who": "Ann", "note": "x"},), ({"id": "b", "who": None},), ({"id": "c", "who": 7},)]
    df = spark.createDataFrame([(json.dumps(r[0]),) for r in rows], "t string")
    out = [json.loads(r[0]) for r in df.select(masked_json(J.parse_json(F.col("t")), CONTRACT)).collect()]
    short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    assert out == [{"id": "a", "who": short("Ann"), "note": "***"}, {"id": "b", "who": None}, {"id": "c", "who": short("7")}]


def test_layouts_and_topics():
    flat = C.from_document({"contract_name": "x", "fields": [{"name": "a"}]})
    assert (flat.source_topic, flat.violation_topic, flat.required_for_repair()) == ("raw-data", C.HEALER_TOPIC, ["a"])
    nested = C.from_document({"contract": {"name": "y", "kafka": {"source_topic": "s", "dlq_topic": "d"}}, "schema": {"fields": []}})
    assert (nested.source_topic, nested.violation_topic, nested.flat) == ("s", "d", False)
    assert not C.orders_contract().fields[3].required


def test_fingerprint_is_the_same_on_both_sides(spark):
    shape = {"b": "int", "a\"q": "string", "ü\n": "float", "😀": "x"}
    df = spark.createDataFrame([(shape,)], "m map<string,string>")
    assert df.select(fingerprint_of(F.col("m"))).first()[0] == C.fingerprint(shape)


def healed(spark, record, ops):
    rule = checked_rules(spark.createDataFrame([(json.dumps(ops), None, 1.0)], "ops_json string, root_cause_category string, confidence double"))
    row = rule.select(
        "rule_error", apply_mapping(J.members(J.parse_json(F.lit(json.dumps(record)))), F.col("ops")).alias("h")
    ).select("rule_error", F.to_json("h.record").alias("r"), "h.failed").first()
    return row.rule_error or json.loads(row.r), row.failed


@pytest.mark.parametrize(
    "record, ops, expected",
    [
        ({"a": 1}, [{"op": "rename_field", "source": "a", "target": "b"}], {"b": 1}),
        ({"a": 1, "b": 2}, [{"op": "rename_field", "source": "a", "target": "b"}], {"b": 1}),
        ({"a": 1}, [{"op": "rename_field", "source": "x", "target": "a"}], {"a": 1}),
        ({"a": "12.7"}, [{"op": "cast_type", "field": "a", "target_type": "integer"}], {"a": 12}),
        ({"a": True}, [{"op": "cast_type", "field": "a", "target_type": "string"}], {"a": "True"}),
        ({"a": " Yes "}, [{"op": "cast_type", "field": "a", "target_type": "boolean"}], {"a": True}),
        ({"a": None}, [{"op": "cast_type", "field": "a", "target_type": "float"}], {"a": None}),
        ({"a": None}, [{"op": "set_default", "field": "a", "value": [1]}, {"op": "set_default", "field": "b", "value": 2}], {"a": [1], "b": 2}),
        ({"a": 1, "b": 2}, [{"op": "drop_field", "field": "a"}, {"op": "drop_field", "field": "z"}], {"b": 2}),
        ({"a": 1}, [{"op": "const_map", "field": "a", "mapping": {"1": "one"}}], {"a": "one"}),
        ({"a": 5}, [{"op": "const_map", "field": "a", "mapping": {"1": "one"}}], {"a": None}),
        ({"a": 5}, [{"op": "eval"}], "op[0] unknown op name: eval"),
        ({"a": 5}, [{"op": "drop_field", "field": "a", "more": 1}], "op[0] (drop_field) failed validation"),
        ({"a": 5}, [{"field": "a"}], "op[0] missing 'op' discriminator"),
    ],
)
def test_vocabulary(spark, record, ops, expected):
    assert healed(spark, record, ops)[0] == expected


def test_uncastable_value_is_flagged(spark):
    assert healed(spark, {"a": "x"}, [{"op": "cast_type", "field": "a", "target_type": "float"}])[1]


def test_alias_repair_needs_a_unique_source(spark):
    orders = C.orders_contract()
    base = {"order_id": "o", "payment_method": "card"}
    cases = [
        ({**base, "order_amt": "5.5"}, 2),
        ({**base, "order_amt": 1, "Order-Amount": 2}, None),
        ({**base, "order_amt": None}, None),
        ({**base, "order_amt": 1, "currency": "XX"}, None),
        ({**base, "sum": 1}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(cases)], "i int, t string")
    d = H.diagnosed(df.select("i", J.members(J.parse_json(F.col("t"))).alias("record")), orders)
    got = [r.n for r in d.select("i", F.size("alias_ops").alias("n")).orderBy("i").collect()]
    assert [None if n in (-1, None) else n for n in got] == [n for _, n in cases]


def test_contract_listing(spark):
    orders = C.orders_contract()
    listed = C.contract_listing(spark, [CONTRACT, orders])
    assert listed.columns == ["name", "version", "source_topic", "sink_topic", "schema_fingerprint"]
    assert [tuple(r) for r in listed.orderBy("name").collect()] == sorted(
        (c.name, str(c.version), c.source_topic, c.sink_topic, c.fingerprint) for c in (CONTRACT, orders)
    )
    assert C.contract_listing(spark, []).count() == 0
