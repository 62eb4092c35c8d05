"""Members of a document are taken out in one pass, with the same judgement (F1 to F9, F11, F12, F14)."""

from pyspark.sql import functions as F

from streamwarden import contracts as C
from streamwarden.functions import json_values as J
from streamwarden.operators.validate import violations, with_violations

AS_OF = "2024-01-01T00:00:00Z"


def _contract(*names):
    fields = [{"name": n, "type": "string", "required": True, "allowed_values": ["x"]} for n in names]
    return C.from_document({"contract_name": "c", "fields": fields})


def _parsed(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return docs.select("i", J.parse_json(F.col("text")).alias("d"), F.lit(AS_OF).cast("timestamp").alias("at"))


def _found(df):
    return [r.violations for r in df.orderBy("i").collect()]


def test_one_pass_over_a_document(spark):
    contract = _contract("a", "b.c", "d`e")
    parsed = _parsed(
        spark,
        '{"a":"x","b.c":"x","d`e":"x"}',
        '{"a":null,"b.c":1,"d`e":{"a":"x"},"more":["x"]}',
        "[]",
        "{",
        "null",
    )
    judged = with_violations(parsed, contract, "d", "at")
    found = _found(judged)
    assert found == _found(parsed.select("i", violations(F.col("d"), contract, F.col("at")).alias("violations")))
    assert found[0] == [] and found[2:] == [["not_an_object"], ["malformed_json"], ["not_an_object"]]
    assert found[1][0] == "missing_required_field:a" and found[1][-1] == "invalid_value:d`e:{\"a\":\"x\"}"
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(d#") == 1


def test_names_that_differ_in_case(spark):
    parsed = _parsed(spark, '{"a":"x","A":"x"}', '{"a":"x"}', '{"A":"x"}')
    found = _found(with_violations(parsed, _contract("a", "A"), "d", "at"))
    assert found == [[], ["missing_required_field:A"], ["missing_required_field:a"]]
