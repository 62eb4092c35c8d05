"""The closed vocabulary of record repairs, applied as one fold over a record.

A record is a MAP<STRING, VARIANT>, a repair an ordered list of operations:
``rename_field``, ``cast_type``, ``set_default``, ``drop_field``, ``const_map``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from streamwarden.functions import json_values as J
from streamwarden.functions.binding import let

OPS_TYPE = (
    "array<struct<op string, source string, target string, field string, target_type string, "
    "value variant, mapping map<string,variant>, fallback variant>>"
)

# Fixed values of the vocabulary.
CAST_TARGETS = ("string", "integer", "float", "boolean")
TRUE_WORDS = ("true", "1", "yes", "y")
CATEGORIES = (
    "field_renamed",
    "new_optional_field",
    "new_required_field",
    "field_removed",
    "type_widened",
    "type_narrowed",
    "enum_value_added",
    "unknown",
)
MAX_OPS = 25
MEMBERS = {
    "rename_field": (("source", "target"), ()),
    "cast_type": (("field", "target_type"), ()),
    "set_default": (("field", "value"), ()),
    "drop_field": (("field",), ()),
    "const_map": (("field", "mapping"), ("fallback",)),
}


def _null_variant() -> Column:
    return F.parse_json(F.lit("null"))


def _put(record: Column, name: Column, value: Column) -> Column:
    kept = F.map_filter(record, lambda key, _: key != name)
    return F.map_concat(kept, F.map_from_arrays(F.array(name), F.array(F.coalesce(value, _null_variant()))))


def _has(record: Column, name: Column) -> Column:
    return F.map_contains_key(record, name)


def cast_value(value: Column, target: Column) -> Column:
    """The cast value; SQL NULL when it cannot be cast, variant null for null."""
    kind = J.json_type(value)
    text = J.as_string(value)
    as_double = F.when(kind == "STRING", F.trim(text).try_cast("double")).otherwise(J.as_number(value, kind))
    truth = (
        F.when(kind == "STRING", F.lower(F.trim(text)).isin(*TRUE_WORDS))
        .when(kind == "BOOLEAN", text == "true")
        .when(J.is_number(kind), as_double != 0)
        .otherwise(~F.to_json(value).isin("{}", "[]"))
    )
    whole = as_double.try_cast("bigint")
    return (
        F.when(F.is_variant_null(value), value)
        .when(target == "string", J.display_text(value, kind).cast("variant"))
        .when(target == "integer", whole.cast("variant"))
        .when(target == "float", as_double.cast("variant"))
        .when(target == "boolean", truth.cast("variant"))
    )


def _applied(record: Column, op: Column) -> Column:
    """struct(record, failed) after one operation; a missing source field is not an error."""
    name = op["field"]
    held = F.try_element_at(record, name)
    source = F.try_element_at(record, op["source"])
    renamed = F.map_filter(record, lambda key, _: (key != op["source"]) & (key != op["target"]))
    moved = F.map_concat(renamed, F.map_from_arrays(F.array(op["target"]), F.array(source)))
    word = J.display_text(held, J.json_type(held))
    mapped = F.when(F.map_contains_key(op["mapping"], word), F.try_element_at(op["mapping"], word)).otherwise(
        op["fallback"]
    )
    done = (
        F.when((op["op"] == "rename_field") & _has(record, op["source"]), moved)
        .when((op["op"] == "set_default") & J.is_nothing(held), _put(record, name, op["value"]))
        .when(op["op"] == "drop_field", F.map_filter(record, lambda key, _: key != name))
        .when((op["op"] == "const_map") & _has(record, name), _put(record, name, mapped))
        .otherwise(record)
    )
    is_cast = (op["op"] == "cast_type") & _has(record, name)

    def with_cast(value: Column) -> Column:
        return F.struct(
            F.when(is_cast & value.isNotNull(), _put(record, name, value)).otherwise(done).alias("record"),
            (is_cast & value.isNull()).alias("failed"),
        )

    return let(F.when(is_cast, cast_value(held, op["target_type"])), with_cast)


def apply_mapping(record: Column, ops: Column) -> Column:
    """struct(record, failed): the record after all operations, in order.

    ``failed`` tells that some value could not be cast; such a record is
    rejected by its caller instead of stopping the job.
    """
    start = F.struct(record.alias("record"), F.lit(False).alias("failed"))

    def fold(acc: Column, op: Column) -> Column:
        def joined(step: Column) -> Column:
            return F.struct(
                step["record"].alias("record"), (acc["failed"] | step["failed"]).alias("failed")
            )

        return let(_applied(acc["record"], op), joined)

    return F.aggregate(ops, start, fold)


def _op_error(item: Column, index: Column) -> Column:
    members = J.members(item)
    name = J.as_string(J.member(item, "op"))
    at = F.concat(F.lit("op["), index.cast("string"), F.lit("]"))

    def text(field: str) -> Column:
        return F.coalesce(J.json_type(J.member(item, field)) == "STRING", F.lit(False))

    bad = F.lit(True)
    for op, (required, optional) in MEMBERS.items():
        keys = F.map_keys(members)
        sound = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ("op", *required, *optional)]))) == 0
        for field in required:
            if field == "value":
                sound = sound & F.array_contains(keys, F.lit("value"))
            elif field == "mapping":
                sound = sound & F.coalesce(J.is_object(J.json_type(J.member(item, field))), F.lit(False))
            else:
                sound = sound & text(field)
        if op == "cast_type":
            sound = sound & F.coalesce(J.as_string(J.member(item, "target_type")).isin(*CAST_TARGETS), F.lit(False))
        bad = F.when(name == op, ~sound).otherwise(bad)
    return (
        F.when(members.isNull() | ~F.map_contains_key(members, F.lit("op")), F.concat(at, F.lit(" missing 'op' discriminator")))
        .when(~F.coalesce(name.isin(*MEMBERS), F.lit(False)), F.concat(at, F.lit(" unknown op name: "), F.coalesce(name, F.lit("?"))))
        .when(bad, F.concat(at, F.lit(" ("), name, F.lit(") failed validation")))
    )


def _parsed_op(item: Column) -> Column:
    names = ("op", "source", "target", "field", "target_type")
    return F.struct(
        *[J.as_string(J.member(item, n)).alias(n) for n in names],
        J.member(item, "value").alias("value"),
        J.members(J.member(item, "mapping")).alias("mapping"),
        J.member(item, "fallback").alias("fallback"),
    )


def checked_rules(rules: DataFrame) -> DataFrame:
    """Proposed repairs with ``rule_error`` (NULL when sound) and parsed ``ops``.

    ``ops_json`` is judged as a whole: one bad operation rejects the list.
    """
    listed = J.parse_json(F.col("ops_json"))
    items = listed.try_cast("array<variant>")
    errors = F.array_compact(F.transform(items, _op_error))
    size = F.size(items)
    error = (
        F.when(items.isNull(), F.lit("mapping payload is not a list"))
        .when(size > MAX_OPS, F.concat(F.lit("mapping has "), size.cast("string"), F.lit(f" ops, more than {MAX_OPS}")))
        .when(F.size(errors) > 0, errors[0])
        .when(~F.coalesce("root_cause_category", F.lit("unknown")).isin(*CATEGORIES), F.lit("unknown root_cause_category"))
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), F.lit("confidence outside [0, 1]"))
    )
    return rules.withColumn("rule_error", error).withColumn(
        "ops", F.when(error.isNull(), F.transform(items, _parsed_op))
    )


def normalized_tokens(name: Column) -> Column:
    """Name tokens in which amt and amount read as total."""
    tokens = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.when(t.isin("amt", "amount"), F.lit("total")).otherwise(t))


def op_literal(op: str, **members: Column) -> Column:
    """One operation with the full set of members."""
    text = {n: members.get(n, F.lit(None).cast("string")) for n in ("source", "target", "field", "target_type")}
    nothing = F.lit(None).cast("variant")
    return F.struct(
        F.lit(op).alias("op"),
        *[v.alias(n) for n, v in text.items()],
        nothing.alias("value"),
        F.lit(None).cast("map<string,variant>").alias("mapping"),
        nothing.alias("fallback"),
    )

