"""Typed access to JSON values held as VARIANT.

A value's JSON type is always tested before the value is extracted, because
extraction casts: the string "1" would come out as the number 1.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BIG_INTEGER = r"^DECIMAL\((19|[23][0-9]),0\)$"


def parse_json(text: Column) -> Column:
    return F.try_parse_json(text)


def member(document: Column, name: str) -> Column:
    """The member as VARIANT; NULL when the key is absent, variant null when it is null."""
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.variant_get(document, f"$['{quoted}']", "variant")


def some_members(document: Column, names: list[str]) -> Column:
    """The named members of an object as one struct of VARIANTs, taken out in one pass; a ``member``
    for each of them searches the object anew. Names must differ in more than their case."""
    listed = ", ".join(f"`{n.replace('`', '``')}`: variant" for n in names)
    return F.try_variant_get(document, "$", f"struct<{listed}>")


def members(document: Column) -> Column:
    """An object as MAP<STRING, VARIANT>; NULL for anything that is not an object."""
    return document.try_cast("map<string,variant>")


def json_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_nothing(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def is_void(kind: Column) -> Column:
    """``is_nothing`` of a value whose type is known."""
    return kind.isNull() | (kind == "VOID")


def is_object(kind: Column) -> Column:
    return kind.startswith("OBJECT")


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def is_integer(kind: Column) -> Column:
    return (kind == "BIGINT") | kind.rlike(BIG_INTEGER)


TYPE_TESTS = {
    "string": lambda kind: kind == "STRING",
    "float": is_number,
    "int": is_integer,
    "integer": is_integer,
    "boolean": lambda kind: kind == "BOOLEAN",
    "timestamp": lambda kind: kind == "STRING",
}


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_number(value: Column, kind: Column) -> Column:
    """Numbers and booleans (1/0) as DOUBLE, everything else NULL."""
    truth = F.try_variant_get(value, "$", "boolean")
    return F.when(kind == "BOOLEAN", F.when(truth, 1.0).otherwise(0.0)).when(
        is_number(kind), F.try_variant_get(value, "$", "double")
    )


def display_text(value: Column, kind: Column) -> Column:
    """The value the way a log line shows it: True, 3, 3.0, None, plain strings."""
    return (
        F.when(value.isNull() | F.is_variant_null(value), "None")
        .when(kind == "STRING", as_string(value))
        .when(kind == "BOOLEAN", F.initcap(as_string(value)))
        .when(is_integer(kind), as_string(value))
        .when(is_number(kind), F.try_variant_get(value, "$", "double").cast("string"))
        .otherwise(F.to_json(value))
    )


def is_one_of(value: Column, kind: Column, allowed: tuple) -> Column:
    """Membership where 1, 1.0 and true are the same value, and "1" is not."""
    texts = [a for a in allowed if isinstance(a, str)]
    numbers = [float(a) for a in allowed if isinstance(a, (bool, int, float))]
    found = F.lit(False)
    if texts:
        found = found | ((kind == "STRING") & as_string(value).isin(*texts))
    if numbers:
        found = found | F.coalesce(as_number(value, kind).isin(*numbers), F.lit(False))
    return found
