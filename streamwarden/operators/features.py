"""Numeric features of an order for anomaly scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from streamwarden.functions import json_values as J
from streamwarden.functions.binding import computed_once, let
from streamwarden.functions.times import hour_as_written

# Feature order and the fields the hour is taken from.
FEATURE_NAMES = ("order_total", "hour_of_day", "item_count", "unit_price", "discount_pct", "shipping_cost")
TIME_FIELDS = ("created_at", "order_timestamp", "ingested_at")


def _number(document: Column, name: str) -> Column:
    """A JSON number, boolean or numeric string as DOUBLE."""
    def read(value: Column) -> Column:
        kind = J.json_type(value)
        return F.when(kind == "STRING", F.trim(J.as_string(value)).try_cast("double")).otherwise(J.as_number(value, kind))

    return let(J.member(document, name), read)


def _finite(number: Column) -> Column:
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(usable, number).otherwise(0.0)


def feature_vector(document: Column) -> Column:
    """ARRAY<DOUBLE> in ``FEATURE_NAMES`` order; NULL when the order has no usable total."""
    stamps = [F.nullif(J.as_string(J.member(document, n)), F.lit("")) for n in TIME_FIELDS]
    hour = F.coalesce(hour_as_written(F.coalesce(*stamps)).cast("double"), F.lit(0.0))
    others = [let(_number(document, n), _finite) for n in FEATURE_NAMES[2:]]
    return let(
        _number(document, "order_total"), lambda total: F.when(total.isNotNull(), F.array(total, hour, *others))
    )


def with_features(df: DataFrame, document: str = "document") -> DataFrame:
    return computed_once(df, feature_vector(F.col(document)).alias("features")).where("features is not null")


def training_window(rows: DataFrame, created: str, tie: str, size: int = 2000) -> DataFrame:
    """The newest feature rows of the right width; Spark keeps only ``size`` rows per task for this."""
    usable = rows.where(F.size("features") == len(FEATURE_NAMES))
    return usable.orderBy(F.desc(created), F.desc(tie)).limit(size)
