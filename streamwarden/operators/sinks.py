"""Sink-side rules that do not depend on where rows are written."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

# The columns the validated-orders table keeps.
VALIDATED_ORDER_COLUMNS = {
    "order_id": "string",
    "order_total": "double",
    "item_count": "int",
    "shipping_cost": "double",
    "discount_pct": "double",
    "payment_method": "string",
    "shipping_country": "string",
    "product_category": "string",
    "unit_price": "double",
    "currency": "string",
    "customer_segment": "string",
    "region": "string",
    "shipping_method": "string",
    "device_type": "string",
    "order_channel": "string",
    "is_first_purchase": "boolean",
    "loyalty_tier": "string",
    "warehouse_id": "string",
}


def validated_orders(records: DataFrame, value: str = "value") -> DataFrame:
    """Valid JSON records as rows of the validated-orders table."""
    document = F.try_parse_json(F.col(value))
    columns = [
        F.try_variant_get(document, f"$.{name}", kind).alias(name)
        for name, kind in VALIDATED_ORDER_COLUMNS.items()
    ]
    return records.where(document.isNotNull()).select(*columns, F.col("seen_at").alias("ingested_at"))


def insert_if_absent(new: DataFrame, held: DataFrame, key: str, arrival: Sequence[str]) -> DataFrame:
    """Rows of ``new`` to append: the first arrival per key that ``held`` lacks.

    NULL keys never conflict, so all of them are kept. The first arrival is
    picked by an aggregate, which combines before the shuffle; a key that
    repeats very often therefore costs one row per partition.
    """
    row = F.struct(*[F.col(c) for c in new.columns])
    order = F.struct(*[F.col(c) for c in arrival])
    keyed = new.where(F.col(key).isNotNull())
    first = keyed.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
    fresh = first.join(held.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return fresh.select(*new.columns).unionByName(new.where(F.col(key).isNull()))
