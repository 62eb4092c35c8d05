"""An order stream derived from the order, customer and line-item tables.

Some records are bent by their key, so that every kind of violation occurs.
``FEED_SQL`` states the same records as typed columns for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamwarden.contracts import RAW_TOPIC
from streamwarden.sources.tables import lineitem, orders, table

# How table values read as order attributes.
PAYMENT = {
    "1-URGENT": "card",
    "2-HIGH": "paypal",
    "3-MEDIUM": "cod",
    "4-NOT SPECIFIED": "gift_card",
    "5-LOW": "voucher",
}
SEGMENT = {
    "AUTOMOBILE": "vip",
    "BUILDING": "returning",
    "FURNITURE": "new",
    "HOUSEHOLD": "returning",
    "MACHINERY": "new",
}
CURRENCY = {"AFRICA": "GBP", "AMERICA": "USD", "ASIA": "INR", "EUROPE": "EUR"}
MARKET = {"AFRICA": "LATAM", "AMERICA": "NA", "ASIA": "APAC", "EUROPE": "EU", "MIDDLE EAST": "ME"}

RENAMED, NO_PAYMENT, TEXT_TOTAL, EXTRA, CUT_OFF, ARRAY, NULLS, TRUE_COUNT, DECIMAL_COUNT = range(9)
BENT_MODULUS = 20


def _lookup(mapping: dict[str, str], key):
    out = F.lit(None).cast("string")
    for source, target in mapping.items():
        out = F.when(key == source, F.lit(target)).otherwise(out)
    return out


def per_order(spark: SparkSession, folder: str) -> DataFrame:
    return (
        lineitem(spark, folder)
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            F.max("l_extendedprice").alias("unit_price"),
            F.max("l_discount").alias("discount_pct"),
            F.max("l_quantity").alias("shipping_cost"),
        )
    )


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Typed order attributes, one row per order."""
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    buyers = table(spark, folder, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = (
        orders(spark, folder)
        .join(per_order(spark, folder), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
    )
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    return joined.select(
        "o_orderkey",
        "o_orderdate",
        F.concat(F.lit("O-"), F.col("o_orderkey")).alias("order_id"),
        (F.col("o_totalprice") / 4).alias("order_total"),
        _lookup(PAYMENT, F.col("o_orderpriority")).alias("payment_method"),
        _lookup(CURRENCY, F.col("r_name")).alias("currency"),
        F.col("c_name").alias("customer_id"),
        _lookup(SEGMENT, F.col("c_mktsegment")).alias("customer_segment"),
        _lookup(MARKET, F.col("r_name")).alias("region"),
        "item_count",
        "unit_price",
        "discount_pct",
        "shipping_cost",
        (F.col("o_orderstatus") == "F").alias("is_first_purchase"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), hour, F.lit(":30:00")).alias(
            "order_timestamp"
        ),
    )


ATTRIBUTES = (
    "order_id order_total payment_method currency customer_id customer_segment region item_count "
    "unit_price discount_pct shipping_cost is_first_purchase order_timestamp"
).split()


def order_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The stream: topic, partition, offset, timestamp, value."""
    rows = order_rows(spark, folder)
    bend = F.col("o_orderkey") % BENT_MODULUS
    nothing = F.parse_json(F.lit("null"))
    total, count, paid = F.col("order_total"), F.col("item_count"), F.col("payment_method")
    shaped = {name: F.col(name) for name in ATTRIBUTES}
    shaped["order_total"] = F.when(bend == TEXT_TOTAL, total.cast("string").cast("variant")).when(
        bend != RENAMED, total.cast("variant")
    )
    shaped["payment_method"] = F.when(bend == NULLS, nothing).when(bend != NO_PAYMENT, paid.cast("variant"))
    shaped["item_count"] = F.when(bend == TRUE_COUNT, F.lit(True).cast("variant")).otherwise(count.cast("variant"))
    extras = [
        F.when(bend == RENAMED, total.cast("string")).alias("order_amt"),
        F.when(bend == EXTRA, F.lit("call first")).alias("note"),
    ]
    text = F.to_json(F.struct(*[c.alias(n) for n, c in shaped.items()], *extras))
    bent = (
        F.when(bend == CUT_OFF, F.expr("substring(text, 1, length(text) - 5)"))
        .when(bend == ARRAY, F.concat(F.lit("["), F.col("text"), F.lit("]")))
        .when(bend == DECIMAL_COUNT, F.regexp_replace("text", r'"item_count":(\d+)', '"item_count":$1.0'))
        .otherwise(F.col("text"))
    )
    # rows of a topic come in its partitions; here the join's few bytes would come in one task,
    # and everything that is done with a record afterwards with them
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, "o_orderkey")
    return rows.withColumn("text", text).select(
        F.lit(RAW_TOPIC).alias("topic"),
        (F.col("o_orderkey") % 6).cast("int").alias("partition"),
        F.col("o_orderkey").alias("offset"),
        F.col("o_orderdate").alias("timestamp"),
        bent.alias("value"),
    )


def _case(mapping: dict[str, str], column: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {arms} END"


FEED_SQL = f"""
feed AS (
  SELECT o_orderkey, o_orderdate, o_orderkey % {BENT_MODULUS} AS bend,
         'O-' || o_orderkey AS order_id, o_totalprice / 4 AS order_total,
         {_case(PAYMENT, 'o_orderpriority')} AS payment_method,
         {_case(CURRENCY, 'r_name')} AS currency, c_name AS customer_id,
         {_case(SEGMENT, 'c_mktsegment')} AS customer_segment,
         {_case(MARKET, 'r_name')} AS region,
         item_count, unit_price, discount_pct, shipping_cost,
         o_orderstatus = 'F' AS is_first_purchase, o_orderkey % 24 AS written_hour
  FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS item_count, max(l_extendedprice) AS unit_price,
                    max(l_discount) AS discount_pct, max(l_quantity) AS shipping_cost
             FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  LEFT JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey) ON o_custkey = c_custkey
)"""
