"""Registered queries: diagnosis and repair of mismatched orders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamwarden.contracts import orders_contract
from streamwarden.functions import json_values as J
from streamwarden.functions.backoff import Backoff
from streamwarden.operators import heal as H
from streamwarden.operators.guard import GuardSettings
from streamwarden.operators.mapping import apply_mapping, checked_rules
from streamwarden.plans import order_feed as O
from streamwarden.plans.routing import AS_OF, _JUDGED, _routed
from streamwarden.sources.tables import events

RULES = [
    ("missing=payment_method", [{"op": "set_default", "field": "payment_method", "value": "card"}], 0.9),
    ("types=order_total", [{"op": "cast_type", "field": "order_total", "target_type": "float"}], 0.8),
    (
        "values=payment_method",
        [{"op": "const_map", "field": "payment_method", "mapping": {"voucher": "gift_card"}, "fallback": None}],
        0.7,
    ),
    ("values=region", [{"op": "drop_field", "field": "region"}], 0.3),
    ("values=payment_method,region", [{"op": "run_code", "field": "region"}], 0.9),
    (
        "missing=payment_method|values=region",
        [
            {"op": "set_default", "field": "payment_method", "value": "cod"},
            {"op": "const_map", "field": "region", "mapping": {"ME": "EU"}},
        ],
        0.9,
    ),
]
GUARD = GuardSettings(3, Backoff(86400.0, 2.0, 5 * 86400.0, jitter=False))


def _rules(spark: SparkSession) -> DataFrame:
    rows = [("orders_v1", s, json.dumps(ops), "unknown", "", c, "given") for s, ops, c in RULES]
    return spark.createDataFrame(
        rows,
        "contract_name string, signature string, ops_json string, root_cause_category string, "
        "narrative string, confidence double, model_used string",
    )


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Quarantined orders, read back from their envelopes."""
    messages = _routed(spark, folder).where(F.size("violations") > 0)
    return H.mismatch_requests(messages.select("value", "source_offset"))


def unreadable_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every quarantined order: the ones repair can read, and why the others cannot be."""
    messages = _routed(spark, folder).where(F.size("violations") > 0).select("value", "source_offset")
    lost = H.unreadable_requests(messages).select("source_offset", "reason")
    read = H.mismatch_requests(messages).select("source_offset", F.lit("readable").alias("reason"))
    return lost.unionByName(read).select(F.col("source_offset").alias("o_orderkey"), "reason")


def _outcomes(spark, folder):
    at = F.lit(AS_OF).cast("timestamp")
    return H.heal(_requests(spark, folder), orders_contract(), _rules(spark), as_of=at)


def revalidate(spark: SparkSession, folder: str) -> DataFrame:
    d = H.diagnosed(_requests(spark, folder), orders_contract())
    return d.select(F.col("source_offset").alias("o_orderkey"), "diagnostic", "signature")


def alias_repair(spark: SparkSession, folder: str) -> DataFrame:
    d = H.diagnosed(_requests(spark, folder), orders_contract())
    shown = F.transform(
        "alias_ops", lambda o: F.concat_ws(":", o["op"], o["source"], o["target"], o["field"], o["target_type"])
    )
    return d.where("alias_ops is not null").select(
        F.col("source_offset").alias("o_orderkey"), F.array_join(shown, ",").alias("ops")
    )


def mismatch_signatures(spark: SparkSession, folder: str) -> DataFrame:
    d = H.diagnosed(_requests(spark, folder), orders_contract())
    return H.mismatch_signatures(d).select("contract_name", "signature", "records")


def heal_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, folder).select(
        F.col("source_offset").alias("o_orderkey"),
        "topic",
        "success",
        F.substring_index("reason", ":", 1).alias("reason"),
        "confidence",
        J.as_string(F.try_element_at("healed", F.lit("payment_method"))).alias("payment_method"),
        F.try_variant_get(F.try_element_at("healed", F.lit("order_total")), "$", "double").alias("order_total"),
        J.as_string(F.try_element_at("healed", F.lit("customer_id"))).alias("customer_id"),
    )


def heal_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """The same repairs behind the guard, as fifty contracts; one record an hour in order-key order."""
    out = _outcomes(spark, folder).withColumn("report_id", F.col("source_offset")).withColumn(
        "at", F.col("source_offset") * 3600.0
    ).withColumn("contract_name", (F.col("source_offset") % 50).cast("string"))
    return H.with_guard(out, "at", GUARD).select(
        F.col("source_offset").alias("o_orderkey"), "success", F.substring_index("reason", ":", 1).alias("reason")
    )


def apply_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Every operation of the vocabulary on every event's JSON."""
    text = F.to_json(
        F.struct(
            "event_type",
            F.col("value").cast("string").alias("value"),
            F.when(F.col("event_type") != "view", F.col("user_id")).alias("user"),
            F.lit("x").alias("noise"),
            (F.col("value") > 10).alias("big"),
            F.when(F.col("event_type") == "error", "abc").otherwise("12.9").alias("size"),
        )
    )
    ops = [
        {"op": "rename_field", "source": "value", "target": "amount"},
        {"op": "cast_type", "field": "amount", "target_type": "float"},
        {"op": "set_default", "field": "user", "value": -1},
        {"op": "drop_field", "field": "noise"},
        {"op": "const_map", "field": "event_type", "mapping": {"click": "C", "view": "V"}, "fallback": "other"},
        {"op": "cast_type", "field": "big", "target_type": "string"},
        {"op": "cast_type", "field": "size", "target_type": "integer"},
        {"op": "rename_field", "source": "nowhere", "target": "event_type"},
    ]
    rule = checked_rules(
        spark.createDataFrame(
            [(json.dumps(ops), "unknown", 1.0)], "ops_json string, root_cause_category string, confidence double"
        )
    )
    rows = events(spark, folder).select("event_id", J.members(J.parse_json(text)).alias("record"))
    done = rows.crossJoin(F.broadcast(rule.select("ops"))).select(
        "event_id", apply_mapping(F.col("record"), F.col("ops")).alias("h")
    )
    r = F.col("h.record")
    return done.select(
        "event_id",
        F.try_variant_get(F.try_element_at(r, F.lit("amount")), "$", "double").alias("amount"),
        F.try_variant_get(F.try_element_at(r, F.lit("user")), "$", "long").alias("user"),
        J.as_string(F.try_element_at(r, F.lit("event_type"))).alias("event_type"),
        J.as_string(F.try_element_at(r, F.lit("big"))).alias("big"),
        J.as_string(F.try_element_at(r, F.lit("size"))).alias("size"),
        F.col("h.failed").alias("failed"),
        F.size(F.map_keys(r)).alias("members"),
    )


def rule_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Repairs proposed by events, some of them unsound, judged one by one."""
    ev = events(spark, folder)
    proposal = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('[{"op":"drop_field","field":"u'), F.col("user_id"), F.lit('"}]')))
        .when(F.col("event_type") == "view", F.lit('[{"op":"cast_type","field":"a","target_type":"date"}]'))
        .when(F.col("event_type") == "error", F.lit('{"op":"drop_field"}'))
        .when(F.col("event_type") == "signup", F.lit('[{"op":"drop_field","field":"a"},{"op":"explode"}]'))
        .otherwise(F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('{"op":"drop_field","field":"a"}'), 26), ","), F.lit("]")))
    )
    rules = ev.select(
        "event_id",
        proposal.alias("ops_json"),
        F.when(F.col("value") > 30, "guess").otherwise("unknown").alias("root_cause_category"),
        (F.col("value") / 20).alias("confidence"),
    )
    return checked_rules(rules).select(
        "event_id", F.coalesce("rule_error", F.lit("sound")).alias("verdict"), F.coalesce(F.size("ops"), F.lit(-1)).alias("n_ops")
    )


_DIAG = _JUDGED.rstrip() + f""",
diag AS (SELECT o_orderkey, b, f_total AS total, f_price AS price, cust, count_null, payment_method, region,
  CASE WHEN b = {O.CUT_OFF} THEN 'missing=order_id,order_total,payment_method|unexpected=_raw'
  ELSE concat_ws('|',
    CASE WHEN b = {O.RENAMED} THEN 'missing=order_total' WHEN b IN ({O.NO_PAYMENT}, {O.NULLS}) THEN 'missing=payment_method' END,
    CASE WHEN b = {O.RENAMED} THEN 'unexpected=order_amt' WHEN b = {O.EXTRA} THEN 'unexpected=note' END,
    CASE WHEN b = {O.TEXT_TOTAL} THEN 'types=order_total' END,
    CASE WHEN voucher AND region = 'ME' THEN 'values=payment_method,region' WHEN voucher THEN 'values=payment_method'
         WHEN region = 'ME' THEN 'values=region' END) END AS signature,
  CASE WHEN b = {O.CUT_OFF} THEN 'missing required fields: [''order_id'', ''order_total'', ''payment_method'']; unexpected fields not in contract: [''_raw'']'
  ELSE coalesce(nullif(concat_ws('; ',
    CASE WHEN b = {O.RENAMED} THEN 'missing required fields: [''order_total'']'
         WHEN b IN ({O.NO_PAYMENT}, {O.NULLS}) THEN 'missing required fields: [''payment_method'']' END,
    CASE WHEN b = {O.RENAMED} THEN 'unexpected fields not in contract: [''order_amt'']'
         WHEN b = {O.EXTRA} THEN 'unexpected fields not in contract: [''note'']' END,
    CASE WHEN b = {O.TEXT_TOTAL} THEN 'type mismatches: [''order_total (expected float)'']' END,
    CASE WHEN voucher AND region = 'ME' THEN 'invalid enum values: ["payment_method=''voucher''", "region=''ME''"]'
         WHEN voucher THEN 'invalid enum values: ["payment_method=''voucher''"]'
         WHEN region = 'ME' THEN 'invalid enum values: ["region=''ME''"]' END), ''), 'valid') END AS diagnostic
  FROM (SELECT f.o_orderkey, f.bend AS b, f.order_total AS f_total, f.unit_price AS f_price, f.customer_id AS cust,
          f.item_count IS NULL AS count_null, f.payment_method, f.region,
          f.payment_method = 'voucher' AND f.bend NOT IN ({O.NO_PAYMENT}, {O.NULLS}) AS voucher
        FROM feed f JOIN judged j USING (o_orderkey) WHERE len(found) > 0 AND f.bend <> {O.ARRAY}))
"""
_HEAL = _DIAG.rstrip() + f""",
plan AS (SELECT *, signature = 'missing=order_total|unexpected=order_amt' AS al,
   CASE signature WHEN 'missing=payment_method' THEN 0.9 WHEN 'types=order_total' THEN 0.8
     WHEN 'values=payment_method' THEN 0.7 WHEN 'values=region' THEN 0.3 WHEN 'values=payment_method,region' THEN 0.9
     WHEN 'missing=payment_method|values=region' THEN 0.9 ELSE 0.0 END::DOUBLE AS conf,
   total > 100000 OR coalesce(price > 100000, false) OR b = {O.TRUE_COUNT} OR (b = {O.DECIMAL_COUNT} AND NOT count_null) AS still
  FROM diag),
outc AS (SELECT *, CASE WHEN signature = 'values=payment_method,region' THEN 'mapping_rejected'
   WHEN NOT al AND conf < 0.6 THEN 'low_confidence_or_no_ops'
   WHEN still THEN 'post_heal_revalidation_failed'
   WHEN al THEN 'healed_and_revalidated_with_deterministic_rename' ELSE 'healed_and_revalidated' END AS reason FROM plan)
"""

QUERIES = {
    "unreadable_requests": unreadable_requests,
    "revalidate": revalidate,
    "alias_repair": alias_repair,
    "mismatch_signatures": mismatch_signatures,
    "heal_outcomes": heal_outcomes,
    "heal_guarded": heal_guarded,
    "apply_ops": apply_ops,
    "rule_validity": rule_validity,
}

ORACLE = {
    "unreadable_requests": _JUDGED
    + f"""SELECT o_orderkey, CASE WHEN bend = {O.ARRAY} THEN 'record_not_object' ELSE 'readable' END AS reason
FROM judged WHERE len(found) > 0""",
    "revalidate": _DIAG + "SELECT o_orderkey, diagnostic, signature FROM diag",
    "alias_repair": _DIAG
    + """SELECT o_orderkey, 'rename_field:order_amt:order_total,cast_type:order_total:float' AS ops
FROM diag WHERE signature = 'missing=order_total|unexpected=order_amt'""",
    "mismatch_signatures": _DIAG
    + "SELECT 'orders_v1' AS contract_name, signature, count(*) AS records FROM diag GROUP BY signature",
    "heal_outcomes": _HEAL
    + """SELECT o_orderkey, CASE WHEN ok THEN 'validated-data' ELSE 'dead-letter-queue' END AS topic, ok AS success,
  reason, CASE WHEN al THEN 1.0::DOUBLE ELSE conf END AS confidence,
  CASE WHEN ok THEN CASE signature WHEN 'missing=payment_method' THEN 'card' WHEN 'values=payment_method' THEN 'gift_card'
     WHEN 'missing=payment_method|values=region' THEN 'cod' ELSE payment_method END END AS payment_method,
  CASE WHEN ok THEN total END AS order_total,
  CASE WHEN ok THEN substr(sha256(cust), 1, 16) END AS customer_id
FROM (SELECT *, reason LIKE 'healed%' AS ok FROM outc)""",
    "heal_guarded": _HEAL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, ev AS (SELECT o_orderkey AS k, o_orderkey * 3600.0::DOUBLE AS sec, reason, reason LIKE 'healed%' AS ok,
    o_orderkey % 50 AS g, row_number() OVER (PARTITION BY o_orderkey % 50 ORDER BY o_orderkey) AS rn FROM outc),
run AS (SELECT g, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS k, 0 AS n, 0 AS trips, CAST(NULL AS DOUBLE) AS til, false AS held, '' AS reason, false AS ok
  FROM (SELECT DISTINCT g FROM ev)
  UNION ALL
  SELECT g, rn, k, CASE WHEN held THEN n WHEN ok THEN 0 ELSE n + 1 END,
    CASE WHEN NOT held AND NOT ok AND n + 1 >= 3 THEN trips + 1 ELSE trips END,
    CASE WHEN held THEN til WHEN ok THEN NULL WHEN n + 1 >= 3 THEN sec + least(86400.0 * pow(2, trips), 432000.0) ELSE til END,
    held, reason, ok
  FROM (SELECT r.g, e.rn, e.k, r.n, r.trips, r.til, e.sec, e.reason, e.ok, coalesce(e.sec < r.til, false) AS held
        FROM run r JOIN ev e ON e.g = r.g AND e.rn = r.rn + 1))
SELECT k AS o_orderkey, ok AND NOT held AS success, CASE WHEN held THEN 'healer_paused' ELSE reason END AS reason
FROM run WHERE rn > 0""",
    "apply_ops": """
SELECT event_id, value AS amount, CASE WHEN event_type <> 'view' THEN user_id ELSE -1 END AS "user",
  CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE 'other' END AS event_type,
  CASE WHEN value > 10 THEN 'True' ELSE 'False' END AS big,
  CASE WHEN event_type = 'error' THEN 'abc' ELSE '12' END AS size, event_type = 'error' AS failed, 5 AS members
FROM events""",
    "rule_validity": """
SELECT event_id, v AS verdict, CASE WHEN v = 'sound' THEN 1 ELSE -1 END AS n_ops FROM (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'op[0] (cast_type) failed validation'
    WHEN 'error' THEN 'mapping payload is not a list' WHEN 'signup' THEN 'op[1] unknown op name: explode'
    WHEN 'purchase' THEN 'mapping has 26 ops, more than 25'
    ELSE CASE WHEN value > 30 THEN 'unknown root_cause_category' WHEN value / 20 > 1 THEN 'confidence outside [0, 1]'
         ELSE 'sound' END END AS v FROM events)""",
}
