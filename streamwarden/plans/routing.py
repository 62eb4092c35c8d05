"""Registered queries: validation, masking, routing, idempotent sink, schema identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamwarden import contracts as C
from streamwarden.functions import json_values as J
from streamwarden.operators import route as R
from streamwarden.operators.sinks import insert_if_absent
from streamwarden.operators.validate import violations
from streamwarden.plans import order_feed as O
from streamwarden.sources.tables import events, table

AS_OF = "2001-08-02T00:00:00Z"


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    at = F.lit(AS_OF).cast("timestamp")
    return R.route(O.order_feed(spark, folder), C.orders_contract(), as_of=at)


def violation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.violation_counts(_routed(spark, folder))


def contract_route(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).select(
        F.col("source_offset").alias("o_orderkey"), "topic", F.array_join("violations", "|").alias("violations")
    )


def quarantine_envelope(spark: SparkSession, folder: str) -> DataFrame:
    doc = J.parse_json(F.col("value"))
    return _routed(spark, folder).where(F.size("violations") > 0).select(
        F.col("source_offset").alias("o_orderkey"),
        J.as_string(J.member(doc, "event_type")).alias("event_type"),
        J.as_string(J.member(doc, "contract_name")).alias("contract_name"),
        F.length(J.as_string(J.member(doc, "report_id"))).alias("report_id_chars"),
        J.as_string(J.member(J.member(doc, "record"), "order_id")).alias("record_order_id"),
        F.length(J.as_string(J.member(J.member(doc, "record"), "_raw"))).cast("long").alias("raw_chars"),
    )


def pii_mask(spark: SparkSession, folder: str) -> DataFrame:
    doc = J.parse_json(F.col("value"))
    return _routed(spark, folder).where(F.size("violations") == 0).select(
        J.as_string(J.member(doc, "order_id")).alias("order_id"),
        J.as_string(J.member(doc, "customer_id")).alias("customer_id"),
        F.try_variant_get(doc, "$.order_total", "double").alias("order_total"),
    )


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    log = R.audit(_routed(spark, folder), C.orders_contract())
    payload = J.parse_json(F.col("payload"))
    return log.groupBy(
        "event_type",
        "source_topic",
        F.coalesce(J.as_string(J.member(payload, "routed_via")), F.lit("-")).alias("routed_via"),
    ).agg(F.count(F.lit(1)).alias("entries"))


EVENT_CONTRACT = C.from_document(
    {
        "contract": {"name": "events_v1", "version": 1, "kafka": {"source_topic": "events"}},
        "schema": {
            "fields": [
                {"name": "event_type", "type": "string", "required": True},
                {"name": "k", "type": "int", "required": True, "allowed_values": list(range(0, 90))},
                {"name": "value", "type": "float"},
            ]
        },
        "quality_rules": [
            {"rule": "not_null", "fields": ["ref", "k"]},
            {"rule": "range_check", "field": "value", "min": 5, "max": 40},
            {"rule": "freshness", "field": "seen", "max_delay_minutes": 30000},
        ],
    }
)
EVENTS_AS_OF = "2024-01-31 00:00:00"


def _event_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a JSON ``text`` that holds their props and other columns."""
    ev = events(spark, folder)
    seen = F.when(F.col("event_type") == "view", F.lit("soon")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    )
    rest = F.to_json(
        F.struct(
            "event_type",
            "value",
            F.when(F.col("event_type") != "click", F.col("user_id")).alias("ref"),
            seen.alias("seen"),
        )
    )
    text = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(", "), F.expr("substring(rest, 2)"))
    return ev.withColumn("rest", rest).select("event_id", "ts", text.alias("text"))


def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that the order contract does not use, on the JSON held in events.props."""
    docs = _event_documents(spark, folder).select("event_id", J.parse_json(F.col("text")).alias("document"))
    found = violations(F.col("document"), EVENT_CONTRACT, F.lit(EVENTS_AS_OF).cast("timestamp"))
    return docs.select("event_id", F.array_join(found, "|").alias("violations"))


def sink_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the event table arriving twice, sunk by user and kind: the first one stays."""
    ev = events(spark, folder)
    key = F.when(F.col("event_type") != "signup", F.concat_ws("/", "user_id", "event_type"))
    arriving = ev.select(key.alias("order_id"), "event_id", "ts")
    held = table(spark, folder, "customer").select(
        F.concat(F.col("c_custkey"), F.lit("/view")).alias("order_id")
    )
    kept = insert_if_absent(arriving, held, "order_id", ["ts", "event_id"])
    return kept.select("event_id", "order_id")


def schema_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Schema identity of every event's JSON shape, computed from the data."""
    from streamwarden.operators.catalog import fingerprint_of

    ev = events(spark, folder)
    shape = F.create_map(F.col("event_type"), F.lit("string"), F.lit("k"), F.lit("int"), F.lit("a\"b"), F.lit("é"))
    return (
        ev.select(fingerprint_of(shape).alias("schema_fingerprint"))
        .groupBy("schema_fingerprint")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def schema_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Schemas whose fingerprint is new, per document source, against those seen in English."""
    from streamwarden.operators.catalog import fingerprint_of

    docs = table(spark, folder, "documents")
    shape = F.create_map(F.lit("text"), F.lit("string"), F.lit("lang"), F.col("lang"))
    seen = docs.select(F.col("source").alias("dataset_name"), fingerprint_of(shape).alias("schema_fingerprint"), "lang")
    published = seen.where(F.col("lang").isin("en", "fr")).distinct()
    return C.changed_schema_events(seen.select("dataset_name", "schema_fingerprint", "lang").distinct(), published)


_JUDGED = f"""WITH {O.FEED_SQL},
judged AS (
  SELECT o_orderkey, bend, order_id, customer_id, order_total,
    CASE WHEN bend = {O.CUT_OFF} THEN ['malformed_json']
         WHEN bend = {O.ARRAY} THEN ['not_an_object']
    ELSE list_filter([
      CASE WHEN bend = {O.RENAMED} THEN 'missing_required_field:order_total' END,
      CASE WHEN bend = {O.TEXT_TOTAL} THEN 'type_mismatch:order_total:expected_float' END,
      CASE WHEN bend IN ({O.NO_PAYMENT}, {O.NULLS}) THEN 'missing_required_field:payment_method'
           WHEN payment_method = 'voucher' THEN 'invalid_value:payment_method:voucher' END,
      CASE WHEN region = 'ME' THEN 'invalid_value:region:ME' END,
      CASE WHEN bend = {O.TRUE_COUNT} OR (bend = {O.DECIMAL_COUNT} AND item_count IS NOT NULL)
           THEN 'type_mismatch:item_count:expected_int' END,
      CASE WHEN order_total > 100000 AND bend NOT IN ({O.RENAMED}, {O.TEXT_TOTAL})
           THEN 'range_check:order_total:above_max' END,
      CASE WHEN unit_price > 100000 THEN 'range_check:unit_price:above_max' END
    ], lambda x: x IS NOT NULL) END AS found
  FROM feed)
"""
_TOPIC = f"CASE WHEN len(found) = 0 THEN '{C.VALID_TOPIC}' ELSE '{C.HEALER_TOPIC}' END"

QUERIES = {
    "violation_counts": violation_counts,
    "contract_route": contract_route,
    "quarantine_envelope": quarantine_envelope,
    "pii_mask": pii_mask,
    "audit_log": audit_log,
    "json_props": json_props,
    "sink_insert": sink_insert,
    "schema_fingerprint": schema_fingerprint,
    "schema_changes": schema_changes,
}

ORACLE = {
    "violation_counts": _JUDGED
    + f"""SELECT topic, violation, count(*) AS records
FROM (SELECT {_TOPIC} AS topic, unnest(found) AS violation FROM judged) GROUP BY 1, 2""",
    "contract_route": _JUDGED
    + f"SELECT o_orderkey, {_TOPIC} AS topic, array_to_string(found, '|') AS violations FROM judged",
    "quarantine_envelope": _JUDGED
    + f"""SELECT o_orderkey, 'schema_mismatch' AS event_type, 'orders_v1' AS contract_name,
 CAST(36 AS INTEGER) AS report_id_chars,
 CASE WHEN bend NOT IN ({O.CUT_OFF}, {O.ARRAY}) THEN order_id END AS record_order_id,
 CASE WHEN bend = {O.CUT_OFF} THEN CAST(200 AS BIGINT) END AS raw_chars
FROM judged WHERE len(found) > 0""",
    "pii_mask": _JUDGED
    + """SELECT order_id, substr(sha256(customer_id), 1, 16) AS customer_id,
 order_total FROM judged WHERE len(found) = 0""",
    "audit_log": _JUDGED
    + """SELECT CASE WHEN len(found) = 0 THEN 'validation_pass' ELSE 'validation_fail' END AS event_type,
 'raw-data' AS source_topic,
 CASE WHEN len(found) = 0 THEN '-' ELSE 'schema_evolution_requests' END AS routed_via, count(*) AS entries
FROM judged GROUP BY 1, 2, 3""",
    "json_props": f"""
SELECT event_id, concat_ws('|',
  CASE WHEN k NOT BETWEEN 0 AND 89 THEN 'invalid_value:k:' || k END,
  CASE WHEN event_type = 'click' THEN 'not_null:ref' END,
  CASE WHEN value < 5 THEN 'range_check:value:below_min' WHEN value > 40 THEN 'range_check:value:above_max' END,
  CASE WHEN event_type = 'view' THEN 'freshness:seen:unparseable_timestamp'
       WHEN late / 60.0 > 30000 THEN 'freshness:seen:delay_' || (late // 60) || 'm' END) AS violations
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CAST(epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(date_trunc('second', ts)) AS BIGINT) AS late FROM events)""",
    "sink_insert": """
SELECT event_id, order_id FROM (
  SELECT event_id, order_id, row_number() OVER (PARTITION BY order_id ORDER BY ts, event_id) AS rn
  FROM (SELECT *, CASE WHEN event_type <> 'signup' THEN user_id || '/' || event_type END AS order_id FROM events))
WHERE order_id IS NULL
   OR (rn = 1 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey || '/view' = order_id))""",
    "schema_fingerprint": r"""
SELECT substr(sha256(CASE WHEN event_type < 'k'
    THEN '{"a\"b": "\u00e9", "' || event_type || '": "string", "k": "int"}'
    ELSE '{"a\"b": "\u00e9", "k": "int", "' || event_type || '": "string"}' END), 1, 16) AS schema_fingerprint,
  count(*) AS events FROM events GROUP BY 1""",
    "schema_changes": """
SELECT DISTINCT source AS dataset_name, lang,
  substr(sha256('{"lang": "' || lang || '", "text": "string"}'), 1, 16) AS schema_fingerprint
FROM documents WHERE lang NOT IN ('en', 'fr')""",
}
