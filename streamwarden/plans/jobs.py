"""Registered queries that run the streaming jobs over the tables and read back what they stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from streamwarden import contracts as C
from streamwarden.operators import breaker as B, catalog as K, guard as U, heal as H, route as R
from streamwarden.plans import gating, healing, observing, order_feed as O, routing
from streamwarden.session import shuffles_dropped, use_checkpoint_dir
from streamwarden.sources.tables import events
from streamwarden.streaming import catalog as KS, gating as GS, jobs
from streamwarden.streaming.keyed import STATE_STORE


def _scratch(spark: SparkSession) -> str:
    """A folder of this run's own, where driver and executors both see it."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table read as a stream. As a pattern the path may be a single file, which a source else refuses."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _written_stream(rows: DataFrame, place: str) -> DataFrame:
    with shuffles_dropped(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(place)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(place)


def _end(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _gate_run(spark: SparkSession, folder: str) -> str:
    """The breaker over all events, as a job of two inputs; where it stored its results."""
    out = _scratch(spark)
    ev = _stream(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("monitor_name"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("report_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "event_type",
        (F.col("value") >= 10).alias("success"),
    )
    is_incident = F.col("event_type").isin("error", "view")
    query = GS.gate_stream(
        ev.where(is_incident), ev.where(~is_incident), out, f"{out}/checkpoint", gating.BREAKER, gating.NOTICE_SECONDS, sink="parquet"
    )
    _end(query)
    return out


def gate_job_states(spark: SparkSession, folder: str) -> DataFrame:
    """Monitor states as the gate job stored them, asked for every other user's number."""
    out = _gate_run(spark, folder)
    asked = events(spark, folder).select((F.col("user_id") * 2).cast("string").alias("monitor_name"))
    view = B.state_view(asked, GS.stored_states(spark, out, asked), F.unix_seconds(F.lit("2024-01-31").cast("timestamp")))
    return view.withColumn("cooldown_seconds", F.col("cooldown_seconds").cast("long"))


def gate_job_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event log the gate job appended."""
    log = spark.read.parquet(f"{_gate_run(spark, folder)}/breaker_events")
    return log.select("monitor_name", "event_type", "from_state", "to_state", F.col("related_report_id").alias("report_id"))


def admission_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of a stream of reports; all arrive at the end of the month."""
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    out = _scratch(spark)
    reports = gating._reports_of(_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    arriving = reports.withColumn("timestamp", F.lit("2024-01-31").cast("timestamp"))
    place = F.format_string("%020d:%020d", (F.col("at") * 1e6).cast("long"), "tie")
    labelled = GS.labelled_reports(arriving, 20 * gating.DAY, place=place)
    writer = labelled.select("tie", "admission").writeStream.format("parquet").option("path", f"{out}/labelled")
    _end(writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema("tie long, admission string").parquet(f"{out}/labelled").withColumnRenamed("tie", "event_id")


def _two_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, events under a contract of their own, and a third topic nobody has a contract for."""
    ev = routing._event_documents(spark, folder)
    own = F.when(F.col("event_id") % 7 == 3, "nowhere").otherwise("events")
    told = ev.select(
        own.alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        F.col("text").alias("value"),
    )
    return O.order_feed(spark, folder).unionByName(told)


def _contracts() -> dict[str, C.Contract]:
    return {c.source_topic: c for c in (C.orders_contract(), routing.EVENT_CONTRACT)}


def route_two_contracts(spark: SparkSession, folder: str) -> DataFrame:
    at = F.when(F.col("topic") == C.RAW_TOPIC, F.lit(routing.AS_OF)).otherwise(F.lit(routing.EVENTS_AS_OF)).cast("timestamp")
    routed = R.route(_two_topics(spark, folder), _contracts(), as_of=at)
    return routed.select(
        "source_topic",
        F.col("source_offset").alias("number"),
        "topic",
        "contract_name",
        F.array_join("violations", "|").alias("violations"),
    )


# A second contract for repair, which calls the total an amount.
PRICES = C.from_document(
    {
        "contract_name": "prices_v1",
        "source_topic": "prices",
        "fields": [
            {"name": "order_id", "type": "string", "required": True},
            {"name": "order_amount", "type": "float", "required": True},
        ],
    }
)


def heal_two_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Quarantined orders, a third of them under the orders' contract, a third under prices, and a third lost."""
    name = F.element_at(F.array(F.lit("orders_v1"), F.lit("prices_v1"), F.lit("lost_v1")), (F.col("source_offset") % 3 + 1).cast("int"))
    asked = healing._requests(spark, folder).withColumn("contract_name", name)
    known = {c.name: c for c in (C.orders_contract(), PRICES)}
    healed = H.heal(asked, known, healing._rules(spark), as_of=F.lit(routing.AS_OF).cast("timestamp"))
    return healed.select(
        F.col("source_offset").alias("o_orderkey"),
        "contract_name",
        "success",
        F.substring_index("reason", ":", 1).alias("reason"),
        F.map_contains_key("healed", F.lit("order_amount")).alias("has_amount"),
    )


def heal_job(spark: SparkSession, folder: str) -> DataFrame:
    """Repairs behind the guard as a job: its reports, in one batch of requests an hour apart."""
    out = _scratch(spark)
    sent = routing._routed(spark, folder).where(F.size("violations") > 0).select(
        F.lit(C.HEALER_TOPIC).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("source_offset").alias("offset"),
        F.timestamp_seconds(F.col("source_offset") * 3600).alias("timestamp"),
        F.regexp_replace("value", '"report_id":"[^"]*"', F.concat(F.lit('"report_id":"'), F.col("source_offset").cast("string"), F.lit('"'))).alias("value"),
    )
    query = jobs.heal_stream(
        _written_stream(sent, f"{out}/in"),
        C.orders_contract(),
        healing._rules,
        out,
        f"{out}/checkpoint",
        healing.GUARD,
        as_of=F.lit(routing.AS_OF).cast("timestamp"),
    )
    _end(query)
    return spark.read.parquet(f"{out}/healing_reports").select(
        F.col("report_id").cast("long").alias("o_orderkey"), "success", F.substring_index("reason", ":", 1).alias("reason")
    )


def guard_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Guard of contracts asked for by name; those never attempted are shown as allowed."""
    states = U.guard_state(gating._guarded_kinds(spark, folder))
    kinds = events(spark, folder).select(F.col("event_type").alias("contract_name")).distinct()
    asked = kinds.unionByName(kinds.select(F.concat("contract_name", F.lit("_v2")).alias("contract_name")))
    view = U.guard_view(states, F.unix_seconds(F.lit("2024-01-30 23:59:00").cast("timestamp")), asked)
    return view.select("contract_name", "consecutive_failures", "trip_count", "allowed_now")


def catalog_job(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog of all schema and lineage messages, built by the job and read back."""
    out = _scratch(spark)
    told = observing._catalog_messages(spark, folder).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    _end(KS.catalog_stream(_written_stream(told, f"{out}/in"), out, f"{out}/checkpoint"))
    found = KS.stored_catalog(spark, out).select(
        "dataset_name", "schema_fingerprint", F.size("lineage_upstream").alias("upstream"), F.size("lineage_downstream").alias("downstream")
    )
    lost = KS.dead_letter_count(spark, out).select(
        F.lit("(dead letters)").alias("dataset_name"),
        F.lit("").alias("schema_fingerprint"),
        F.col("dead_letters").cast("int").alias("upstream"),
        F.lit(0).alias("downstream"),
    )
    return found.unionByName(lost)


QUERIES = {
    f.__name__: f
    for f in (
        gate_job_states, gate_job_log, admission_stream, route_two_contracts, heal_two_contracts, heal_job, guard_lookup, catalog_job,
    )
}

_TWO = routing._JUDGED.rstrip() + f""",
told AS ({routing.ORACLE['json_props'].strip()}),
both_topics AS (
  SELECT '{C.RAW_TOPIC}' AS source_topic, o_orderkey AS number, 'orders_v1' AS contract_name, array_to_string(found, '|') AS violations FROM judged
  UNION ALL SELECT CASE WHEN event_id % 7 = 3 THEN 'nowhere' ELSE 'events' END, event_id,
    CASE WHEN event_id % 7 <> 3 THEN 'events_v1' END,
    CASE WHEN event_id % 7 = 3 THEN 'contract_not_found:nowhere' ELSE violations END FROM told)
"""

ORACLE = {
    "gate_job_states": gating.ORACLE["state_view"].replace("SELECT monitor_name, coalesce(st", "SELECT CAST(monitor_name AS VARCHAR) AS monitor_name, coalesce(st"),
    "gate_job_log": gating._BREAKER_SQL
    + gating._THROTTLE_SQL
    + """ SELECT CAST(run.k AS VARCHAR) AS monitor_name, entry AS event_type, prev AS from_state, st AS to_state,
  lpad(CAST(run.event_id AS VARCHAR), 12, '0') AS report_id
FROM run LEFT JOIN told ON told.event_id = run.event_id WHERE rn > 0 AND (entry <> 'incident_blocked' OR notify)""",
    "admission_stream": gating.ORACLE["dedup_stale"],
    "route_two_contracts": _TWO
    + f"""SELECT source_topic, number, contract_name, violations,
  CASE WHEN violations = '' THEN '{C.VALID_TOPIC}' WHEN source_topic = '{C.RAW_TOPIC}' THEN '{C.HEALER_TOPIC}' ELSE '{C.DEAD_LETTER_TOPIC}' END AS topic
FROM both_topics""",
    "heal_two_contracts": healing._HEAL
    + f"""SELECT o_orderkey, name AS contract_name, reason LIKE 'healed%' AS success, reason,
  CASE WHEN reason LIKE 'healed%' THEN name = 'prices_v1' END AS has_amount
FROM (SELECT o_orderkey, ['orders_v1', 'prices_v1', 'lost_v1'][o_orderkey % 3 + 1] AS name,
  CASE o_orderkey % 3 WHEN 2 THEN 'contract_not_found' WHEN 0 THEN reason
    WHEN 1 THEN CASE WHEN b = {O.CUT_OFF} THEN 'low_confidence_or_no_ops'
      ELSE 'healed_and_revalidated_with_deterministic_rename' END END AS reason FROM outc)""",
    "heal_job": healing.ORACLE["heal_guarded"].replace("o_orderkey % 50 AS g", "1 AS g").replace("PARTITION BY o_orderkey % 50 ", ""),
    "guard_lookup": gating.ORACLE["guard_view"]
    + " UNION ALL SELECT DISTINCT event_type || '_v2', 0, 0, true FROM events",
    "catalog_job": observing._LINEAGE
    + """ SELECT d AS dataset_name, f AS schema_fingerprint,
  (SELECT count(DISTINCT s) FROM edge WHERE t = d)::INTEGER AS upstream, (SELECT count(DISTINCT t) FROM edge WHERE s = d)::INTEGER AS downstream
FROM (SELECT DISTINCT source AS d, substr(sha256('{"n' || length(source) || '": "int", "text": "string"}'), 1, 16) AS f
  FROM documents WHERE lang = 'en')
UNION ALL SELECT '(dead letters)', '', (SELECT count(*) + count(*) FILTER (lang <> 'en') FROM documents)::INTEGER, 0""",
}
