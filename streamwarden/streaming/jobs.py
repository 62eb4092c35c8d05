"""Streaming jobs: the batch operators, run on micro-batches.

Every write goes to a folder of its own micro-batch and replaces it, and every
id is derived from the data. A batch that runs again after a failure therefore
leaves the same rows behind.
"""

from __future__ import annotations

import json
from typing import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from streamwarden.contracts import SCHEMA_TOPIC, Contract, changed_schema_events, schema_events
from streamwarden.functions import json_values as J
from streamwarden.operators import forest as I
from streamwarden.operators.features import with_features
from streamwarden.operators.guard import GuardSettings
from streamwarden.operators.heal import (
    as_texts, behind_guard, guard_decisions, heal, healed_messages, healing_reports, mismatch_requests, numbered, slices,
    states_left, unreadable_requests,
)
from streamwarden.operators.route import audit, route
from streamwarden.operators.sinks import VALIDATED_ORDER_COLUMNS, validated_orders
from streamwarden.session import cut, kept, shuffles_dropped
from streamwarden.sources.keyed_table import KeyedTable, replace_rows
from streamwarden.sources.tables import exists
from streamwarden.sources.topics import write_messages


def _run(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _append(rows: DataFrame, folder: str, batch_id: int, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(f"{folder}/batch={batch_id}")


def orders_table(out: str, buckets: int = 64) -> KeyedTable:
    columns = ", ".join(f"{n} {t}" for n, t in VALIDATED_ORDER_COLUMNS.items())
    return KeyedTable(f"{out}/validated_orders", ("order_id",), f"{columns}, ingested_at timestamp", buckets)


def route_stream(
    messages: DataFrame,
    contract: Contract | Mapping[str, Contract],
    out: str,
    checkpoint: str,
    as_of=None,
    sink: str = "json",
    buckets: int = 64,
    **trigger,
) -> StreamingQuery:
    """Validate and route; write messages per topic, the audit log and the validated-orders table.

    With contracts by topic each record meets its own. An order is stored once: a batch reads
    the key column of the buckets its own orders lie in, not the history.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        routed = route(batch, contract, as_of=as_of).persist()
        try:
            write_messages(routed, sink, batch_id, path=f"{out}/messages")
            _append(audit(routed, contract), f"{out}/pipeline_events", batch_id)
            valid = validated_orders(routed.where(F.size("violations") == 0))
            orders_table(out, buckets).insert_if_absent(valid, checkpoint, batch_id, ["ingested_at", "order_total"])
        finally:
            routed.unpersist()

    return _run(messages, work, checkpoint, **trigger)


GUARD_STATE = "contract_name string, failures int, trip_count int, paused_until double"


def guard_table(out: str, buckets: int = 8) -> KeyedTable:
    return KeyedTable(f"{out}/healer_guard", ("contract_name",), GUARD_STATE, buckets)


# What messages, reports and the guard need of an outcome.
KEPT = (
    "report_id contract_name source_timestamp at record success topic reason root_cause_category narrative confidence "
    "model_used ops_applied healed"
).split()


def heal_stream(
    messages: DataFrame,
    contracts: Contract | Mapping[str, Contract],
    rules: Callable[[SparkSession], DataFrame],
    out: str,
    checkpoint: str,
    settings: GuardSettings = GuardSettings(),
    as_of=None,
    sink: str = "json",
    slice_bytes: int = 256 << 20,
    **trigger,
) -> StreamingQuery:
    """Repair mismatch requests behind the guard; store messages, reports and guard states.

    ``rules`` is asked for the rules table at each micro-batch, so a new version of it holds
    from then on. The guard goes on from the stored state of each contract. Requests that
    cannot be read become dead letters; those of a contract nobody knows do as well and do
    not count as attempts.

    Of a batch only what messages and reports need is kept, as texts, until the guard has decided; the
    requests are read twice instead of being held. Decisions come back to slices of ``slice_bytes``, one
    after the other. A batch that runs again begins with its first slice, which replaces the folder.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        named = batch.select("value", *[F.col(c).alias(f"source_{c}") for c in ("topic", "partition", "offset", "timestamp")])
        healed = as_texts(heal(mismatch_requests(named), contracts, rules(spark), as_of=as_of))
        timed = numbered(healed.withColumn("at", F.unix_micros("source_timestamp") / F.lit(1e6)).select(*KEPT))
        table = guard_table(out)
        held = table.read(spark, manifest=table.base(spark, checkpoint, batch_id))
        arrived = F.col("source_timestamp")
        compression = {"compression": "gzip"} if sink == "json" else {}
        with kept(timed) as (outcomes, size), kept(guard_decisions(outcomes, "at", settings, held)) as (decided, _):
            for k, part in enumerate(slices(outcomes, size, slice_bytes)):
                mode = "append" if k else "overwrite"
                # in compressed columns even many decisions look small enough to be broadcast
                judged = behind_guard(outcomes.where(part), decided.where(part).hint("merge"))
                told = healed_messages(judged, arrived)
                if k == 0:
                    lost = unreadable_requests(named).select("topic", "value", F.lit(None).cast("string").alias("lineage"))
                    told = told.unionByName(lost)
                with shuffles_dropped(spark):
                    write_messages(
                        told, sink, batch_id, mode, path=f"{out}/messages", columns=("topic", "value", "lineage"), **compression
                    )
                    _append(healing_reports(judged, arrived), f"{out}/healing_reports", batch_id, mode)
            table.upsert(states_left(decided), checkpoint, batch_id, replace_rows("contract_name"))

    return _run(messages, work, checkpoint, **trigger)


STORED_FEATURES = (
    "row_key string, timestamp timestamp, features array<double>, order_id string, anomaly_score double, "
    "is_anomaly boolean, order_total double, batch int"
)


def stored_features(spark: SparkSession, out: str, below: int | None = None) -> DataFrame:
    """Feature rows the scoring job has written, of batches below one if it is given."""
    place = f"{out}/order_features"
    rows = spark.read.schema(STORED_FEATURES).parquet(place) if exists(spark, place) else spark.createDataFrame([], STORED_FEATURES)
    return rows if below is None else rows.where(F.col("batch") < below)


def order_features(orders: DataFrame) -> DataFrame:
    """Feature rows of validated orders, for a model before anything has been scored.

    The hour is that of the time of arrival, as the table keeps no other.
    """
    told = F.to_json(
        F.struct(
            "order_total",
            F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
            "item_count",
            "unit_price",
            "discount_pct",
            "shipping_cost",
        )
    )
    rows = orders.where("order_total is not null").select(
        F.col("ingested_at").alias("timestamp"), F.coalesce("order_id", told).alias("row_key"), J.parse_json(told).alias("document")
    )
    return with_features(rows).select("row_key", "timestamp", "features")


def warm_start(
    spark: SparkSession, models: str, out: str, version: int, orders: DataFrame | None = None
) -> tuple[I.Forest | None, dict]:
    """A model before version ``version``, and how it was come by.

    The newest usable version of the registry; else one trained on the newest stored features; else,
    with fewer than 50 of them, on the newest validated orders; else none yet. Nothing written by
    the batch itself is looked at, so a batch that runs again finds the same.
    """
    found = I.newest(spark, models, before=version)
    if found is not None:
        return found, {"status": "registered"}
    earlier = stored_features(spark, out, version)
    fallback = earlier if orders is None else order_features(orders)
    status, nodes = I.retrain(earlier, fallback, "timestamp", "row_key")
    if nodes is None:
        return None, status
    I.save(nodes, models, version, status["n_samples"], f"batch {version}")
    return I.newest(spark, models), status


def _event(spark: SparkSession, kind: str, **payload) -> DataFrame:
    return spark.createDataFrame([(kind, json.dumps(payload))], "event_type string, payload string")


def score_stream(
    messages: DataFrame, models: str, out: str, checkpoint: str, orders: Callable[[SparkSession], DataFrame] | None = None, **trigger
) -> StreamingQuery:
    """Score validated orders with the newest model; the first 50 orders make the first model.

    Without a model, one is come by as in ``warm_start``; ``orders`` gives the validated orders
    for its last step. Each training and each anomaly leaves an audit row in ``pipeline_events``.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # an offset is unique within its partition only
        place = F.format_string("%s:%010d:%020d", "topic", "partition", "offset").alias("row_key")
        documents = batch.select(place, "timestamp", J.parse_json(F.col("value")).alias("document"))
        rows = with_features(documents).select("row_key", "timestamp", "features", J.as_string(J.member(F.col("document"), "order_id")).alias("order_id"))
        model, status = warm_start(spark, models, out, batch_id, orders(spark) if orders else None)
        unscored = rows.withColumn("anomaly_score", F.lit(None).cast("double")).withColumn("is_anomaly", F.lit(None).cast("boolean"))
        scored = I.score(rows, model) if model else unscored
        stored = f"{out}/order_features"
        _append(scored.withColumn("order_total", F.col("features")[0]), stored, batch_id)
        log = spark.createDataFrame([], "event_type string, payload string")
        if status["status"] == "retrained":
            log = _event(spark, "model_retrain", n_samples=status["n_samples"], source=status["source"])
        if model is None:
            seen = stored_features(spark, out, batch_id + 1)
            status, nodes = I.retrain(seen, seen, "timestamp", "row_key")
            if nodes is not None:
                # seen by later batches only: versions below their number
                I.save(nodes, models, batch_id, status["n_samples"], f"batch {batch_id}")
                log = _event(spark, "model_bootstrap", n_samples=status["n_samples"])
        else:
            told = I.anomaly_messages(spark.read.parquet(f"{stored}/batch={batch_id}"), F.col("order_id"), F.col("timestamp"))
            write_messages(told, "json", batch_id, path=f"{out}/messages")
            log = log.unionByName(told.select(F.lit("anomaly").alias("event_type"), F.col("value").alias("payload")))
        _append(log, f"{out}/pipeline_events", batch_id)

    return _run(messages, work, checkpoint, **trigger)


PUBLISHED = "dataset_name string, schema_fingerprint string, schema map<string,string>"


def publish_schemas(spark: SparkSession, contracts: Mapping[str, Contract], out: str, run: str, batch: int, sink: str = "json") -> DataFrame:
    """Announce the schemas of loaded contracts that differ from what was announced last.

    The last fingerprint of each dataset is kept in a small table; a start that is repeated
    compares with what was there before it and announces the same again.
    """
    table = KeyedTable(f"{out}/published_schemas", ("dataset_name",), PUBLISHED, buckets=4)
    published = table.read(spark, manifest=table.base(spark, run, batch))
    changed = cut(changed_schema_events(schema_events(spark, contracts.values()), published))
    body = F.to_json(F.struct("dataset_name", "schema"))
    write_messages(changed.select(F.lit(SCHEMA_TOPIC).alias("topic"), body.alias("value")), sink, batch, path=f"{out}/messages")
    table.upsert(changed, run, batch, replace_rows("dataset_name"))
    return changed
