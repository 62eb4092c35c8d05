"""Validate, mask and route records in one pass over the stream or table."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from streamwarden.contracts import DEAD_LETTER_TOPIC, Contract
from streamwarden.functions import json_values as J
from streamwarden.functions.times import iso_text
from streamwarden.operators.mask import masked_json
from streamwarden.operators.validate import by_contract, with_violations

RAW_PREFIX = 200  # characters of an unreadable record in ``_raw``; longer ones are whole in the message's ``raw_text``


def stable_id(*parts: Column) -> Column:
    """An id that comes out the same when the same record is read again."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)


def envelope(
    contract_name: Column, record_json: Column, report_id: Column, found: Column, at: Column, raw_text: Column | None = None
) -> Column:
    """Violation message. The record goes in as it was written, so that 3.0 does not become 3;
    ``raw_text`` stands beside it where it is not NULL."""
    whole = F.lit(None).cast("string") if raw_text is None else raw_text
    head = F.struct(
        F.lit("schema_mismatch").alias("event_type"),
        report_id.alias("report_id"),
        contract_name.alias("contract_name"),
        found.alias("violations"),
        iso_text(at).alias("quarantined_at"),
        whole.alias("raw_text"),
    )
    return F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"record":'), record_json, F.lit("}"))


def route(
    df: DataFrame,
    contract: Contract | Mapping[str, Contract],
    value: str = "value",
    coordinates: Sequence[str] = ("topic", "partition", "offset"),
    as_of: Column | None = None,
) -> DataFrame:
    """Send each record to the valid, repair or dead-letter topic.

    ``contract`` is one contract for all records, or contracts by source topic: each record
    is judged, masked and routed by its own topic's contract, and one of a topic without
    contract is a dead letter. Works on batch and streaming frames and needs no
    shuffle. Keeps the coordinate columns under ``source_*`` names and adds ``topic``,
    ``value``, ``report_id``, ``contract_name`` and ``violations``.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    text = F.col(value).cast("string")
    chosen = "source_topic" if isinstance(contract, Mapping) else None
    parsed = df.select(
        *[F.col(c).alias(f"source_{c}") for c in coordinates],
        text.alias("raw"),
        J.parse_json(text).alias("document"),
        stable_id(*[F.col(c) for c in coordinates]).alias("report_id"),
        as_of.alias("seen_at"),
    )
    judged = with_violations(parsed, contract, "document", "seen_at", chosen)
    whole = F.when(F.col("document").isNull() & (F.length("raw") > RAW_PREFIX), F.col("raw"))
    broken = F.to_json(F.struct(F.substring("raw", 1, RAW_PREFIX).alias("_raw")))
    record = F.when(F.col("document").isNull(), broken).otherwise(F.col("raw"))
    valid = F.size("violations") == 0
    doc = F.col("document")
    name = by_contract(contract, chosen, lambda c: F.lit(c.name))
    sink = by_contract(contract, chosen, lambda c: F.lit(c.sink_topic))
    refused = by_contract(contract, chosen, lambda c: F.lit(c.violation_topic), F.lit(DEAD_LETTER_TOPIC))
    masked = by_contract(contract, chosen, lambda c: masked_json(doc, c))
    return judged.select(
        *[f"source_{c}" for c in coordinates],
        F.when(valid, sink).otherwise(refused).alias("topic"),
        F.when(valid, masked)
        .otherwise(envelope(name, record, F.col("report_id"), F.col("violations"), F.col("seen_at"), whole))
        .alias("value"),
        "report_id",
        name.alias("contract_name"),
        "violations",
        "seen_at",
    )


def audit(routed: DataFrame, contract: Contract | Mapping[str, Contract]) -> DataFrame:
    """One pipeline-event row per routed record."""
    valid = F.size("violations") == 0
    chosen = "source_topic" if isinstance(contract, Mapping) else None
    via = by_contract(
        contract, chosen, lambda c: F.lit("schema_evolution_requests" if c.to_healer else "dead_letter_queue"), F.lit("dead_letter_queue")
    )
    source = F.col("source_topic") if chosen else F.lit(contract.source_topic)
    named = F.col("contract_name").alias("contract")
    failed = F.to_json(F.struct(named, F.col("violations").alias("violations"), via.alias("routed_via")))
    return routed.select(
        F.when(valid, "validation_pass").otherwise("validation_fail").alias("event_type"),
        source.alias("source_topic"),
        F.when(valid, F.to_json(F.struct(named))).otherwise(failed).alias("payload"),
        F.col("seen_at").alias("created_at"),
    )


def violation_counts(routed: DataFrame) -> DataFrame:
    """Records per topic and violation. Outer explode: an inner one would add a filter that judges twice."""
    each = routed.select("topic", F.explode_outer("violations").alias("violation"))
    return each.where("violation is not null").groupBy("topic", "violation").agg(F.count(F.lit(1)).alias("records"))
