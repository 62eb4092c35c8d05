"""Repair of records whose shape does not match their contract."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from streamwarden.contracts import DEAD_LETTER_TOPIC, VALID_TOPIC, Contract
from streamwarden.functions import json_values as J
from streamwarden.functions.binding import computed_once
from streamwarden.operators.guard import GuardSettings, GuardState, guard_state, replay_guard
from streamwarden.operators.mapping import OPS_TYPE, apply_mapping, checked_rules, normalized_tokens, op_literal
from streamwarden.operators.mask import masked_members
from streamwarden.operators.route import stable_id
from streamwarden.operators.validate import Cell, by_contract, contract_checks, typed_members
from streamwarden.session import bounded_side, cut

Contracts = Contract | Mapping[str, Contract]
MIN_CONFIDENCE = 0.6
REPAIR_TYPES = ("string", "integer", "float", "boolean")
ALIAS_NARRATIVE = "A unique contract-safe field alias was renamed and revalidated."


def _read_requests(messages: DataFrame, value: str) -> DataFrame:
    doc = F.col("document")
    text = {n: J.as_string(J.member(doc, n)) for n in ("event_type", "contract_name", "report_id")}
    return computed_once(
        messages.withColumn("document", J.parse_json(F.col(value))),
        F.coalesce(F.nullif(text["report_id"], F.lit("")), stable_id(F.col(value))).alias("report_id"),
        text["contract_name"].alias("contract_name"),
        J.members(J.member(doc, "record")).alias("record"),
        text["event_type"].alias("event_type"),
        keep=[c for c in messages.columns if c.startswith("source_")],
    )


def _is_mismatch() -> Column:
    return F.coalesce(F.col("event_type") == "schema_mismatch", F.lit(False))


def _is_named() -> Column:
    return F.coalesce(F.length("contract_name"), F.lit(0)) > 0


def mismatch_requests(messages: DataFrame, value: str = "value") -> DataFrame:
    """(report_id, contract_name, record): schema-mismatch messages whose record is an object."""
    return _read_requests(messages, value).where(_is_mismatch() & _is_named() & F.col("record").isNotNull()).drop("event_type")


def unreadable_requests(messages: DataFrame, value: str = "value") -> DataFrame:
    """The schema-mismatch messages that cannot be repaired at all, as dead letters: no
    contract is named, or the record is not an object. With ``mismatch_requests``
    they make up all schema-mismatch messages."""
    reason = F.when(~_is_named(), "contract_not_named").otherwise("record_not_object")
    read = _read_requests(messages.withColumn("source_text", F.col(value).cast("string")), value)
    lost = read.where(_is_mismatch() & (~_is_named() | F.col("record").isNull()))
    return lost.select(
        *[c for c in messages.columns if c.startswith("source_")],
        F.lit(DEAD_LETTER_TOPIC).alias("topic"),
        "report_id",
        reason.alias("reason"),
        F.col("source_text").alias("value"),
    )


def _buckets(record: Column, contract: Contract, cell: Cell) -> Column:
    """struct of four lists: missing, unexpected, types and values (name and text), with NULL for
    every field that nothing is wrong with (``_compacted``)."""
    texts = "array<string>"
    types, values = [], []
    for spec in contract.fields:
        value, kind = cell(spec.name)
        present = ~J.is_void(kind)
        if spec.type in REPAIR_TYPES:
            wrong = present & ~J.TYPE_TESTS[spec.type](kind)
            types.append(F.when(wrong, F.lit(f"{spec.name} (expected {spec.type})")))
        if spec.allowed_values:
            shown = J.display_text(value, kind)
            quoted = F.when(kind == "STRING", F.concat(F.lit("'"), shown, F.lit("'"))).otherwise(shown)
            odd = present & ~J.is_one_of(value, kind, spec.allowed_values)
            named = F.struct(F.lit(spec.name).alias("n"), F.concat(F.lit(f"{spec.name}="), quoted).alias("t"))
            values.append(F.when(odd, named))
    missing = [F.when(J.is_void(cell(n)[1]), F.lit(n)) for n in contract.required_for_repair()]
    known = F.array(*[F.lit(n) for n in contract.field_names]).cast(texts)
    return F.struct(
        F.array(*missing).cast(texts).alias("missing"),
        F.array_except(F.map_keys(record), known).alias("unexpected"),
        F.array(*types).cast(texts).alias("types"),
        F.array(*values).cast("array<struct<n:string,t:string>>").alias("values"),
    )


def _compacted(found: Column) -> Column:
    lists = [F.array_compact(found[n]).alias(n) if n != "unexpected" else found[n].alias(n) for n in ("missing", "unexpected", "types", "values")]
    return F.when(found.isNotNull(), F.struct(*lists))


def rechecked(
    df: DataFrame, contracts: Contracts, record: str = "record", into: str = "check", as_of: Column | None = None
) -> DataFrame:
    """``df`` with ``into``: the buckets of each record under the contract it names.

    NULL where the record is NULL or its contract unknown. With ``as_of`` the violations of the
    whole contract, quality rules included, are added as ``<into>_violations``.
    """
    known = by_name(contracts)
    held = F.col(record)
    chosen = _chosen_by(df, known)
    typed, cell = typed_members(df, known, held, lambda record, n: F.try_element_at(record, F.lit(n)))
    found = [by_contract(known, chosen, lambda c: F.when(held.isNotNull(), _buckets(held, c, cell))).alias(into)]
    if as_of is not None:
        rest = contract_checks(known, chosen, cell, as_of)
        found.append(F.when(held.isNotNull(), rest).alias(f"{into}_violations"))
    made = computed_once(typed, *found, keep=df.columns, apart=True)
    shown = [_compacted(F.col(into)).alias(into)]
    if as_of is not None:
        shown.append(F.array_compact(f"{into}_violations").alias(f"{into}_violations"))
    return computed_once(made, *shown, keep=df.columns)


def _chosen_by(df: DataFrame, known: Mapping[str, Contract]) -> str | None:
    """Records that name no contract at all can only be judged by the one there is."""
    return None if len(known) == 1 and "contract_name" not in df.columns else "contract_name"


def by_name(contracts: Contracts) -> dict[str, Contract]:
    """Repair finds a record's contract by the name in its request."""
    return dict(contracts) if isinstance(contracts, Mapping) else {contracts.name: contracts}


def is_valid(check: Column, strict: bool = False) -> Column:
    sound = (F.size(check["missing"]) == 0) & (F.size(check["types"]) == 0) & (F.size(check["values"]) == 0)
    return sound & (F.size(check["unexpected"]) == 0) if strict else sound


def diagnostic_text(check: Column) -> Column:
    def part(label: str, items: Column) -> Column:
        listed = F.array_join(F.transform(F.array_sort(items), _quoted), ", ")
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.lit(": ["), listed, F.lit("]")))

    text = F.concat_ws(
        "; ",
        part("missing required fields", check["missing"]),
        part("unexpected fields not in contract", check["unexpected"]),
        part("type mismatches", check["types"]),
        part("invalid enum values", F.transform(check["values"], lambda v: v["t"])),
    )
    return F.when(text == "", "valid").otherwise(text)


def _quoted(item: Column) -> Column:
    """An item the way a printed list shows it: double quotes when it holds single ones."""
    return F.when(item.contains("'"), F.concat(F.lit('"'), item, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), item, F.lit("'"))
    )


def signature(check: Column) -> Column:
    """What is wrong, without the values: records that one repair fits share it."""
    def part(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(F.array_sort(items), ",")))

    bare = F.transform(check["types"], lambda t: F.regexp_replace(t, r" \(expected .*$", ""))
    return F.concat_ws(
        "|",
        part("missing=", check["missing"]),
        part("unexpected=", check["unexpected"]),
        part("types=", bare),
        part("values=", F.transform(check["values"], lambda v: v["n"])),
    )


def alias_ops(record: Column, check: Column, contract: Contract, strict: bool = False) -> Column:
    """Rename (and cast) when exactly one unexpected field is the one missing field by another name.

    NULL when the rule does not apply.
    """
    target = check["missing"][0]
    same = F.filter(check["unexpected"], lambda u: normalized_tokens(u) == normalized_tokens(target))
    only = (F.size(check["missing"]) == 1) & (F.size(check["types"]) == 0) & (F.size(check["values"]) == 0)
    if strict:
        only = only & (F.size(check["unexpected"]) == 1)
    kinds = {f.name: "integer" if f.type == "int" else f.type for f in contract.fields}
    casts = {n: k for n, k in kinds.items() if k in REPAIR_TYPES}
    target_type = F.lit(None).cast("string")
    for name, kind in casts.items():
        target_type = F.when(target == name, F.lit(kind)).otherwise(target_type)
    source = same[0]
    usable = only & (F.size(same) == 1) & target_type.isNotNull() & ~J.is_nothing(F.try_element_at(record, source))
    rename = op_literal("rename_field", source=source, target=target)
    cast = op_literal("cast_type", field=target, target_type=target_type)
    ops = F.when(target_type == "string", F.array(rename)).otherwise(F.array(rename, cast))
    return F.when(F.coalesce(usable, F.lit(False)), ops.cast(OPS_TYPE))


def diagnosed(requests: DataFrame, contracts: Contracts, strict: bool = False) -> DataFrame:
    """Add ``check``, ``signature``, ``diagnostic`` and ``alias_ops``, by the contract each request
    names; NULL where nobody knows it."""
    known = by_name(contracts)
    check = F.col("check")
    alias = by_contract(known, _chosen_by(requests, known), lambda c: alias_ops(F.col("record"), check, c, strict))
    return computed_once(
        rechecked(requests, known),
        F.when(check.isNotNull(), signature(check)).alias("signature"),
        F.when(check.isNotNull(), diagnostic_text(check)).alias("diagnostic"),
        F.when(check.isNotNull(), alias).cast(OPS_TYPE).alias("alias_ops"),
    )


def mismatch_signatures(diagnosed_requests: DataFrame) -> DataFrame:
    """The distinct problems, how often each occurs and one record that shows it."""
    return diagnosed_requests.groupBy("contract_name", "signature").agg(
        F.count(F.lit(1)).alias("records"),
        F.min_by(F.to_json("record"), "report_id").alias("sample"),
    )


def rules_by_signature(rules: DataFrame) -> DataFrame:
    """One checked rule per (contract, signature): the most confident, then the first by text."""
    best = F.max_by(F.struct(*[F.col(c) for c in rules.columns]), F.struct("confidence", "ops_json"))
    one = rules.groupBy("contract_name", "signature").agg(best.alias("r")).select("r.*")
    return checked_rules(one)


def heal(
    requests: DataFrame,
    contracts: Contracts,
    rules: DataFrame,
    strict: bool = False,
    min_confidence: float = MIN_CONFIDENCE,
    as_of: Column | None = None,
) -> DataFrame:
    """Outcome of every request: topic, reason, confidence, applied operations, healed record.

    A request is judged, repaired and masked by the contract it names, one of
    ``contracts`` (or the only one); where that contract is not known it is a dead letter with
    reason ``contract_not_found``. A repaired record must pass the whole contract
    again, quality rules included, and is masked before it goes on. Records without
    operations skip the fold. The rules hold one row per distinct problem; they are
    broadcast only after a check of their size, so records are shuffled for them only
    where they are very many.
    """
    known = by_name(contracts)
    as_of = F.current_timestamp() if as_of is None else as_of
    proposals = rules_by_signature(rules).select(
        "contract_name",
        "signature",
        F.col("ops").alias("rule_ops"),
        "rule_error",
        F.col("root_cause_category").alias("rule_category"),
        F.col("narrative").alias("rule_narrative"),
        F.col("confidence").alias("rule_confidence"),
        F.col("model_used").alias("rule_model"),
    )
    found = diagnosed(requests, known, strict)
    joined = found.join(bounded_side(proposals), ["contract_name", "signature"], "left")
    lost = ~F.coalesce(F.col("contract_name").isin(*known), F.lit(False))
    alias = F.col("alias_ops").isNotNull()
    chosen = computed_once(
        joined,
        lost.alias("lost"),
        alias.alias("by_alias"),
        F.coalesce("alias_ops", "rule_ops", F.array().cast(OPS_TYPE)).alias("ops"),
        F.when(~alias, F.col("rule_error")).alias("error"),
        F.when(alias, 1.0).otherwise(F.coalesce("rule_confidence", F.lit(0.0))).alias("confidence"),
        F.when(alias, "field_renamed").otherwise(F.coalesce("rule_category", F.lit("unknown"))).alias("root_cause_category"),
        F.when(alias, ALIAS_NARRATIVE).otherwise(F.coalesce("rule_narrative", F.lit(""))).alias("narrative"),
        F.when(~alias, F.col("rule_model")).alias("model_used"),
        keep=[*requests.columns, "signature", "diagnostic"],
    )
    usable = ~F.col("lost") & F.col("error").isNull() & (F.size("ops") > 0) & (F.col("confidence") >= min_confidence)
    folded = computed_once(chosen, F.when(usable, apply_mapping(F.col("record"), F.col("ops"))).alias("_h"))
    split = computed_once(folded, F.col("_h.record").alias("_after"), F.col("_h.failed").alias("_failed"), keep=chosen.columns)
    again = rechecked(split, known, "_after", "_check", as_of)
    invalid = ~is_valid(F.col("_check"), strict)
    rest = F.array_join("_check_violations", "; ")
    reason = (
        F.when(F.col("lost"), F.concat(F.lit("contract_not_found: "), F.coalesce("contract_name", F.lit(""))))
        .when(F.col("error").isNotNull(), F.concat(F.lit("mapping_rejected: "), F.col("error")))
        .when(
            ~usable,
            F.format_string(
                f"low_confidence_or_no_ops: confidence=%.2f (min={min_confidence}), ops=%d",
                F.col("confidence"),
                F.size("ops"),
            ),
        )
        .when(F.col("_failed"), F.lit("cast_failed"))
        .when(invalid, F.concat(F.lit("post_heal_revalidation_failed: "), diagnostic_text(F.col("_check"))))
        .when(rest != "", F.concat(F.lit("post_heal_revalidation_failed: "), rest))
        .when(F.col("by_alias"), F.lit("healed_and_revalidated_with_deterministic_rename"))
        .otherwise(F.lit("healed_and_revalidated"))
    )
    success = F.col("reason").startswith("healed_and_revalidated")
    masked = by_contract(known, "contract_name", lambda c: masked_members(F.col("_after"), c))
    return computed_once(again, reason.alias("reason")).select(
        *requests.columns,
        "signature",
        "diagnostic",
        success.alias("success"),
        F.when(success, VALID_TOPIC).otherwise(DEAD_LETTER_TOPIC).alias("topic"),
        "reason",
        "root_cause_category",
        "narrative",
        "confidence",
        "model_used",
        F.when(usable, F.col("ops")).otherwise(F.array().cast(OPS_TYPE)).alias("ops_applied"),
        F.when(success, masked).alias("healed"),
    )


def with_guard(outcomes: DataFrame, at: str, settings: GuardSettings = GuardSettings(), partitions: int | None = None):
    """Send records that arrive while their contract is paused to the dead-letter topic."""
    return guarded(outcomes, at, settings, None, partitions)[0]


def guarded(
    outcomes: DataFrame,
    at: str,
    settings: GuardSettings = GuardSettings(),
    held: DataFrame | None = None,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Outcomes behind the guard, and the states it leaves (contract_name, failures, trip_count, paused_until).

    Repairs carry no state and are worked out for all records at once; only
    (contract, time, id, success) goes through the ordered guard. Outcomes are
    written once, as the guard and the final join both read them; decisions go back
    by the row, so a repeated report id neither multiplies rows nor is a hot key. ``held``
    are the states the contracts were left in, one row for each known contract at most.
    """
    outcomes = cut(numbered(outcomes))
    decided = cut(guard_decisions(outcomes, at, settings, held, partitions))
    return behind_guard(outcomes, decided), states_left(decided)


def numbered(outcomes: DataFrame) -> DataFrame:
    """Rows are told apart by where they are written, as report ids may repeat."""
    return outcomes.withColumn("_row", F.monotonically_increasing_id())


def guard_decisions(
    outcomes: DataFrame,
    at: str,
    settings: GuardSettings = GuardSettings(),
    held: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """What the guard makes of numbered outcomes that have been written."""
    attempts = outcomes.where(~F.col("reason").startswith("contract_not_found")).select(
        F.col("contract_name").alias("key"),
        F.col(at).cast("double").alias("at"),
        F.col("report_id").alias("tie"),
        F.lit("attempt").alias("kind"),
        "success",
        "_row",
    )
    before = {}
    if held is not None:
        before = {r.contract_name: GuardState(r.failures, r.trip_count, r.paused_until) for r in held.collect()}
    return replay_guard(attempts, settings, partitions, before)


def behind_guard(outcomes: DataFrame, decided: DataFrame) -> DataFrame:
    """Numbered outcomes with those the guard paused replaced."""
    paused = decided.where("paused").select("_row", "guard_reason")
    joined = outcomes.join(paused, "_row", "left")
    stopped = F.col("guard_reason").isNotNull()
    replaced = {
        "success": F.col("success") & ~stopped,
        "topic": F.when(stopped, DEAD_LETTER_TOPIC).otherwise(F.col("topic")),
        "reason": F.when(stopped, F.col("guard_reason")).otherwise(F.col("reason")),
        "root_cause_category": F.when(stopped, "unknown").otherwise(F.col("root_cause_category")),
        "narrative": F.when(stopped, "Contract is in cooldown after repeated failures.").otherwise(F.col("narrative")),
        "confidence": F.when(stopped, 0.0).otherwise(F.col("confidence")),
        "model_used": F.when(~stopped, F.col("model_used")),
        "ops_applied": F.when(stopped, F.array().cast(OPS_TYPE)).otherwise(F.col("ops_applied")),
        "healed": F.when(~stopped, F.col("healed")),
    }
    return joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in outcomes.columns if c != "_row"])


def slices(outcomes: DataFrame, size: int, most: int) -> list[Column]:
    """Conditions that deal written outcomes of ``size`` bytes into slices of about ``most``, so that
    a join with all of them need not have them all in its shuffle at once."""
    parts = -(-size // most)
    cuts = outcomes.approxQuantile("_row", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    row = F.col("_row")
    return [
        (F.lit(True) if low is None else row >= low) & (F.lit(True) if high is None else row < high)
        for low, high in zip(edges, edges[1:])
    ]


def states_left(decided: DataFrame) -> DataFrame:
    return guard_state(decided).withColumnRenamed("consecutive_failures", "failures")


def lineage(outcomes: DataFrame, healed_at: Column) -> Column:
    names = ("report_id", "contract_name", "success", "reason", "root_cause_category", "confidence", "model_used")
    return F.struct(*[F.col(n) for n in names], healed_at.alias("healed_at"))


def as_texts(outcomes: DataFrame) -> DataFrame:
    """``record`` and ``healed`` as the JSON that messages carry. As maps of VARIANTs they are many times
    as large, since each value has the names of the whole document with it."""
    return outcomes.withColumns({"record": F.to_json(F.struct("record")), "healed": F.to_json("healed")})


def healed_messages(outcomes: DataFrame, healed_at: Column) -> DataFrame:
    """One message per outcome: the healed record, or the original for the dead-letter topic."""
    told = outcomes if dict(outcomes.dtypes)["record"] == "string" else as_texts(outcomes)
    return told.select(
        "topic",
        F.when(F.col("success"), F.col("healed")).otherwise(F.col("record")).alias("value"),
        F.to_json(lineage(told, healed_at)).alias("lineage"),
    )


def healing_reports(outcomes: DataFrame, created_at: Column) -> DataFrame:
    names = "report_id contract_name success reason root_cause_category narrative confidence model_used ops_applied"
    return outcomes.select(*names.split(), created_at.alias("created_at"))
