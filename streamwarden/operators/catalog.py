"""Data catalog: schema identity, event triage, lineage and entry upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from streamwarden.functions import json_values as J

PENDING_PREFIX = "(description pending"
SCHEMA_TOPIC = "schema-events"
LINEAGE_TOPIC = "openlineage-events"


def _json_string(text: Column) -> Column:
    """A JSON string literal with everything outside ASCII escaped."""
    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(escaped))
    units = F.regexp_extract_all(F.hex(F.encode(quoted, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    plain = F.transform(
        units,
        lambda u: F.when(
            u.between("0020", "007E"), F.chr(F.conv(u, 16, 10).cast("bigint"))
        ).otherwise(F.concat(F.lit("\\u"), F.lower(u))),
    )
    safe = F.when(quoted.rlike(r"^[ -~]*$"), quoted).otherwise(F.array_join(plain, ""))
    return F.concat(F.lit('"'), safe, F.lit('"'))


def fingerprint_of(shape: Column) -> Column:
    """Identity of a name-to-type map: the same value the contract side computes."""
    pairs = F.transform(
        F.array_sort(F.map_entries(shape)),
        lambda e: F.concat(_json_string(e["key"]), F.lit(": "), _json_string(e["value"])),
    )
    text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return F.substring(F.sha2(text, 256), 1, 16)


def classify(messages: DataFrame, topic: str = "topic", value: str = "value") -> DataFrame:
    """Label each catalog message with the ``branch`` it takes and, for rejects, a ``reason``.

    Branches: ``schema``, ``lineage``, ``ignore`` (a run that did not complete)
    and ``dead_letter``.
    """
    document = F.col("document")
    kind = J.json_type(document)
    on_lineage = F.col(topic) == LINEAGE_TOPIC
    event = J.as_string(J.member(document, "eventType"))
    schema_kind = J.json_type(J.member(document, "schema"))
    no_schema = F.coalesce(~J.is_object(schema_kind) | (schema_kind == "OBJECT<>"), F.lit(True))
    reason = (
        F.when(document.isNull(), F.lit("not JSON"))
        .when(on_lineage & ~J.is_object(kind), F.lit("lineage message is no object"))
        .when(on_lineage & ~event.eqNullSafe(F.lit("COMPLETE")), F.lit(None).cast("string"))
        .when(
            on_lineage & (F.size("inputs") == 0) & (F.size("outputs") == 0),
            F.lit("lineage names no dataset"),
        )
        .when(on_lineage, F.lit(None).cast("string"))
        .when(~J.is_object(kind), F.lit("schema message is no object"))
        .when(no_schema, F.lit("schema message lists no columns"))
    )
    parsed = messages.withColumn("document", J.parse_json(F.col(value))).select(
        "*",
        dataset_names(J.member(document, "inputs")).alias("inputs"),
        dataset_names(J.member(document, "outputs")).alias("outputs"),
        F.coalesce(J.as_string(J.member(document, "dataset_name")), F.lit("unknown_dataset")).alias("dataset_name"),
        J.members(J.member(document, "schema")).cast("map<string,string>").alias("schema"),
    )
    return parsed.withColumn("reason", reason).withColumn(
        "branch",
        F.when(F.col("reason").isNotNull(), "dead_letter")
        .when(on_lineage & ~event.eqNullSafe(F.lit("COMPLETE")), "ignore")
        .when(on_lineage, "lineage")
        .otherwise("schema"),
    )


def dataset_names(listed: Column) -> Column:
    """Sorted distinct names in a list of datasets; anything malformed is passed over."""
    items = listed.try_cast("array<variant>")
    names = F.transform(
        F.filter(items, lambda d: J.json_type(J.member(d, "name")) == "STRING"),
        lambda d: F.trim(J.as_string(J.member(d, "name"))),
    )
    clean = F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))
    return F.coalesce(clean, F.array().cast("array<string>"))


def incidence(events: DataFrame) -> DataFrame:
    """(event_id, side, dataset_name): an event as a node between its inputs and its outputs.

    Both sides are exploded apart, so an event of n inputs and m outputs has n + m rows, not
    n * m. Events that name the same datasets are one: the id is a hash of the names.
    """
    own = F.sha2(F.to_json(F.struct("inputs", "outputs")), 256).alias("event_id")
    one = events.select(own, "inputs", "outputs").dropDuplicates(["event_id"])
    sides = [one.select("event_id", F.lit(side).alias("side"), F.explode(f"{side}puts").alias("dataset_name")) for side in ("in", "out")]
    return sides[0].unionByName(sides[1])


def neighbours(named: DataFrame) -> DataFrame:
    """Distinct (dataset_name, up, down) of ``incidence`` rows: one of ``up`` and ``down`` is NULL.

    Events meet their datasets in a join, and pairs are made distinct before they are shuffled.
    """
    inputs = named.where("side = 'in'").select("event_id", F.col("dataset_name").alias("source"))
    outputs = named.where("side = 'out'").select("event_id", F.col("dataset_name").alias("target"))
    pairs = inputs.join(outputs, "event_id").select("source", "target").distinct()
    nothing = F.lit(None).cast("string")
    ways = F.array(
        F.struct(F.col("target").alias("dataset_name"), F.col("source").alias("up"), nothing.alias("down")),
        F.struct(F.col("source").alias("dataset_name"), nothing.alias("up"), F.col("target").alias("down")),
    )
    return pairs.select(F.inline(ways))


def lineage_sets(near: DataFrame, share: int = 64) -> DataFrame:
    """Per dataset, its sorted distinct upstream and downstream names, from distinct ``neighbours``.

    Lists are put together in ``share`` parts of each dataset first, so one with very many
    neighbours is spread over tasks; only its finished list is one row.
    """
    part = F.pmod(F.xxhash64("up", "down"), F.lit(share))
    some = near.groupBy("dataset_name", part.alias("part")).agg(
        F.collect_list("up").alias("up"), F.collect_list("down").alias("down")
    )
    return some.groupBy("dataset_name").agg(
        F.array_sort(F.flatten(F.collect_list("up"))).alias("lineage_upstream"),
        F.array_sort(F.flatten(F.collect_list("down"))).alias("lineage_downstream"),
    )


def with_lineage(entries: DataFrame, near: DataFrame) -> DataFrame:
    """Attach lineage to known entries; datasets without an entry are left out."""
    nothing = F.array().cast("array<string>")
    joined = entries.join(lineage_sets(near), "dataset_name", "left")
    return joined.withColumn("lineage_upstream", F.coalesce("lineage_upstream", nothing)).withColumn(
        "lineage_downstream", F.coalesce("lineage_downstream", nothing)
    )


def parse_answer(text: Column) -> tuple[Column, Column]:
    """Description (first line) and tags (last line) of a written answer."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: s != "")
    description = F.when(text.isNotNull(), F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")))
    last = F.when(F.size(lines) > 1, F.try_element_at(lines, F.lit(-1))).otherwise(F.lit(""))
    labelled = F.lower(last).startswith("tags:")
    listed = F.when(labelled, F.regexp_replace(last, r"^[^:]*:", "")).otherwise(last)
    tags = F.filter(F.transform(F.split(listed, ","), lambda t: F.trim(t)), lambda t: t != "")
    return description, F.coalesce(tags, F.array().cast("array<string>"))


ENTRY_KEY = ["dataset_name", "schema_fingerprint"]


def latest_entries(new: DataFrame, order: str) -> DataFrame:
    """One row per dataset and fingerprint: a later description wins, a missing one does not erase it."""
    described = F.when(F.col("description").isNotNull(), F.struct(order, "description", "tags"))
    return new.groupBy(*ENTRY_KEY).agg(
        F.max(described).alias("_d"),
        F.max_by("schema_json", order).alias("schema_json"),
        F.max(order).alias("updated_at"),
    ).select(
        *ENTRY_KEY,
        "schema_json",
        F.col("_d.description").alias("description"),
        F.coalesce("_d.tags", F.array().cast("array<string>")).alias("tags"),
        "updated_at",
    )


def upsert(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The catalog after ``new`` (one row per key) is merged into ``stored``.

    A missing new description keeps the stored one, unless that one is only a
    placeholder, which is blanked.
    """
    n, s = new.alias("n"), stored.alias("s")
    joined = n.join(s, ENTRY_KEY, "full_outer")
    arrived = F.col("n.updated_at").isNotNull()
    pending = F.col("s.description").startswith(PENDING_PREFIX)
    nothing = F.array().cast("array<string>")
    described = F.col("n.description").isNotNull()
    return joined.select(
        *ENTRY_KEY,
        F.when(arrived, F.col("n.schema_json")).otherwise(F.col("s.schema_json")).alias("schema_json"),
        F.when(described, F.col("n.description"))
        .when(arrived & pending, F.lit(None))
        .otherwise(F.col("s.description"))
        .alias("description"),
        F.when(described, F.col("n.tags"))
        .when(arrived & pending, nothing)
        .otherwise(F.coalesce(F.col("s.tags"), F.col("n.tags")))
        .alias("tags"),
        F.when(arrived, F.col("n.updated_at")).otherwise(F.col("s.updated_at")).alias("updated_at"),
    )
