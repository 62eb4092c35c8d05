"""Data contracts: what a topic's records must look like."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Iterable

from pyspark.sql import DataFrame, SparkSession

RAW_TOPIC = "raw-data"
VALID_TOPIC = "validated-data"
HEALER_TOPIC = "schema-evolution-requests"
DEAD_LETTER_TOPIC = "dead-letter-queue"
SCHEMA_TOPIC = "schema-events"


@dataclass(frozen=True)
class ContractField:
    name: str
    type: str = "string"
    required: bool = False
    allowed_values: tuple = ()
    pii: bool = False
    masking_strategy: str = "hash"
    declares_required: bool = True


@dataclass(frozen=True)
class QualityRule:
    kind: str
    fields: tuple[str, ...]
    minimum: float | None = None
    maximum: float | None = None
    max_delay_minutes: float = 15


@dataclass(frozen=True)
class Contract:
    name: str
    version: Any
    fields: tuple[ContractField, ...]
    rules: tuple[QualityRule, ...] = ()
    source_topic: str | None = RAW_TOPIC
    sink_topic: str = VALID_TOPIC
    dead_letter_topic: str = DEAD_LETTER_TOPIC
    to_healer: bool = True
    flat: bool = True

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def violation_topic(self) -> str:
        return HEALER_TOPIC if self.to_healer else self.dead_letter_topic

    def required_for_repair(self) -> list[str]:
        """Repair treats a field that does not say as required; validation does not."""
        return [f.name for f in self.fields if f.required or not f.declares_required]

    @property
    def shape(self) -> dict[str, str]:
        return {f.name: f.type for f in self.fields}

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.shape)


def fingerprint(shape: dict[str, Any]) -> str:
    text = json.dumps(shape, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _field(spec: dict) -> ContractField:
    return ContractField(
        name=spec["name"],
        type=spec.get("type", "string"),
        required=bool(spec.get("required", False)),
        allowed_values=tuple(spec.get("allowed_values") or ()),
        pii=bool(spec.get("pii", False)),
        masking_strategy=spec.get("masking_strategy", "hash"),
        declares_required="required" in spec,
    )


def _rule(spec: dict) -> QualityRule:
    names = spec.get("fields") or ([spec["field"]] if "field" in spec else [])
    return QualityRule(
        kind=spec["rule"],
        fields=tuple(names),
        minimum=spec.get("min"),
        maximum=spec.get("max"),
        max_delay_minutes=spec.get("max_delay_minutes", 15),
    )


def from_document(doc: dict) -> Contract:
    """Read either layout: everything at top level, or nested under ``contract``."""
    flat = "contract" not in doc
    if flat:
        head = {"name": doc["contract_name"], "version": doc.get("version", 1)}
        topics = {
            "source_topic": doc.get("source_topic", RAW_TOPIC),
            "sink_topic": doc.get("sink_topic", VALID_TOPIC),
        }
        fields = doc.get("fields", [])
        reaction = doc.get("on_violation", {"action": "route_to_healer"})
    else:
        head = doc["contract"]
        topics = head.get("kafka", {})
        fields = doc.get("schema", {}).get("fields", [])
        reaction = doc.get("on_violation", {})
    return Contract(
        name=head["name"],
        version=head.get("version", 1),
        fields=tuple(_field(f) for f in fields),
        rules=tuple(_rule(r) for r in doc.get("quality_rules", [])),
        source_topic=topics.get("source_topic"),
        sink_topic=topics.get("sink_topic", VALID_TOPIC),
        dead_letter_topic=topics.get("dlq_topic", DEAD_LETTER_TOPIC),
        to_healer=reaction.get("action", "dead_letter_queue") == "route_to_healer",
        flat=flat,
    )


def read_contract(path: str | Path) -> Contract | None:
    try:
        import yaml
    except ImportError as missing:  # contracts can also be given as dictionaries
        raise RuntimeError("reading YAML contracts needs PyYAML; use from_document") from missing
    doc = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return from_document(doc) if doc and ("contract" in doc or "contract_name" in doc) else None


def _contracts_in(folder: str | Path) -> list[Contract]:
    found = (read_contract(p) for p in sorted(Path(folder).rglob("*.yaml")))
    return [c for c in found if c is not None]


def by_topic(folder: str | Path) -> dict[str, Contract]:
    """Validation looks contracts up by source topic; the last file wins."""
    return {c.source_topic: c for c in _contracts_in(folder) if c.source_topic}


def by_name(folder: str | Path) -> dict[str, Contract]:
    """Repair looks contracts up by name and knows the flat layout only."""
    return {c.name: c for c in _contracts_in(folder) if c.flat}


def orders_contract() -> Contract:
    return read_contract(Path(__file__).parent / "examples" / "orders_v1.yaml")


def contract_listing(spark: SparkSession, contracts: Iterable[Contract]) -> DataFrame:
    rows = [(c.name, str(c.version), c.source_topic, c.sink_topic, c.fingerprint) for c in contracts]
    return spark.createDataFrame(
        rows, "name string, version string, source_topic string, sink_topic string, schema_fingerprint string"
    )


def schema_events(spark: SparkSession, contracts: Iterable[Contract]) -> DataFrame:
    rows = [(c.name, c.fingerprint, c.shape) for c in contracts]
    return spark.createDataFrame(
        rows, "dataset_name string, schema_fingerprint string, schema map<string,string>"
    )


def changed_schema_events(events: DataFrame, published: DataFrame) -> DataFrame:
    """Keep only schemas whose fingerprint differs from the one last published."""
    return events.join(
        published.select("dataset_name", "schema_fingerprint"),
        ["dataset_name", "schema_fingerprint"],
        "left_anti",
    )
