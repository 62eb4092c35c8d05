"""Masking of fields a contract marks as personal."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from streamwarden.contracts import Contract, ContractField
from streamwarden.functions import json_values as J
from streamwarden.functions.binding import let

REDACTED = "***"
HASH_CHARS = 16


def hashed(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, HASH_CHARS)


def without(record: Column, *names: str) -> Column:
    return F.map_filter(record, lambda key, _: ~key.isin(*names))


def masked_members(record: Column, contract: Contract) -> Column:
    """Replace personal members of a MAP<STRING, VARIANT>; absent and null ones stay."""
    for spec in contract.fields:
        if spec.pii and spec.masking_strategy in ("hash", "redact"):
            record = let(record, _masker(spec))
    return record


def _masker(spec: ContractField):
    def replace(record: Column) -> Column:
        value = F.try_element_at(record, F.lit(spec.name))
        cover = F.lit(REDACTED)
        if spec.masking_strategy == "hash":
            cover = hashed(J.display_text(value, J.json_type(value)))
        new = F.create_map(F.lit(spec.name), cover.cast("variant"))
        return F.when(J.is_nothing(value), record).otherwise(F.map_concat(without(record, spec.name), new))

    return replace


def masked_json(document: Column, contract: Contract) -> Column:
    """JSON text of the document with personal fields masked."""
    if not any(spec.pii for spec in contract.fields):
        return F.to_json(document)
    return F.to_json(masked_members(J.members(document), contract))
