"""Contract checks, compiled to one native column expression."""

from __future__ import annotations

from typing import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from streamwarden.contracts import Contract, ContractField, QualityRule
from streamwarden.functions import json_values as J
from streamwarden.functions.binding import computed_once, let
from streamwarden.functions.times import parse_iso, seconds_between

Cell = Callable[[str], tuple[Column, Column]]


def field_checks(spec: ContractField, cell: Cell) -> list[Column]:
    value, kind = cell(spec.name)
    present = ~J.is_void(kind)
    checks = []
    if spec.required:
        checks.append(F.when(~present, F.lit(f"missing_required_field:{spec.name}")))
    test = J.TYPE_TESTS.get(spec.type) if spec.type != "integer" else None
    if test is not None:
        checks.append(F.when(present & ~test(kind), F.lit(f"type_mismatch:{spec.name}:expected_{spec.type}")))
    if spec.allowed_values:
        text = F.concat(F.lit(f"invalid_value:{spec.name}:"), J.display_text(value, kind))
        checks.append(F.when(present & ~J.is_one_of(value, kind, spec.allowed_values), text))
    return checks


def _range(rule: QualityRule, cell: Cell) -> list[Column]:
    name = rule.fields[0]
    number = J.as_number(*cell(name))
    checks = []
    if rule.minimum is not None:
        checks.append(F.when(number < F.lit(float(rule.minimum)), F.lit(f"range_check:{name}:below_min")))
    if rule.maximum is not None:
        checks.append(F.when(number > F.lit(float(rule.maximum)), F.lit(f"range_check:{name}:above_max")))
    return checks


def _freshness(rule: QualityRule, cell: Cell, as_of: Column) -> list[Column]:
    name = rule.fields[0]
    value, kind = cell(name)
    text = J.display_text(value, kind)
    given = ~J.is_void(kind) & (text != "") & ~text.isin("0", "0.0", "False")
    seen = parse_iso(text)
    late = seconds_between(seen, as_of) / 60
    stale = F.concat(F.lit(f"freshness:{name}:delay_"), late.cast("long").cast("string"), F.lit("m"))
    return [
        F.when(given & seen.isNull(), F.lit(f"freshness:{name}:unparseable_timestamp")).when(
            given & (late > F.lit(float(rule.max_delay_minutes))), stale
        )
    ]


def rule_checks(rule: QualityRule, cell: Cell, as_of: Column) -> list[Column]:
    if rule.kind == "not_null":
        return [F.when(J.is_void(cell(n)[1]), F.lit(f"not_null:{n}")) for n in rule.fields]
    if rule.kind == "range_check":
        return _range(rule, cell)
    if rule.kind == "freshness":
        return _freshness(rule, cell, as_of)
    return []


def _checked_names(contract: Contract) -> list[str]:
    names = [f.name for f in contract.fields]
    for rule in contract.rules:
        names.extend(rule.fields)
    return list(dict.fromkeys(names))


def _checks(contract: Contract, cell: Cell, as_of: Column) -> Column:
    """The outcome of every check, NULL where nothing is wrong."""
    checks: list[Column] = []
    for spec in contract.fields:
        checks.extend(field_checks(spec, cell))
    for rule in contract.rules:
        checks.extend(rule_checks(rule, cell, as_of))
    return F.array(*checks).cast("array<string>")


def violations(document: Column, contract: Contract, as_of: Column | None = None) -> Column:
    """What is wrong with a VARIANT document: an empty list when nothing is.

    Unreadable JSON (NULL) and JSON that is not an object are violations too,
    so that no record can stop the job. Fields come in contract order, quality
    rules after them. For whole tables ``with_violations`` is faster.
    """
    as_of = F.current_timestamp() if as_of is None else as_of

    def cells(doc: Column) -> Column:
        members = {name: J.member(doc, name) for name in _checked_names(contract)}
        return F.struct(
            *[F.struct(v.alias("v"), J.json_type(v).alias("t")).alias(name) for name, v in members.items()]
        )

    def found(extracted: Column) -> Column:
        def cell(name: str) -> tuple[Column, Column]:
            held = extracted.getField(name)
            return held.getField("v"), held.getField("t")

        return F.array_compact(_checks(contract, cell, as_of))

    def judge(doc: Column) -> Column:
        return (
            F.when(doc.isNull(), F.array(F.lit("malformed_json")))
            .when(~J.is_object(J.json_type(doc)), F.array(F.lit("not_an_object")))
            .otherwise(let(cells(doc), found))
        )

    return let(document, judge)


def typed_members(
    df: DataFrame, contracts: Mapping[str, Contract], source: Column, member: Callable[[Column, str], Column]
) -> tuple[DataFrame, Cell]:
    """``df`` with every member the contracts check as a value and its JSON type, and how to
    name them. Members of a VARIANT ``source`` (``J.member``) are taken out in one pass, unless names
    differ in their case only."""
    wanted = list(dict.fromkeys(n for c in contracts.values() for n in _checked_names(c)))
    if member is J.member and wanted and len({n.casefold() for n in wanted}) == len(wanted):
        typed = df.select("*", J.some_members(source, wanted).alias("_members"))
        values = [F.col("_members").getField(n) for n in wanted]
    else:
        typed = df.select("*", *[member(source, n).alias(f"_v{k}") for k, n in enumerate(wanted)])
        values = [F.col(f"_v{k}") for k in range(len(wanted))]
    cells = {n: (v, F.col(f"_t{k}")) for k, (n, v) in enumerate(zip(wanted, values))}
    typed = typed.select("*", *[J.json_type(v).alias(f"_t{k}") for k, v in enumerate(values)])
    return typed, cells.__getitem__


def by_contract(
    contracts: Contract | Mapping[str, Contract],
    chosen_by: str | None,
    build: Callable[[Contract], Column],
    otherwise: Column | None = None,
) -> Column:
    """``build`` of the one contract, or of the contract that column ``chosen_by`` names."""
    if not isinstance(contracts, Mapping):
        return build(contracts)
    found = None
    for choice, contract in contracts.items():
        here = F.lit(True) if chosen_by is None else F.col(chosen_by) == choice
        found = F.when(here, build(contract)) if found is None else found.when(here, build(contract))
    if found is None:
        return F.lit(None) if otherwise is None else otherwise
    return found if otherwise is None else found.otherwise(otherwise)


def contract_checks(contracts: Mapping[str, Contract], chosen_by: str | None, cell: Cell, as_of: Column) -> Column:
    """Outcomes of the checks of a record's own contract, NULL where none is known; those that
    are not NULL are its violations."""
    return by_contract(contracts, chosen_by, lambda c: _checks(c, cell, as_of)).cast("array<string>")


def with_violations(
    df: DataFrame, contracts: Contract | Mapping[str, Contract], document: str, as_of: str, chosen_by: str | None = None
) -> DataFrame:
    """``df`` with ``violations``, judged by one contract or by the one that column ``chosen_by`` names.

    Members become typed columns first; the checks are then plain conditions on columns, which
    Spark compiles. With many contracts a record meets its own checks only; one that
    no contract is known for has the violation ``contract_not_found``.
    """
    many = isinstance(contracts, Mapping)
    known = contracts if many else {contracts.name: contracts}
    doc = F.col(document)
    typed, cell = typed_members(df, known, doc, J.member)
    # only an object has members to be taken out
    is_object = F.col("_members").isNotNull() if "_members" in typed.columns else J.is_object(J.json_type(doc))
    found = contract_checks(known, chosen_by if many else None, cell, F.col(as_of))
    if many:
        found = F.coalesce(found, F.array(F.concat(F.lit("contract_not_found:"), F.coalesce(F.col(chosen_by), F.lit("")))))
    judged = (
        F.when(doc.isNull(), F.array(F.lit("malformed_json")))
        .when(~is_object, F.array(F.lit("not_an_object")))
        .otherwise(found)
    )
    outcomes = computed_once(typed, judged.alias("_outcomes"), keep=df.columns, apart=True)
    return outcomes.select(*df.columns, F.array_compact("_outcomes").alias("violations"))
