"""Pausing of repair per contract after repeated failures."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Mapping, NamedTuple, Optional

from pyspark.sql import Column, DataFrame, functions as F

from streamwarden.functions.backoff import Backoff
from streamwarden.operators.replay import Machine, Span, replay


class GuardState(NamedTuple):
    failures: int = 0
    trip_count: int = 0
    paused_until: Optional[float] = None


@dataclass(frozen=True)
class GuardSettings:
    failure_threshold: int = 3
    cooldown: Backoff = Backoff(base_seconds=120.0, cap_seconds=3600.0)


def attempt(state: GuardState, key, at: float, success: bool, settings: GuardSettings):
    """New state and whether the repair was paused. A success forgives failures, never trips."""
    if state.paused_until is not None and at < state.paused_until:
        return state, True
    if success:
        return state._replace(failures=0, paused_until=None), False
    failures = state.failures + 1
    if failures < settings.failure_threshold:
        return state._replace(failures=failures), False
    trips = state.trip_count + 1
    until = at + settings.cooldown.seconds(str(key), at, trips)
    return GuardState(failures, trips, until), False


def guard_machine(settings: GuardSettings = GuardSettings(), held: Mapping[Any, GuardState] | None = None) -> Machine:
    """``held`` has the states contracts were left in; the others start anew."""
    left = dict(held or {})

    def step(state: GuardState, event):
        after, paused = attempt(state, event.key, event.at, bool(event.success), settings)
        reason = "ok"
        if paused:
            rest = state.paused_until - event.at
            reason = f"healer_paused: {state.failures} consecutive failures, {rest:.0f}s remaining in cooldown"
        return after, (paused, reason, *after)

    def sleeps(state: GuardState, span: Span) -> bool:
        return state.paused_until is not None and max(span.last_at.values()) < state.paused_until

    return Machine(
        initial=lambda key: left.get(key, GuardState()),
        step=step,
        inputs=("key", "at", "tie", "kind", "success"),
        outputs="paused boolean, guard_reason string, failures int, trip_count int, paused_until double",
        counters={"failures": settings.failure_threshold, "trip_count": settings.cooldown.trips_to_cap},
        sleeps=sleeps,
    )


def replay_guard(
    attempts: DataFrame,
    settings: GuardSettings = GuardSettings(),
    partitions: int | None = None,
    held: Mapping[Any, GuardState] | None = None,
):
    """Which repair attempts (key, at, tie, kind, success) a paused contract skips.

    Only these narrow columns go through the ordered replay; records are joined
    back by their id afterwards.
    """
    return replay(attempts, guard_machine(settings, held), partitions)


def guard_state(decisions: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("failures", "trip_count", "paused_until"), F.struct("at", "tie"))
    return decisions.groupBy(F.col("key").alias("contract_name")).agg(last.alias("g")).select(
        "contract_name",
        F.col("g.failures").alias("consecutive_failures"),
        F.col("g.trip_count").alias("trip_count"),
        F.col("g.paused_until").alias("paused_until"),
    )


def guard_view(states: DataFrame, as_of: Column, asked: DataFrame | None = None) -> DataFrame:
    """Whether repair may run now, per contract; of the ``asked`` ones, those never attempted may."""
    if asked is not None:
        states = asked.select("contract_name").distinct().join(states, "contract_name", "left").fillna(
            0, ["consecutive_failures", "trip_count"]
        )
    left = F.col("paused_until") - as_of.cast("double")
    allowed = F.coalesce(left <= 0, F.lit(True))
    text = F.format_string(
        "healer_paused: %d consecutive failures, %.0fs remaining in cooldown", F.col("consecutive_failures"), left
    )
    return states.withColumn("allowed_now", allowed).withColumn("reason", F.when(allowed, "ok").otherwise(text))
