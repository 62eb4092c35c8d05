"""Circuit breaker over incidents, one state per monitor."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple, Optional

from pyspark.sql import Column, DataFrame, Window, functions as F

from streamwarden.functions.backoff import Backoff
from streamwarden.functions.times import seconds_between
from streamwarden.operators import intervals as I
from streamwarden.operators.replay import Machine, Span, replay
from streamwarden.session import cut

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"
FORWARD, BLOCK = "forward_to_remediation", "block_to_dlq"
INCIDENT, OUTCOME = "incident", "outcome"
REQUESTS_TOPIC, BLOCKED_TOPIC = "remediation-requests", "remediation-dlq"
MAX_AGE_SECONDS = 900.0
BLOCK_NOTICE_SECONDS = 60.0


class BreakerState(NamedTuple):
    state: str = CLOSED
    consecutive_failures: int = 0
    trip_count: int = 0
    opened_at: Optional[float] = None
    cooldown_seconds: float = 0.0
    trial_in_flight: bool = False
    known: bool = False


@dataclass(frozen=True)
class BreakerSettings:
    failure_threshold: int = 3
    cooldown: Backoff = Backoff(base_seconds=300.0, cap_seconds=3600.0, extra_seconds=30.0)


def _open(state: BreakerState, key, at: float, settings: BreakerSettings, **changes) -> BreakerState:
    trips = state.trip_count + 1
    return state._replace(
        state=OPEN,
        trip_count=trips,
        opened_at=at,
        cooldown_seconds=settings.cooldown.seconds(str(key), at, trips),
        trial_in_flight=False,
        **changes,
    )


def on_incident(state: BreakerState, key, at: float, settings: BreakerSettings):
    """New state, action and reason for an incident."""
    limit = settings.failure_threshold
    state = state._replace(known=True)
    if state.state == CLOSED:
        count = state.consecutive_failures + 1
        if count < limit:
            reason = f"CLOSED, {count}/{limit} consecutive incidents"
            return state._replace(consecutive_failures=count), FORWARD, reason
        tripped = _open(state, key, at, settings, consecutive_failures=count)
        reason = f"{count} consecutive incidents >= threshold {limit}, OPEN for ~{tripped.cooldown_seconds:.0f}s"
        return tripped, BLOCK, reason
    if state.state == OPEN:
        waited = at - state.opened_at if state.opened_at is not None else float("inf")
        times = f"({waited:.0f}s / {state.cooldown_seconds:.0f}s)"
        if waited < state.cooldown_seconds:
            return state, BLOCK, f"OPEN, cooldown not yet elapsed {times}"
        return state._replace(state=HALF_OPEN, trial_in_flight=True), FORWARD, f"cooldown elapsed {times}, one trial"
    if state.trial_in_flight:
        return state, BLOCK, "HALF_OPEN trial already in flight"
    return state._replace(trial_in_flight=True), FORWARD, "HALF_OPEN without a recorded trial, one trial"


def on_outcome(state: BreakerState, key, at: float, success: bool, settings: BreakerSettings) -> BreakerState:
    if state.state != HALF_OPEN:
        return state
    if success:
        return BreakerState(known=True)
    return _open(state, key, at, settings)


def breaker_machine(settings: BreakerSettings = BreakerSettings()) -> Machine:
    def step(state: BreakerState, event):
        if event.kind == OUTCOME:
            if not state.known:
                return state, ("rejected", state.state, state.state, None, "no state for this monitor", *_view(state))
            after = on_outcome(state, event.key, event.at, bool(event.success), settings)
            entry = "outcome_ignored"
            if after.state != state.state:
                entry = "outcome_success" if event.success else "outcome_failure"
            return after, (entry, state.state, after.state, None, f"success={bool(event.success)}", *_view(after))
        after, action, reason = on_incident(state, event.key, event.at, settings)
        entry = "incident_forwarded" if action == FORWARD else "incident_blocked"
        return after, (entry, state.state, after.state, action, reason, *_view(after))

    def sleeps(state: BreakerState, span: Span) -> bool:
        if state.state == CLOSED:
            return state.known and not span.has(INCIDENT)
        if state.state == OPEN:
            return span.last_at.get(INCIDENT, float("-inf")) < state.opened_at + state.cooldown_seconds
        return state.trial_in_flight and not span.has(OUTCOME)

    return Machine(
        initial=lambda key: BreakerState(),
        step=step,
        inputs=("key", "at", "tie", "kind", "success"),
        outputs=(
            "entry string, from_state string, to_state string, action string, reason string, "
            "consecutive_failures int, trip_count int, opened_at double, cooldown_seconds double, "
            "trial_in_flight boolean"
        ),
        counters={"trip_count": settings.cooldown.trips_to_cap},
        sleeps=sleeps,
    )


def _view(state: BreakerState) -> tuple:
    return state[1:6]


def replay_breaker(events: DataFrame, settings: BreakerSettings = BreakerSettings(), partitions: int | None = None):
    """Decisions for incidents and outcomes given as (key, at, tie, kind, success)."""
    return replay(events, breaker_machine(settings), partitions)


def throttled(blocked: DataFrame, interval_seconds: float = BLOCK_NOTICE_SECONDS, partitions: int | None = None):
    """Blocked incidents with ``notify``: the transition, then at most one per interval."""
    asked = blocked.withColumns(
        {
            "effect": F.when(F.col("transition"), I.SET).otherwise(I.WAIT),
            "wait": F.lit(float(interval_seconds)),
            "wait_again": F.lit(float(interval_seconds)),
            "flag": F.lit(None).cast("boolean"),
        }
    )
    return I.replay_intervals(asked, partitions).select(*blocked.columns, F.col("fires").alias("notify"))


def notify_blocks(decisions: DataFrame, interval_seconds: float = BLOCK_NOTICE_SECONDS, partitions: int | None = None):
    """Add ``notify``: everything but a repeated block within the interval."""
    decisions = cut(decisions)  # read twice below
    moved = F.coalesce(F.col("from_state") != F.col("to_state"), F.lit(False))
    blocked = decisions.where(F.col("action") == BLOCK).withColumn("transition", moved)
    judged = throttled(blocked, interval_seconds, partitions).drop("transition")
    others = decisions.where(~F.col("action").eqNullSafe(F.lit(BLOCK))).withColumn("notify", F.lit(True))
    return judged.unionByName(others)


def current_state(decisions: DataFrame) -> DataFrame:
    """The state each monitor was left in (the latest decision that touched it)."""
    last = F.max_by(F.struct(*[F.col(c) for c in decisions.columns]), F.struct("at", "tie"))
    kept = decisions.where(F.col("entry") != "rejected").groupBy("key").agg(last.alias("d"))
    return kept.select(
        F.col("key").alias("monitor_name"),
        F.col("d.to_state").alias("state"),
        *[F.col(f"d.{c}").alias(c) for c in ("consecutive_failures", "trip_count", "opened_at", "cooldown_seconds")],
        F.col("d.trial_in_flight").alias("half_open_trial_in_flight"),
    )


def state_view(monitors: DataFrame, states: DataFrame, as_of: Column) -> DataFrame:
    """State of each asked monitor; one never seen is CLOSED."""
    joined = monitors.select("monitor_name").distinct().join(states, "monitor_name", "left")
    waited = as_of.cast("double") - F.col("opened_at")
    elapsed = (F.col("state") == OPEN) & (waited >= F.col("cooldown_seconds"))
    return joined.select(
        "monitor_name",
        F.coalesce("state", F.lit(CLOSED)).alias("state"),
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"),
        F.coalesce("trip_count", F.lit(0)).alias("trip_count"),
        F.coalesce("cooldown_seconds", F.lit(0.0)).alias("cooldown_seconds"),
        F.coalesce(elapsed, F.lit(False)).alias("cooldown_elapsed"),
    )


def admit(
    incidents: DataFrame, as_of: Column, max_age_seconds: float = MAX_AGE_SECONDS, arrival: tuple = ("at", "tie")
) -> DataFrame:
    """Label each incident ``ok``, ``stale``, ``duplicate`` or ``no_monitor`` in ``admission``.

    Staleness is judged first and a stale report is not remembered. Reports
    without id or time bypass the respective test. First arrivals are found by
    an aggregate and joined back, so a report id repeated any number of times
    is combined before the shuffle.
    """
    named = F.coalesce(F.length("monitor_name"), F.lit(0)) > 0
    old = F.lit(max_age_seconds > 0) & F.coalesce(
        seconds_between(F.col("detected_at"), as_of) > max_age_seconds, F.lit(False)
    )
    judged = incidents.withColumn(
        "admission", F.when(~named, "no_monitor").when(old, "stale").otherwise("ok")
    )
    has_id = (F.col("admission") == "ok") & (F.coalesce(F.length("report_id"), F.lit(0)) > 0)
    order = F.struct(*[F.col(c) for c in arrival])
    # where a row was read; taken before the join, which may put equal ids together
    candidates = judged.where(has_id).withColumn("_read_in", F.spark_partition_id())
    arrivals = candidates.groupBy("report_id", order.alias("_at")).agg(F.count(F.lit(1)).alias("_same"))
    first = arrivals.groupBy("report_id").agg(
        F.min("_at").alias("_first"), F.sum("_same").alias("_n"), F.min_by("_same", "_at").alias("_equal")
    )
    repeated = first.where("_n > 1").select(F.col("report_id").alias("_id"), "_first", "_equal")
    joined = candidates.join(repeated, F.col("report_id") == F.col("_id"), "left")
    later = F.col("_first").isNotNull() & (order != F.col("_first"))
    tested = joined.withColumn("admission", F.when(later, "duplicate").otherwise(F.col("admission")))
    # copies that arrived as one and the same: any of them is the first
    level = (F.col("admission") == "ok") & (F.coalesce("_equal", F.lit(1)) > 1)
    # first within the part a row was read in, then among those firsts: one row a part
    own = Window.partitionBy("report_id", "_read_in").orderBy(*arrival)
    # dealt anew: the join's own dealing by report_id would do for the window, in one task
    dealt = tested.where(level).repartition("report_id", "_read_in")
    placed = dealt.withColumn("_rest", F.row_number().over(own) > 1)
    firsts = Window.partitionBy("report_id", "_rest", F.when(F.col("_rest"), F.col("_read_in"))).orderBy(*arrival)
    stays = ~F.col("_rest") & (F.row_number().over(firsts) == 1)
    ranked = placed.withColumn("admission", F.when(stays, "ok").otherwise("duplicate"))
    tested = tested.where(~level).select(*judged.columns).unionByName(ranked.select(*judged.columns))
    # rows without a usable id stay out of the join: NULL keys would all meet in one task
    return tested.select(*judged.columns).unionByName(judged.where(~has_id))


def admission_counts(admitted: DataFrame) -> DataFrame:
    return admitted.groupBy("admission").agg(F.count(F.lit(1)).alias("incidents"))


def announce(decisions: DataFrame, dry_run: bool = False) -> DataFrame:
    """Messages for remediation: forwarded incidents and blocked ones worth a notice.

    ``dry_run`` announces nothing; the decisions themselves are kept either way.
    """
    shown = decisions.where(F.col("action").isNotNull() & F.col("notify") & F.lit(not dry_run))
    forwarded = F.col("action") == FORWARD
    at = F.timestamp_micros((F.col("at") * 1e6).cast("long"))
    common = [F.col("key").alias("monitor_name"), F.col("tie").alias("report_id")]
    return shown.select(
        F.when(forwarded, REQUESTS_TOPIC).otherwise(BLOCKED_TOPIC).alias("topic"),
        F.when(
            forwarded,
            F.to_json(F.struct(*common, F.col("to_state").alias("breaker_state"), at.alias("forwarded_at"))),
        )
        .otherwise(F.to_json(F.struct(*common, "reason", at.alias("blocked_at"))))
        .alias("value"),
        "key",
        "at",
        "tie",
    )
