"""State machines: the rules step by step, and the split replay against a plain loop."""

import datetime as dt
import random
import re
from typing import Any, NamedTuple

import pytest
from pyspark.sql import functions as F

from streamwarden.functions.backoff import Backoff
from streamwarden.operators import breaker as B, gate as G, guard as U
from streamwarden.operators.replay import replay

PLAIN = B.BreakerSettings(3, Backoff(300.0, jitter=False))


def walk(state, *moves):
    seen = []
    for at, move in moves:
        if move == "incident":
            state, action, _ = B.on_incident(state, "m", at, PLAIN)
            seen.append((state.state, action))
        else:
            state = B.on_outcome(state, "m", at, move, PLAIN)
            seen.append((state.state, None))
    return state, seen


def test_third_incident_trips_and_is_blocked():
    state, seen = walk(B.BreakerState(), (0, "incident"), (1, "incident"), (2, "incident"), (3, "incident"))
    assert seen == [("CLOSED", B.FORWARD), ("CLOSED", B.FORWARD), ("OPEN", B.BLOCK), ("OPEN", B.BLOCK)]
    assert (state.consecutive_failures, state.trip_count, state.cooldown_seconds) == (3, 1, 300.0)


def test_one_trial_then_outcome_decides():
    opened = ((0, "incident"), (1, "incident"), (2, "incident"), (302, "incident"), (303, "incident"))
    _, seen = walk(B.BreakerState(), *opened)
    assert seen[-2:] == [("HALF_OPEN", B.FORWARD), ("HALF_OPEN", B.BLOCK)]
    closed, _ = walk(B.BreakerState(), *opened, (304, True))
    assert closed == B.BreakerState(known=True)
    again, _ = walk(B.BreakerState(), *opened, (304, False))
    assert (again.state, again.trip_count, again.cooldown_seconds) == ("OPEN", 2, 600.0)


def test_outcome_outside_trial_changes_nothing():
    state, _ = walk(B.BreakerState(), (0, "incident"))
    assert B.on_outcome(state, "m", 1, True, PLAIN) == state


def test_backoff_bounds_and_repeatability():
    wait = Backoff(300.0, 2.0, 3600.0, extra_seconds=30.0)
    for trip in range(1, 12):
        ceiling = min(300.0 * 2 ** (trip - 1), 3600.0)
        for at in range(20):
            s = wait.seconds("m", float(at), trip)
            assert ceiling / 2 <= s <= ceiling + 30.0
            assert s == wait.seconds("m", float(at), trip)
    assert wait.ceiling(wait.trips_to_cap) == wait.ceiling(99) == 3600.0


def plain_gate(rows, settings=G.GateSettings()):
    """A loop over (key, at, tie, kind, drifted, forced) with two remembered values per key."""
    seen, out = {}, {}
    for key, at, tie, kind, drifted, forced in sorted(rows):
        last, before = seen.get(key, (None, False))
        publish, reason = False, "clean"
        if kind == G.PUBLISH_FAILED:
            last, drifted, reason = None, before, "failed announcement forgotten"
        elif drifted and forced:
            publish, reason = True, "forced"
        elif drifted:
            waited = float("inf") if last is None else at - last
            if waited < settings.min_interval_seconds:
                reason = "too soon"
            elif not before:
                publish, reason = True, "new episode"
            elif waited >= settings.renotify_seconds:
                publish, reason = True, "episode goes on: heartbeat"
            else:
                reason = "same episode"
        seen[key] = (at if publish else last, drifted)
        out[tie] = (publish, reason)
    return out


GATE_ROW = "key string, at double, tie long, kind string, drifted boolean, forced boolean"


def gate_of(spark, rows, partitions):
    got = G.replay_gate(spark.createDataFrame(rows, GATE_ROW), partitions=partitions).collect()
    return {r.tie: (r.publish, r.publish_reason.split(": ")[0] if "since" in r.publish_reason else r.publish_reason) for r in got}


def test_publish_gate_timeline(spark):
    moves = (
        (0, True, False), (60, True, False), (600, True, False), (1800, True, False), (1850, False, False),
        (1900, True, False), (2000, True, False), (3700, False, True), (3701, True, True),
    )
    rows = [("m", float(at), i, "check", drifted, forced) for i, (at, drifted, forced) in enumerate(moves)]
    got = gate_of(spark, rows, 3)
    assert [got[i] for i in range(len(rows))] == [
        (True, "new episode"), (False, "too soon"), (False, "same episode"), (True, "episode goes on: heartbeat"),
        (False, "clean"), (False, "too soon"), (False, "same episode"), (False, "clean"), (True, "forced"),
    ]


def test_guard_trips_again_at_once_after_cooldown():
    settings, state = U.GuardSettings(3, Backoff(120.0, jitter=False)), U.GuardState()
    for at in (0, 1, 2):
        state, paused = U.attempt(state, "c", float(at), False, settings)
    assert not paused and (state.failures, state.trip_count, state.paused_until) == (3, 1, 122.0)
    assert U.attempt(state, "c", 100.0, True, settings) == (state, True)
    later, paused = U.attempt(state, "c", 130.0, False, settings)
    assert not paused and (later.failures, later.trip_count, later.paused_until) == (4, 2, 370.0)
    healed, _ = U.attempt(state, "c", 130.0, True, settings)
    assert healed == U.GuardState(0, 1, None)


def plain_replay(rows, machine):
    row = NamedTuple("row", [(n, Any) for n in machine.inputs])
    states, out = {}, {}
    for r in sorted(rows):
        event = row(*r)
        state = states.get(event.key)
        state = machine.initial(event.key) if state is None else state
        states[event.key], out[event.tie] = machine.step(state, event)
    return out


def histories(seed, kinds, n=3000, hot=0.4, gap=40):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for i in range(n):
        at += rng.random() * gap
        key = "hot" if rng.random() < hot else f"k{rng.randrange(8)}"
        kind = rng.choice(kinds)
        rows.append((key, at, i, kind, rng.random() < 0.5))
    return rows


@pytest.mark.parametrize("kinds", [("incident", "outcome"), ("incident",), ("incident",) * 30 + ("outcome",)])
def test_split_breaker_replay_equals_plain_loop(spark, kinds):
    machine = B.breaker_machine(B.BreakerSettings(3, Backoff(60.0, cap_seconds=480.0, extra_seconds=5.0)))
    rows = histories(len(kinds), kinds)
    df = spark.createDataFrame(rows, "key string, at double, tie long, kind string, success boolean")
    got = {r.tie: tuple(r)[5:] for r in replay(df, machine, 12).collect()}
    assert got == plain_replay(rows, machine)


@pytest.mark.parametrize("failing", [False, True])
def test_split_guard_replay_equals_plain_loop(spark, failing):
    machine = U.guard_machine(U.GuardSettings(3, Backoff(50.0, cap_seconds=900.0)))
    rows = [(k, at, i, kind, ok and not failing) for k, at, i, kind, ok in histories(5, ("attempt",), hot=1.0)]
    df = spark.createDataFrame(rows, "key string, at double, tie long, kind string, success boolean")
    got = {r.tie: tuple(r)[5:] for r in replay(df, machine, 10).collect()}
    assert got == plain_replay(rows, machine)


@pytest.mark.parametrize("partitions", [1, 4, 9, 40])
@pytest.mark.parametrize("kinds", [("check", "check", "publish_failed"), ("check",)])
def test_split_gate_equals_plain_loop(spark, kinds, partitions):
    rows = [(*r, i % 97 == 0) for i, r in enumerate(histories(9, kinds, n=1500, gap=300))]
    assert gate_of(spark, rows, partitions) == plain_gate(rows)


@pytest.mark.parametrize("always", [False, True])
def test_one_hot_drifted_key(spark, always):
    rows = [("hot", 7.0 * i, i, "check", always or i % 50 != 0, False) for i in range(2000)]
    assert gate_of(spark, rows, 32) == plain_gate(rows)


def test_jobs_do_not_grow_with_partitions(spark):
    rows = [("hot", 7.0 * i, i, "check", True, False) for i in range(500)]
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for partitions in (8, 32, 64):
        spark.sparkContext.setJobGroup(f"gate{partitions}", "gate")
        gate_of(spark, rows, partitions)
        counts.append(len(tracker.getJobIdsForGroup(f"gate{partitions}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(set(counts)) == 1


def test_split_throttle_equals_plain_loop(spark):
    blocks = [(k, at, i, ok) for k, at, i, _, ok in histories(9, ("x",), gap=300)]
    blocks = [(k, at, i, ok and i % 40 == 0) for k, at, i, ok in blocks]
    last, wanted = {}, {}
    for key, at, tie, transition in sorted(blocks):
        wanted[tie] = transition or key not in last or at - last[key] >= 900.0
        if wanted[tie]:
            last[key] = at
    df = spark.createDataFrame(blocks, "key string, at double, tie long, transition boolean")
    assert {r.tie: r.notify for r in B.throttled(df, 900.0, 9).collect()} == wanted




def test_equal_arrivals_and_empty_ids_in_admission(spark):
    rows = [("m", "r1", 5.0, 1), ("m", "r1", 5.0, 1), ("m", "r1", 5.0, 1), ("m", "r1", 9.0, 2), ("m", "", 5.0, 1), ("m", "", 5.0, 1), ("m", None, 5.0, 1), ("m", "r2", 5.0, 1)]
    df = spark.createDataFrame(rows, "monitor_name string, report_id string, at double, tie long")
    df = df.selectExpr("*", "timestamp_seconds(at) AS detected_at")
    got = B.admit(df, F.timestamp_seconds(F.lit(10)), 900.0).groupBy("report_id", "admission").count().collect()
    assert {(r.report_id, r.admission): r["count"] for r in got} == {
        ("r1", "ok"): 1, ("r1", "duplicate"): 3, ("", "ok"): 2, (None, "ok"): 1, ("r2", "ok"): 1,
    }


def test_equal_copies_are_ranked_in_parts(spark):
    text = "report_id string, at double, tie long, monitor_name string, detected_at timestamp, n long"
    at = dt.datetime(1970, 1, 1)
    rows = [("hot", 1.0, 1, "m", at, i) for i in range(400)] + [("b", 1.0, 1, "m", at, 500), ("b", 2.0, 1, "m", at, 501)]
    got = B.admit(spark.createDataFrame(rows, text).repartition(8, "n"), F.timestamp_seconds(F.lit(10)), 900.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(report_id#\d+, _read_in#\d+", plan)
    found = got.collect()
    assert sorted(r.n for r in found) == sorted(r[-1] for r in rows)
    assert [r.report_id for r in found if r.admission == "ok"].count("hot") == 1
    assert [(r.n, r.admission) for r in found if r.n >= 500] in ([(500, "ok"), (501, "duplicate")], [(501, "duplicate"), (500, "ok")])
