"""Replay of per-key state machines over a whole table, in event order.

The rows are range-partitioned by (key, time, id), so one very frequent key
spreads over many partitions instead of filling one. What has to travel
between two partitions is only the state the key was left in. The replay
therefore runs in passes over the same checkpointed partitions:

1. every partition runs from the initial state and reports where its last key ended;
2. where a partition continues a key, the state handed over is compared with
   the ones already tried there; only partitions met by a new state run again,
   until nothing changes. Most histories forget their start within a few
   events, so this settles after one or two rounds. A history that never
   forgets is still replayed exactly, one partition after the other;
3. every partition runs with its true starting state and writes its decisions.

The driver sees one small row per partition, never data.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from typing import Any, Callable, Iterator, NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from streamwarden.session import cut

KEY, AT, TIE = "key", "at", "tie"
EVENT_ORDER = [KEY, AT, TIE]


class Span(NamedTuple):
    """What a partition that holds a single key says about its events."""

    last_at: dict[str, float]

    def has(self, kind: str) -> bool:
        return kind in self.last_at


@dataclass(frozen=True)
class Machine:
    """A per-key state machine.

    ``step(state, event)`` returns the new state and the output values; events
    are named tuples of the input columns. ``counters`` names integer state
    fields whose value no longer matters beyond a limit, so that a state is
    recognised although its count went on. ``sleeps`` may say that a span of
    events leaves a state as it is, without running it.
    """

    initial: Callable[[Any], Any]
    step: Callable[[Any, Any], tuple[Any, tuple]]
    inputs: tuple[str, ...]
    outputs: str
    counters: dict[str, int] = field(default_factory=dict)
    sleeps: Callable[[Any, Span], bool] = lambda state, span: False

    def canonical(self, state):
        capped = {f: min(getattr(state, f), limit) for f, limit in self.counters.items()}
        return state._replace(**capped) if capped else state

    def carried(self, start, canonical_start, end, reset: frozenset):
        """Undo the capping: counts that were not reset go on from the true start."""
        missing = {
            f: getattr(end, f) + getattr(start, f) - getattr(canonical_start, f)
            for f in self.counters
            if f not in reset
        }
        return end._replace(**missing) if missing else end


def _rows(batches: Iterator[pd.DataFrame], names: tuple[str, ...]):
    row = NamedTuple("row", [(n, Any) for n in names])
    for batch in batches:
        lists = [batch[n].tolist() for n in names]
        yield batch, [row(*values) for values in zip(*lists)]


def _final_pass(machine: Machine, starts: dict[int, Any]):
    out_names = [f.name for f in T.StructType.fromDDL(machine.outputs).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handed_over = starts.get(TaskContext.get().partitionId())
        current, state = object(), None
        for batch, rows in _rows(batches, machine.inputs):
            produced = []
            for event in rows:
                if event.key != current:
                    current = event.key
                    state = handed_over if handed_over is not None else machine.initial(current)
                    handed_over = None
                state, output = machine.step(state, event)
                produced.append(output)
            made = pd.DataFrame(produced, columns=out_names, index=batch.index, dtype=object)
            yield pd.concat([batch, made], axis=1)

    return run


def _edge_pass(machine: Machine):
    """Per partition: first key, last key, where the last key ended, its span when it is alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = current = object()
        state, last_at, empty = None, {}, True
        for _, rows in _rows(batches, machine.inputs):
            for event in rows:
                if empty or event.key != current:
                    current, state, last_at = event.key, machine.initial(event.key), {}
                    if empty:
                        first, empty = current, False
                last_at[event.kind] = event.at
                state, _ = machine.step(state, event)
        if not empty:
            report = pickle.dumps((first, current, state, last_at))
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "report": [report]})

    return run


def _repair_pass(machine: Machine, wanted: dict[int, list]):
    """Run single-key partitions from given states; report where each run ends and what it reset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        starts = wanted.get(part)
        if not starts:
            return
        states = list(starts)
        resets: list[set] = [set() for _ in starts]
        for _, rows in _rows(batches, machine.inputs):
            for event in rows:
                for i, before in enumerate(states):
                    after, _ = machine.step(before, event)
                    for name in machine.counters:
                        if getattr(after, name) < getattr(before, name):
                            resets[i].add(name)
                    states[i] = after
        ends = [(s, e, frozenset(r)) for s, e, r in zip(starts, states, resets)]
        yield pd.DataFrame({"part": [part], "report": [pickle.dumps(ends)]})

    return run


def _reports(df: DataFrame) -> dict[int, Any]:
    return {row.part: pickle.loads(row.report) for row in df.collect()}


def _starting_states(machine: Machine, ordered: DataFrame) -> dict[int, Any]:
    schema = "part int, report binary"
    edges = _reports(ordered.mapInPandas(_edge_pass(machine), schema))
    tried: dict[int, dict] = {p: {} for p in edges}
    while True:
        starts, wanted, before = {}, {}, None
        for part in sorted(edges):
            first, last, fresh_end, last_at = edges[part]
            continues = before is not None and before[0] == first
            end = fresh_end
            if continues:
                start = before[1]
                starts[part] = start
                if first == last:
                    end = _end_of(machine, start, tried[part], Span(last_at))
                    if end is None:
                        wanted.setdefault(part, []).append(machine.canonical(start))
                        end = fresh_end  # a guess, so that later partitions can be tried in the same round
            before = (last, end)
        if not wanted:
            return starts
        for part, ends in _reports(ordered.mapInPandas(_repair_pass(machine, wanted), schema)).items():
            for start, end, reset in ends:
                tried[part][start] = (end, reset)


def _end_of(machine: Machine, start, tried: dict, span: Span):
    if machine.sleeps(start, span):
        return start
    canonical = machine.canonical(start)
    if canonical not in tried:
        return None
    end, reset = tried[canonical]
    return machine.carried(start, canonical, end, reset)


def replay(events: DataFrame, machine: Machine, partitions: int | None = None) -> DataFrame:
    """``events`` (with key, at in seconds, tie, kind) plus the machine's output columns."""
    columns = [F.col(c) for c in EVENT_ORDER]
    spread = events.repartitionByRange(partitions, *columns) if partitions else events.repartitionByRange(*columns)
    ordered = cut(spread.sortWithinPartitions(*columns))
    starts = _starting_states(machine, ordered)
    made = T.StructType.fromDDL(machine.outputs)
    schema = T.StructType(ordered.schema.fields + made.fields)
    return ordered.mapInPandas(_final_pass(machine, starts), schema)


def event_time(ts) -> Any:
    """TIMESTAMP column to seconds, exact to the microsecond."""
    return F.unix_micros(ts) / F.lit(1e6)
