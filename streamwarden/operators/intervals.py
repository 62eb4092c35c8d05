"""Replay of "at most once per interval" decisions over a whole table, in event order.

Per key, an event fires when it must (``set``) or when enough time has passed since
the last one that fired (``wait``: the time it asks for); ``clear`` forgets the last
one. All that a stretch of events needs to know of the past is one time, and what
it makes of that time is a step function: its first event with
``at - wait >= last`` fires, and from there on everything follows.

So each range partition states its function from time to time in one pass, however
its key goes on. Functions of neighbouring partitions are put together in blocks of
about the square root of their number, the blocks are walked in order, and each
partition then gets its own starting time by a join. The number of Spark jobs is the
same for any number of partitions; no state passes through the driver.

An event's wait may depend on the key's previous flagged event (``wait_again`` where
that flag was true), so a function has two variants and carries that flag along.

Cases: NULL keys form a key of their own; events of equal time are ordered by
``tie``; a NULL flag leaves the previous one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from streamwarden.session import cut

NONE, SET, CLEAR, WAIT = "none", "set", "clear", "wait"
EFFECTS = {NONE: 0, SET: 1, CLEAR: 2, WAIT: 3}
NEVER = -math.inf  # no event has fired, or it was forgotten
SAME = math.nan  # a function's exit: the time it was given

# key, part (for order), alone: the part holds this key only as its first one;
# for each previous flag: upper ends of the steps, exits, flag left (NULL: unchanged)
FUNCTION = "k string, part int, uppers array<array<double>>, exits array<array<double>>, flag boolean"


class Stretch:
    """Events of one key in order, as arrays."""

    def __init__(self, rows: pd.DataFrame):
        self.at = rows["at"].to_numpy(np.float64)
        self.effect = rows["effect_code"].to_numpy(np.int64)
        flags = rows["flag"].to_numpy(object)
        known = np.array([f is not None and f == f for f in flags], dtype=bool)
        self.flags = np.array([bool(f) if k else False for f, k in zip(flags, known)], dtype=bool)
        place = np.maximum.accumulate(np.where(known, np.arange(len(flags)), -1)) if len(flags) else np.zeros(0, int)
        self.before = np.append(-1, place[:-1])[: len(flags)]  # the previous flagged event
        self.last_flag = bool(self.flags[place[-1]]) if len(place) and place[-1] >= 0 else None
        self.wait = rows["wait"].to_numpy(np.float64)
        self.wait_again = rows["wait_again"].to_numpy(np.float64)

    def again(self, flag: bool) -> np.ndarray:
        return np.where(self.before >= 0, self.flags[np.maximum(self.before, 0)], flag)

    def latest(self, flag: bool) -> np.ndarray:
        """For each event the latest last time with which it still fires."""
        due = self.at - np.where(self.again(flag), self.wait_again, self.wait)
        return np.select([self.effect == 1, self.effect == 2, self.effect == 3], [math.inf, math.inf, due], NEVER)

    def following(self, latest: np.ndarray) -> np.ndarray:
        """For each event, once it has taken effect, the next that does (their number: none).

        Latest times rise along events of one wait, so a search in each such run of
        records is enough: the candidates are the running maxima seen from the right.
        """
        size = len(latest)
        state = np.where(self.effect == 2, NEVER, self.at)
        out = np.full(size, size)
        tree = _Maxima(np.where(self.effect == 0, math.nan, latest))
        for i in np.flatnonzero(self.effect != 0).tolist():
            out[i] = tree.first(i + 1, state[i])
        return out


class _Maxima:
    """First place at or after another with a value of at least some bound."""

    def __init__(self, values: np.ndarray):
        self.size = 1 << max(0, (len(values) - 1).bit_length()) if len(values) else 1
        self.count = len(values)
        level = np.full(self.size, math.nan)
        level[: len(values)] = values
        self.levels = [level]
        while len(level) > 1:
            level = np.fmax(level[::2], level[1::2])
            self.levels.append(level)

    def first(self, start: int, bound: float) -> int:
        place, height = start, 0
        if start >= self.size:
            return self.count
        while True:
            if self.levels[height][place] >= bound:
                break
            while place & 1:
                place >>= 1
                height += 1
            if height == len(self.levels) - 1:
                return self.count
            place += 1
        while height:
            height -= 1
            place *= 2
            if not self.levels[height][place] >= bound:
                place += 1
        return place


def function_of(stretch: Stretch, flag: bool) -> tuple[np.ndarray, np.ndarray]:
    """Step function of the last time: uppers ascending, exits; beyond them it stays."""
    latest = stretch.latest(flag)
    following = stretch.following(latest)
    size = len(latest)
    exits = np.where(stretch.effect == 2, NEVER, stretch.at)
    for i in range(size - 1, -1, -1):
        if following[i] < size:
            exits[i] = exits[following[i]]
    active = np.flatnonzero(stretch.effect != 0)
    tops = np.maximum.accumulate(latest[active]) if len(active) else np.zeros(0)
    record = np.append(True, tops[1:] > tops[:-1])[: len(active)]
    uppers, exits = tops[record], exits[active[record]]
    return _short(uppers, exits)


def _short(uppers: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring steps with one exit are one step."""
    same = (exits[1:] == exits[:-1]) | (np.isnan(exits[1:]) & np.isnan(exits[:-1]))
    keep = np.append(~same, True)[: len(uppers)]
    return uppers[keep], exits[keep]


def apply(uppers: np.ndarray, exits: np.ndarray, last: float) -> float:
    at = int(np.searchsorted(uppers, last, side="left"))
    found = exits[at] if at < len(uppers) else math.nan
    return last if math.isnan(found) else float(found)


def compose(first: tuple, second: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The function that takes what ``first`` leaves on to ``second``."""
    ends = np.unique(np.concatenate([first[0], second[0]]))
    exits = []
    for end in ends:
        middle = apply(*first, end)
        through = apply(*second, middle)
        # a step that leaves the time alone in both stays open for every time in it
        untouched = _alone(first, end) and _alone(second, end)
        exits.append(math.nan if untouched else through)
    return _short(ends, np.array(exits))


def _alone(function: tuple, last: float) -> bool:
    at = int(np.searchsorted(function[0], last, side="left"))
    return at >= len(function[0]) or math.isnan(function[1][at])


def fired(stretch: Stretch, last: float, flag: bool) -> tuple[list[int], float, np.ndarray]:
    """Places that take effect, the time left, and the last time before each event."""
    latest = stretch.latest(flag)
    tree = _Maxima(np.where(stretch.effect == 0, math.nan, latest))
    size = len(latest)
    places, since, at = [], np.full(size, NEVER), 0
    while True:
        place = tree.first(at, last)
        since[at : min(place + 1, size)] = last
        if place >= size:
            return places, last, since
        places.append(place)
        last = NEVER if stretch.effect[place] == 2 else float(stretch.at[place])
        at = place + 1


class Carried:
    """A stretch's two functions, by the flag before it, and the flag it leaves."""

    def __init__(self, variants: list[tuple], flag):
        self.variants, self.flag = variants, flag

    @classmethod
    def of(cls, row) -> Carried:
        pairs = [(np.array(list(u), float), np.array(list(e), float)) for u, e in zip(row.uppers, row.exits)]
        return cls(pairs, None if row.flag is None or row.flag != row.flag else bool(row.flag))

    def then(self, after: Carried) -> Carried:
        variants = []
        for flag, own in zip((False, True), self.variants):
            left = flag if self.flag is None else self.flag
            variants.append(compose(own, after.variants[int(left)]))
        return Carried(variants, self.flag if after.flag is None else after.flag)

    def run(self, last: float, flag: bool) -> tuple[float, bool]:
        return apply(*self.variants[int(flag)], last), flag if self.flag is None else self.flag

    def fields(self) -> tuple:
        return [u.tolist() for u, _ in self.variants], [e.tolist() for _, e in self.variants], self.flag


IDENTITY = (np.zeros(0), np.zeros(0))


def _segments(rows: pd.DataFrame):
    """(start, end) of the runs of one key."""
    keys = rows["k"].to_numpy(object)
    bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() if len(keys) else []
    return list(zip(bounds, [*bounds[1:], len(keys)]))


def _state_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The partition's first key and, if another, its last: what they make of the past."""
    rows = pd.concat(list(batches), ignore_index=True)  # one range partition of thin rows
    found = _segments(rows)
    out = []
    for start, end in found[:1] + found[1:][-1:]:
        stretch = Stretch(rows.iloc[start:end])
        if start:  # the key begins here, so what it leaves is known
            left = (np.array([math.inf]), np.array([fired(stretch, NEVER, False)[1]]))
            carried = Carried([left, left], bool(stretch.last_flag))
        else:
            carried = Carried([function_of(stretch, flag) for flag in (False, True)], stretch.last_flag)
        out.append((rows["k"].iloc[start], TaskContext.get().partitionId(), *carried.fields()))
    yield pd.DataFrame(out, columns=["k", "part", "uppers", "exits", "flag"])


def _put_together(frame: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for row in frame.sort_values("part").itertuples():
        own = Carried.of(row)
        whole = own if whole is None else whole.then(own)
    return pd.DataFrame([(frame["k"].iloc[0], int(frame["block"].iloc[0]), *whole.fields())], columns=["k", "part", "uppers", "exits", "flag"])


def _walk_from(frame: pd.DataFrame, last: float, flag: bool) -> pd.DataFrame:
    """Starting time and flag of each part of a key, in order."""
    out = []
    for row in frame.sort_values("part").itertuples():
        out.append((row.k, int(row.part), last, flag))
        last, flag = Carried.of(row).run(last, flag)
    return pd.DataFrame(out, columns=["k", "part", "last", "flag"])


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    return _walk_from(frame, NEVER, False)


def _walk_block(functions: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    if not len(functions) or not len(starts):
        return pd.DataFrame({"k": [], "part": [], "last": [], "flag": []})
    return _walk_from(functions, float(starts["last"].iloc[0]), bool(starts["flag"].iloc[0]))


def starting_points(functions: DataFrame, parts: int) -> DataFrame:
    """(k, part, last, flag): what each partition starts from."""
    side = max(1, math.isqrt(max(parts - 1, 0)) + 1)
    start = "k string, part int, last double, flag boolean"
    blocked = functions.withColumn("block", F.floor(F.col("part") / side).cast("int"))
    blocks = blocked.groupBy("k", "block").applyInPandas(_put_together, FUNCTION)
    block_starts = blocks.groupBy("k").applyInPandas(_walk, start).withColumnRenamed("part", "block")
    return (
        blocked.groupBy("k", "block").cogroup(block_starts.groupBy("k", "block")).applyInPandas(_walk_block, start)
    )


def _decide(columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)  # one range partition of thin rows
        fires = np.zeros(len(rows), dtype=bool)
        last_before = np.full(len(rows), math.nan)
        again = np.zeros(len(rows), dtype=bool)
        for start, end in _segments(rows):
            part = rows.iloc[start:end]
            first = part.iloc[0]
            given = first["start_last"] == first["start_last"] and first["start_last"] is not None
            last, flag = (float(first["start_last"]), bool(first["start_flag"])) if given else (NEVER, False)
            stretch = Stretch(part)
            again[start:end] = stretch.again(flag)
            places, _, since = fired(stretch, last, flag)
            fires[[start + p for p in places if stretch.effect[p] != 2]] = True
            last_before[start:end] = np.where(np.isfinite(since), since, math.nan)
        made = rows[columns].copy()
        made["fires"], made["again"] = fires, again
        made["last"] = pd.Series(last_before, index=rows.index).astype(object).where(~np.isnan(last_before), None)
        yield made

    return run


def replay_intervals(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """``events`` with ``fires``, ``again`` (the previous flag) and ``last`` (when the key
    last fired before this event, NULL if never or forgotten).

    Columns read: key, at (seconds), tie, effect, wait, wait_again, flag.
    """
    columns = [F.col(c) for c in ("key", "at", "tie")]
    code = F.coalesce(*[F.when(F.col("effect") == name, F.lit(n)) for name, n in EFFECTS.items()], F.lit(0))
    coded = events.withColumns({"k": F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("NULL")), "effect_code": code})
    spread = coded.repartitionByRange(partitions, *columns) if partitions else coded.repartitionByRange(*columns)
    ordered = cut(spread.sortWithinPartitions(*columns))
    thin = ordered.select("k", "at", "effect_code", "wait", "wait_again", "flag")
    functions = cut(thin.mapInPandas(_state_functions, FUNCTION))
    starts = starting_points(functions, ordered.rdd.getNumPartitions())
    # two rows for each partition at most
    starts = F.broadcast(starts.select(F.col("k").alias("start_k"), "part", F.col("last").alias("start_last"), F.col("flag").alias("start_flag")))
    placed = ordered.withColumn("own_part", F.spark_partition_id())
    placed = placed.join(starts, (F.col("k") == F.col("start_k")) & (F.col("own_part") == F.col("part")), "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return placed.mapInPandas(_decide(events.columns), f"{schema}, fires boolean, again boolean, last double")
