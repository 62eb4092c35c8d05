"""The gate as a job: admission of reports, circuit breaker, notices, stored state.

Two keyed operators. *Admission*, by report id, labels every report and remembers an id until
event time has passed its age limit. *The gate*, by monitor, steps the breaker over incidents and
outcomes and decides which blocks are worth a notice. Nothing is dropped on the way: late
reports, duplicates and stale ones come out with their label.

A micro-batch leaves messages, audit rows, rejected outcomes and the state of the monitors
it touched, each in a place of its own batch, so a batch that runs again leaves the same.
"""

from __future__ import annotations

import json
from typing import Any, Iterator, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from streamwarden.operators import breaker as B
from streamwarden.operators.context import HISTORY
from streamwarden.operators.replay import Machine
from streamwarden.sources.keyed_table import KeyedTable, replace_rows
from streamwarden.sources.topics import write_messages
from streamwarden.streaming.keyed import STATE_STORE

ARRIVAL = ("_arrived", "_place")  # micros and place of a report
BUCKET = "_bucket"  # of report ids
MOST_ENTRIES = 64  # of the log of a bucket, before it is written anew
STATES = (
    "monitor_name string, state string, consecutive_failures int, trip_count int, opened_at double, "
    "cooldown_seconds double, half_open_trial_in_flight boolean"
)


class FirstSighting(StatefulProcessor):
    """Labels the first arrival of a report id ``ok``, later ones ``duplicate``.

    Keyed by buckets of ids, so that calls of the state store and batches of rows grow with the
    buckets, not with the ids. A bucket's state is a log: ids sighted in one micro-batch are one
    entry with the time each is remembered until, and the latest time counts. A timer writes it
    anew without the ids that were forgotten. One row of each new id is held back at a time,
    whatever the number of copies in a micro-batch.
    """

    def __init__(self, columns: list[str], id_column: str, remember_seconds: float):
        self.columns = columns
        self.id_column = id_column
        self.remember_ms = int(remember_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "ids array<string>, until array<long>")

    def remembered(self) -> tuple[dict[str, int], int]:
        """What each id of the bucket is remembered until, and the entries of the log."""
        held: dict[str, int] = {}
        entries = 0
        for ids, until in self.seen.get() if self.seen.exists() else ():
            entries += 1
            for name, last in zip(ids, until):
                held[name] = max(int(last), held.get(name, 0))
        return held, entries

    def keep(self, held: dict[str, int]) -> None:
        self.seen.put([(list(held), list(held.values()))])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, entries = self.remembered()
        now = timerValues.getCurrentWatermarkInMs()  # a timer may fire after the rows of its batch
        known = {name for name, until in held.items() if until > now}
        sighted: dict[str, int] = {}
        first: pd.DataFrame | None = None
        for batch in rows:
            if batch.empty:  # nothing but an expired timer
                continue
            batch.columns = self.columns  # computed columns may come without their names
            ids = batch[self.id_column].astype(str)
            for name, last in batch[ARRIVAL[0]].groupby(ids).max().items():
                sighted[name] = max(int(last) // 1000 + self.remember_ms, sighted.get(name, 0))
            again = ids.isin(known)
            if again.any():
                yield batch[again].assign(admission="duplicate")
            batch = batch[~again]
            if first is not None:
                batch = pd.concat([first, batch])
            order = batch.sort_values(list(ARRIVAL), kind="stable", ignore_index=True)
            copies = order.duplicated(self.id_column)
            first = order[~copies]
            if copies.any():
                yield order[copies].assign(admission="duplicate")
        if first is not None and len(first):
            yield first.assign(admission="ok")
        later = {name: until for name, until in sighted.items() if until > held.get(name, 0)}
        if later:
            if entries < MOST_ENTRIES:
                self.seen.appendValue((list(later), list(later.values())))
            else:
                self.keep(held | later)
        if sighted and not list(self.handle.listTimers()):
            self.wake(min(sighted.values()), now)

    def wake(self, first: int, now: int) -> None:
        """Some time after ``first``, so that ids with times of their own do not each have the bucket written anew."""
        self.handle.registerTimer(max(first, now + 1) + self.remember_ms // 16)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = {name: until for name, until in self.remembered()[0].items() if until > now}
        if held:
            self.keep(held)
            self.wake(min(held.values()), now)
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def labelled_reports(
    incidents: DataFrame,
    max_age_seconds: float = B.MAX_AGE_SECONDS,
    lateness: str = "15 minutes",
    arrived: str = "timestamp",
    place: Column | None = None,
    remember_seconds: float | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Streaming admission: every report with ``admission``, as ``breaker.admit`` labels a table.

    A report's age is taken when it arrives (column ``arrived``). No monitor comes first, then
    stale, then duplicate; stale reports are not remembered, and reports without id or
    time pass the respective test. An id is remembered until the watermark of arrivals is
    ``remember_seconds`` (the age limit, if not given) past its last sighting: a repetition
    after that, of the same detection time, would be stale. The watermark only moves the timers;
    it drops no row. ``place`` orders reports that arrive at one instant. Ids share ``buckets`` keys
    of the state; a micro-batch reads those it touches and adds what is new to them, so
    there should be the more of them, the more ids are remembered. A stream keeps the number it began with.
    """
    remember = max_age_seconds if remember_seconds is None else remember_seconds
    named = F.coalesce(F.length("monitor_name"), F.lit(0)) > 0
    age = F.unix_micros(F.col(arrived)) / F.lit(1e6) - F.unix_micros("detected_at") / F.lit(1e6)
    old = F.lit(max_age_seconds > 0) & F.coalesce(age > max_age_seconds, F.lit(False))
    label = F.when(~named, "no_monitor").when(old, "stale").otherwise("ok")
    testable = named & ~old & (F.coalesce(F.length("report_id"), F.lit(0)) > 0) & F.col(arrived).isNotNull()
    columns = incidents.columns
    place = F.xxhash64(*columns) if place is None else place
    # the event time itself stays out of the operator, which would drop rows behind the watermark
    asked = incidents.withWatermark(arrived, lateness).where(testable)
    narrow = asked.select(
        *[F.unix_micros(arrived).alias(ARRIVAL[0]) if c == arrived else F.col(c) for c in columns],
        place.alias(ARRIVAL[1]),
        F.pmod(F.xxhash64(F.col("report_id").cast("string")), F.lit(buckets)).alias(BUCKET),
    )
    schema = T.StructType([*narrow.schema.fields, T.StructField("admission", T.StringType())])
    tested = narrow.groupBy(BUCKET).transformWithStateInPandas(
        FirstSighting(narrow.columns, "report_id", remember), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    back = [F.timestamp_micros(ARRIVAL[0]).alias(c) if c == arrived else F.col(c) for c in columns]
    rest = incidents.where(~testable | testable.isNull()).select(*columns, label.alias("admission"))
    return tested.select(*back, "admission").unionByName(rest)


class Gate(StatefulProcessor):
    """Breaker state and time of the last notice of a monitor."""

    def __init__(self, machine: Machine, notice_seconds: float):
        self.machine = machine
        self.notice_seconds = notice_seconds
        self.columns = list(machine.inputs)
        self.made = [*T.StructType.fromDDL(machine.outputs).fieldNames(), "notify"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", "breaker string, told double")
        self.row = NamedTuple("row", [(n, Any) for n in self.columns])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, told = self.machine.initial(key[0]), None
        if self.held.exists():
            text, told = self.held.get()
            state = type(state)(*json.loads(text))
        # narrow rows: a monitor's events of one micro-batch, which the source bounds
        batch = pd.concat(list(rows)).sort_values(["at", "tie"], ignore_index=True)
        produced = []
        for values in batch[self.columns].itertuples(index=False, name=None):
            event = self.row(*values)
            after, output = self.machine.step(state, event)
            notify = True
            if output[3] == B.BLOCK:
                notify = after.state != state.state or told is None or event.at - told >= self.notice_seconds
                told = event.at if notify else told
            state = after
            produced.append((*output, notify))
        self.held.update((json.dumps(list(state)), told))
        yield pd.concat([batch, pd.DataFrame(produced, columns=self.made, dtype=object)], axis=1)

    def close(self) -> None:
        pass


def gate_events(incidents: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """One stream of (key, at, tie, kind, success) from admitted incidents and reported outcomes.

    ``incidents`` has monitor_name, report_id and timestamp; ``outcomes`` success besides.
    """
    at = (F.unix_micros("timestamp") / F.lit(1e6)).alias("at")
    common = [F.col("monitor_name").cast("string").alias("key"), at, F.col("report_id").cast("string").alias("tie")]
    events = incidents.select(*common, F.lit(B.INCIDENT).alias("kind"), F.lit(None).cast("boolean").alias("success"))
    if outcomes is None:
        return events
    return events.unionByName(outcomes.select(*common, F.lit(B.OUTCOME).alias("kind"), "success"))


def gated(
    events: DataFrame,
    settings: B.BreakerSettings = B.BreakerSettings(),
    notice_seconds: float = B.BLOCK_NOTICE_SECONDS,
) -> DataFrame:
    """Decisions on a stream of gate events, with ``notify``."""
    machine = B.breaker_machine(settings)
    made = T.StructType.fromDDL(f"{machine.outputs}, notify boolean")
    return events.groupBy("key").transformWithStateInPandas(
        Gate(machine, notice_seconds),
        outputStructType=T.StructType(events.schema.fields + made.fields),
        outputMode="Append",
        timeMode="None",
    )


def state_table(out: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(f"{out}/breaker_state", ("monitor_name",), STATES, buckets)


def audit_rows(decisions: DataFrame) -> DataFrame:
    """What the event log keeps: every transition and decision but blocks nobody is told of."""
    return decisions.where("notify").select(
        F.col("key").alias("monitor_name"),
        F.col("entry").alias("event_type"),
        "from_state",
        "to_state",
        "reason",
        F.col("tie").alias("related_report_id"),
        F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("created_at"),
    )


TRANSITIONS = (
    "monitor_name string, event_type string, from_state string, to_state string, event_id string, created_at timestamp"
)


def transitions_of(log: DataFrame) -> DataFrame:
    return log.select("monitor_name", "event_type", "from_state", "to_state", F.col("related_report_id").alias("event_id"), "created_at")


def transition_table(out: str, buckets: int = 64) -> KeyedTable:
    """The newest transitions of each monitor, so that nobody has to search the whole log for them."""
    return KeyedTable(f"{out}/recent_transitions", ("monitor_name",), TRANSITIONS, buckets)


def newest_rows(rows: DataFrame, limit: int = HISTORY) -> DataFrame:
    """At most ``limit`` newest rows of each monitor; the rank filter drops the others before the shuffle."""
    newest = Window.partitionBy("monitor_name").orderBy(F.desc("created_at"), F.desc("event_id"), F.desc("event_type"))
    return rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit).drop("_rank")


def newest_transitions(spark: SparkSession, out: str, monitors: DataFrame, buckets: int = 64) -> DataFrame:
    """Stored transitions of some monitors, from their buckets alone."""
    return transition_table(out, buckets).lookup(monitors)


def gate_counters(admitted: DataFrame, decisions: DataFrame) -> DataFrame:
    """Admission labels and, as ``suppressed``, blocks without a notice; how many of each."""
    quiet = decisions.where(~F.col("notify")).select(F.lit("suppressed").alias("admission"))
    return B.admission_counts(admitted.select("admission").unionByName(quiet))


def gate_stream(
    incidents: DataFrame,
    outcomes: DataFrame | None,
    out: str,
    checkpoint: str,
    settings: B.BreakerSettings = B.BreakerSettings(),
    notice_seconds: float = B.BLOCK_NOTICE_SECONDS,
    dry_run: bool = False,
    sink: str = "json",
    buckets: int = 64,
    **trigger,
) -> StreamingQuery:
    """Gate admitted incidents and outcomes; store messages, audit rows and monitor states.

    ``dry_run`` publishes nothing; audit and state are kept. An outcome of a monitor without
    state is rejected and logged.
    """
    spark = incidents.sparkSession
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)

    def work(batch: DataFrame, batch_id: int) -> None:
        decisions = batch.persist()
        try:
            write_messages(B.announce(decisions, dry_run), sink, batch_id, path=f"{out}/messages")
            audit_rows(decisions).write.mode("overwrite").parquet(f"{out}/breaker_events/batch={batch_id}")
            latest = B.current_state(decisions)
            state_table(out, buckets).upsert(latest, checkpoint, batch_id, replace_rows("monitor_name"))
            moves = newest_rows(transitions_of(audit_rows(decisions)))
            transition_table(out, buckets).upsert(moves, checkpoint, batch_id, lambda held, new: newest_rows(held.unionByName(new)))
        finally:
            decisions.unpersist()

    writer = gated(gate_events(incidents, outcomes), settings, notice_seconds).writeStream
    return writer.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored_states(spark: SparkSession, out: str, monitors: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Monitor states as the job left them; of some monitors, from their buckets alone."""
    table = state_table(out, buckets)
    return table.read(spark) if monitors is None else table.lookup(monitors)
