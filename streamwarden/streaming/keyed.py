"""The replayed state machines as stateful streaming operators."""

from __future__ import annotations

import json
from typing import Any, Iterator, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamwarden.operators.replay import Machine

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


class KeyedMachine(StatefulProcessor):
    """One value state per key, advanced by the machine's own step function."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.columns = list(machine.inputs)
        self.made = T.StructType.fromDDL(machine.outputs).fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", T.StructType().add("json", "string"))
        self.row = NamedTuple("row", [(n, Any) for n in self.columns])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.machine.initial(key[0])
        if self.held.exists():
            state = type(state)(*json.loads(self.held.get()[0]))
        batch = pd.concat(list(rows)).sort_values(["at", "tie"], ignore_index=True)
        produced = []
        for values in batch[self.columns].itertuples(index=False, name=None):
            state, output = self.machine.step(state, self.row(*values))
            produced.append(output)
        self.held.update((json.dumps(list(state)),))
        yield pd.concat([batch, pd.DataFrame(produced, columns=self.made, dtype=object)], axis=1)

    def close(self) -> None:
        pass


def keyed_stream(events: DataFrame, machine: Machine) -> DataFrame:
    """Decisions on a stream of (key, at, tie, kind, ...) events.

    Rows of one key are stepped in event order within a micro-batch; bound the
    micro-batch at the source (files or offsets per trigger). Needs the RocksDB
    state store, see ``STATE_STORE``.
    """
    schema = T.StructType(events.schema.fields + T.StructType.fromDDL(machine.outputs).fields)
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=KeyedMachine(machine), outputStructType=schema, outputMode="Append", timeMode="None"
    )
