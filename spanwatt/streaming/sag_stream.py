"""The sag machine over a stream: the memory of a tower lasts from batch to batch, and from a batch job before it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanwatt.operators.sag import INPUTS, MEMORY, STEP_COLUMNS, Memory, step

NAMES = [c.split(" ")[0] for c in STEP_COLUMNS.split(", ")]


def _known(value: object) -> object:
    return None if isinstance(value, float) and math.isnan(value) else value


class _Machine(StatefulProcessor):
    """Typed state of a tower: the fields of ``Memory``."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("memory", MEMORY)

    def _memory(self) -> Memory:
        if not self.kept.exists():
            return Memory()
        state, last, calm, angles, winds, errors = self.kept.get()
        return Memory(state, _known(last), int(calm), list(angles), list(winds), list(errors))

    def _remember(self, m: Memory) -> None:
        self.kept.update((m.state, m.last, m.calm, m.angles, m.winds, m.errors))

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers: object) -> None:  # noqa: N802
        row = initial.iloc[0]
        self._remember(Memory(row["state"], _known(row["last"]), int(row["calm"]), list(row["angles"]), list(row["winds"]), list(row["errors"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        memory, made = self._memory(), []
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        columns = [self.order, *INPUTS]
        for values in batch[columns].itertuples(index=False, name=None):
            row = dict(zip(columns, map(_known, values), strict=True))
            row["wind_speed"] = row["wind_speed"] or 0.0
            made.append([key[0], row[self.order], *step(memory, row).values()])
        self._remember(memory)
        yield pd.DataFrame(made, columns=["tower_id", self.order, *NAMES])

    def close(self) -> None:
        pass


def validate_stream(prepared: DataFrame, order: str = "sample_index", initial: DataFrame | None = None) -> DataFrame:
    """``sag.validate`` for a streaming frame: in every batch a tower's rows are taken in the order of ``order``; its
    state goes on where the last batch left it.

    initial: tower_id and the fields of MEMORY, as ``sag.folded`` gives them, for towers that a batch job has seen
    before.  State lives in the state store of the checkpoint; the session must use the RocksDB one.
    """
    rows = prepared.select("tower_id", order, *INPUTS)
    started = None if initial is None else initial.groupBy("tower_id")
    return rows.groupBy("tower_id").transformWithStateInPandas(_Machine(order), f"tower_id string, {order} long, {STEP_COLUMNS}", "Append", "None", started)
