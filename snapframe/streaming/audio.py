"""Whistles from audio that arrives in chunks: the same events as from the whole, wherever it is cut."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from snapframe.operators.audio import EVENT, WEIGHTS
from snapframe.streaming.tracking import use_state_store

OPEN = "block long, samples long, squares double, run_first long, run_rows long, run_peak double, next_block long, " + ", ".join(f"{c} double" for c in EVENT)


class Settings(NamedTuple):
    hop: int
    rate: float
    limit: float
    full: float
    gap: float
    timeout_ms: int


class Listener:
    """The unfinished block, the open run of loud blocks and the last whistle, which may still be merged."""

    def __init__(self, settings: Settings, held: tuple | None = None):
        self.s = settings
        self.block, self.samples, self.squares, self.run_first, self.run_rows, self.run_peak, self.next_block, *event = held or (None, 0, 0.0, None, 0, 0.0, 0, *[None] * len(EVENT))
        self.last = None if event[0] is None else tuple(event)
        self.out: list[tuple] = []

    def state(self) -> tuple:
        return (self.block, self.samples, self.squares, self.run_first, self.run_rows, self.run_peak, self.next_block, *(self.last or [None] * len(EVENT)))

    def hear(self, index: np.ndarray, value: np.ndarray) -> None:
        """Samples after those heard so far, in any order within the call."""
        order = np.argsort(index, kind="stable")
        index, squares = index[order], value[order].astype(float) ** 2
        blocks, starts = np.unique(index // self.s.hop, return_index=True)
        for block, n, total in zip(blocks.tolist(), np.diff([*starts, len(index)]).tolist(), np.add.reduceat(squares, starts).tolist() if len(starts) else [], strict=True):
            if block == self.block:
                self.samples, self.squares = self.samples + n, self.squares + total
            else:
                self.block, self.samples, self.squares = block, n, total
            if self.samples == self.s.hop:
                self._heard(block, self.squares / self.s.hop)
        self._settle()

    def _heard(self, block: int, energy: float) -> None:
        if self.run_first is not None and (energy <= self.s.limit or block != self.run_first + self.run_rows):
            self._close()
        if energy > self.s.limit:
            if self.run_first is None:
                self.run_first, self.run_rows, self.run_peak = block, 0, 0.0
            self.run_rows, self.run_peak = self.run_rows + 1, max(self.run_peak, energy)
        self.next_block = block + 1

    def _close(self) -> None:
        seconds = self.s.hop / self.s.rate
        onset = min(1.0, max(0.0, self.run_peak / self.s.full))
        event = (self.run_first * seconds, min(1.0, max(0.0, WEIGHTS["onset"] * onset + WEIGHTS["energy"])), self.run_peak, 0.0, self.run_rows * seconds)
        self.run_first = None
        if self.last is not None and event[0] - self.last[0] <= self.s.gap:
            a, b = self.last, event
            self.last = (b[0] if b[1] > a[1] else a[0], min(1.0, max(0.0, (a[1] + b[1]) / 2)), (a[2] + b[2]) / 2, (a[3] + b[3]) / 2, max(a[4], b[4]))
        else:
            self._emit()
            self.last = event

    def _emit(self) -> None:
        if self.last is not None:
            self.out.append(self.last)
            self.last = None

    def _settle(self) -> None:
        """Hand on the last whistle once no later one can be near it."""
        ahead = self.next_block if self.run_first is None else self.run_first
        if self.last is not None and ahead * self.s.hop / self.s.rate - self.last[0] > self.s.gap:
            self._emit()

    def finish(self) -> None:
        if self.run_first is not None:
            self._close()
        self._emit()


class ChunkListener(StatefulProcessor):
    def __init__(self, settings: Settings, keys: Sequence[str], index: str, value: str):
        self.settings, self.keys, self.index, self.value = settings, list(keys), index, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("open", OPEN)

    def _rows(self, key: tuple, events: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(events, columns=list(EVENT), dtype=float)
        for name, part in reversed(list(zip(self.keys, key, strict=True))):
            found.insert(0, name, pd.Series([part] * len(found), dtype=object if isinstance(part, str) else None))
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(list(rows))  # one micro-batch's share of a recording
        listener = Listener(self.settings, self.held.get() if self.held.exists() else None)
        ends = chunk[self.value].isna()
        heard = chunk[~ends]
        listener.hear(heard[self.index].to_numpy(np.int64), heard[self.value].to_numpy(float))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ends.any():
            listener.finish()
            self.held.clear()
        else:
            self.held.update(listener.state())
            self.handle.registerTimer(int(chunk["at"].max().timestamp() * 1000) + self.settings.timeout_ms)
        yield self._rows(key, listener.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        listener = Listener(self.settings, self.held.get() if self.held.exists() else None)
        listener.finish()
        self.held.clear()
        yield self._rows(key, listener.out)

    def close(self) -> None:
        pass


def whistle_stream(
    samples: DataFrame, keys: Sequence[str], index: str, value: str, hop: int, rate: float, limit: float, full: float = 1.0, gap: float = 0.1, timeout_seconds: float = 60.0, lateness: str = "1 minute"
) -> DataFrame:
    """Whistles of a stream of samples, as `operators.audio.whistles` finds them in the whole table.

    `samples` has the keys, the sample's place `index` and its `value`, and the event time `at`. A
    recording's samples arrive in order from one micro-batch to the next. A row with null value ends
    it; so does silence of `timeout_seconds` by the watermark. Whistles come out when no later one can be
    merged with them.
    """
    use_state_store(samples.sparkSession)
    schema = T.StructType([*(samples.schema[k] for k in keys), *T._parse_datatype_string(", ".join(f"{c} double" for c in EVENT)).fields])
    listener = ChunkListener(Settings(hop, float(rate), float(limit), float(full), float(gap), int(timeout_seconds * 1000)), keys, index, value)
    timed = samples.select(*keys, F.col(index).cast("long").alias(index), F.col(value).cast("double").alias(value), "at").withWatermark("at", lateness)
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=listener, outputStructType=schema, outputMode="append", timeMode="EventTime")
