"""Streaming: identities carried from batch to batch, and results that grow with their input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from snapframe.operators.tracking import TrackerState, follow

TRACKED = "video_id string, play_index int, frame_index int, detection_index int, track_id long"
TRACK = "box array<double>, look array<double>, lost int, crowded boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark) -> None:
    """The store that named states and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class Tracker(StatefulProcessor):
    """Tracks of one play: a state for each track, the next id and last frame, and a timer that ends a silent play."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "track_id long", TRACK)
        self.place = handle.getValueState("place", "next_id long, frame long")

    def _load(self) -> TrackerState:
        state = TrackerState()
        if self.place.exists():
            state.next_id, state.frame = self.place.get()
        for (i,), (box, look, lost, crowded) in self.tracks.iterator():
            state.boxes[i], state.looks[i], state.lost[i], state.crowded[i] = np.array(box), np.array(look), lost, crowded
        return state

    def _store(self, state: TrackerState, known: set[int]) -> None:
        for i in known - set(state.boxes):
            self.tracks.removeKey((i,))
        for i, box in state.boxes.items():
            self.tracks.updateValue((i,), (box.tolist(), state.looks[i].tolist(), int(state.lost[i]), bool(state.crowded[i])))
        self.place.update((state.next_id, state.frame))

    def _forget(self) -> None:
        self.tracks.clear()
        self.place.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))  # a play's share of one micro-batch
        ends = batch["bbox"].isna()
        state = self._load()
        known = set(state.boxes)
        out = follow(state, batch[~ends])
        self._forget() if ends.any() else self._store(state, known)
        if not ends.any():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(batch["at"].max().timestamp() * 1000) + self.timeout_ms)
        yield out[["video_id", "play_index", "frame_index", "detection_index", "track_id"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        return iter([])

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, timeout_seconds: float = 600.0, lateness: str = "1 minute") -> DataFrame:
    """Track ids for a stream of detections, which has the event time `at`; each play's tracks are its state.

    Frames of a play must arrive in order from one micro-batch to the next, whole frames at a time.
    A row without bbox ends its play and drops the state; a play without such a row is dropped once
    the watermark, `lateness` behind the latest event time, is `timeout_seconds` past its last row. A
    play that goes on after that starts anew. Rows later than the watermark are dropped by the engine.
    """
    use_state_store(detections.sparkSession)
    timed = detections.withWatermark("at", lateness)
    tracker = Tracker(int(timeout_seconds * 1000))
    return timed.groupBy("video_id", "play_index").transformWithStateInPandas(statefulProcessor=tracker, outputStructType=TRACKED, outputMode="append", timeMode="EventTime")


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply `step` to the micro-batches that are there now, then stop: one turn of a polling loop."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
