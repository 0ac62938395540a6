"""Identity of boxes over time: optimal assignment per frame with ageing of lost tracks.

The state of a (video, play) is carried from frame to frame. A frame without detections ages every
track, so after a longer pause none is left: a play is cut there and its pieces are followed by
different tasks. The same step runs over batches (`track`) and streams (`streaming.tracking`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapframe.functions.geometry import matrix_product
from snapframe.operators.sequences import sessions
from snapframe.session import cut

LEAST_IOU = 0.3
LEAST_LIKENESS = 0.7
LIKENESS_WEIGHT = 0.5
LOST_FRAMES = 10
LOST_FRAMES_CROWDED = 45
CROWD_OVERLAP = 0.35
SPAN = 1024  # frames multiplied up in one task


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each box of a with each of b."""
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.prod(np.maximum(0.0, high - low), axis=2)
    size = lambda x: np.prod(np.maximum(0.0, x[:, 2:] - x[:, :2]), axis=1)
    union = size(a)[:, None] + size(b)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the greatest total score, by successive shortest paths."""
    flipped = score.shape[0] > score.shape[1]
    cost = -(score.T if flipped else score)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, seen, via = np.full(m, np.inf), np.zeros(m, bool), np.full(m, -1)
        at, column, reached = row, -1, 0.0
        while True:
            slack = reached + cost[at] - u[at] - v
            better = ~seen & (slack < dist)
            dist[better], via[better] = slack[better], column
            column = int(np.argmin(np.where(seen, np.inf, dist)))
            reached, seen[column] = dist[column], True
            if owner[column] < 0:
                break
            at = owner[column]
        done = seen.copy()
        done[column] = False
        u[row] += reached
        u[owner[done]] += reached - dist[done]
        v[seen] += dist[seen] - reached
        while column >= 0:
            before = via[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    pairs = [(int(r), c) for c, r in enumerate(owner) if r >= 0]
    return sorted((c, r) if flipped else (r, c) for r, c in pairs)


@dataclass
class TrackerState:
    """Active tracks of one play."""

    boxes: dict[int, np.ndarray] = field(default_factory=dict)
    looks: dict[int, np.ndarray] = field(default_factory=dict)
    lost: dict[int, int] = field(default_factory=dict)
    crowded: dict[int, bool] = field(default_factory=dict)
    next_id: int = 0
    frame: int | None = None  # the last one seen

    def idle(self, frames: int) -> None:
        """Frames without detections pass."""
        for i in list(self.boxes) if frames > 0 else ():
            self._age(i, frames)

    def _age(self, i: int, frames: int = 1) -> None:
        self.lost[i] += frames
        if self.lost[i] > (LOST_FRAMES_CROWDED if self.crowded[i] else LOST_FRAMES):
            for held in (self.boxes, self.looks, self.lost, self.crowded):
                del held[i]

    def step(self, boxes: np.ndarray, looks: np.ndarray) -> list[int]:
        """Track ids of a frame's boxes; unmatched tracks age and end, unmatched boxes start tracks."""
        ids, out = sorted(self.boxes), [-1] * len(boxes)
        if ids and len(boxes):
            over = overlaps(np.array([self.boxes[i] for i in ids]), boxes)
            known = np.array([self.looks[i] for i in ids])
            norm = np.linalg.norm(known, axis=1)[:, None] * np.linalg.norm(looks, axis=1)[None, :]
            like = np.divide(known @ looks.T, norm, out=np.zeros_like(over), where=norm > 0)
            eligible = (over > LEAST_IOU) | (like > LEAST_LIKENESS)
            score = np.where(eligible, over + LIKENESS_WEIGHT * like, -1e6)
            for a, b in assign(score):
                if eligible[a, b]:
                    out[b] = ids[a]
        for i in set(ids) - set(out):
            self._age(i)
        crowd = (overlaps(boxes, boxes) > CROWD_OVERLAP).sum(1) - 1 >= 2 if len(boxes) else []
        for b in range(len(boxes)):
            if out[b] < 0:
                out[b], self.next_id = self.next_id, self.next_id + 1
            self.boxes[out[b]], self.looks[out[b]], self.lost[out[b]], self.crowded[out[b]] = boxes[b], looks[b], 0, bool(crowd[b])
        return out


def follow(state: TrackerState, rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of whole frames, in any order, with their track ids; frames that are missing had no detections."""
    parts = []
    for at, frame in rows.sort_values(["frame_index", "detection_index"]).groupby("frame_index", sort=True):
        boxes = np.array(frame["bbox"].tolist(), float).reshape(-1, 4)
        looks = np.array(frame["look"].tolist(), float).reshape(len(frame), -1)
        if state.frame is not None:
            state.idle(int(at) - state.frame - 1)
        state.frame = int(at)
        parts.append(frame.assign(track_id=state.step(boxes, looks)))
    return pd.concat(parts) if parts else rows.assign(track_id=pd.Series(dtype="int64"))


def track(detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections (frame_index, detection_index, bbox, look) of each play with a track_id.

    A play is cut where more frames pass without detections than any track outlives; the ids of a
    piece follow on those of the pieces before it.
    """
    keys = list(keys)
    frames = sessions(detections.select(*keys, "frame_index").distinct(), keys, "frame_index", lambda at, before: at - before > LOST_FRAMES_CROWDED + 1)
    named = frames.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("frame_index").alias("_frame"), "_session")
    met = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)), F.col("frame_index") == F.col("_frame"))
    pieces = detections.join(named, met).select(*detections.columns, "_session")
    schema = T.StructType([*pieces.schema.fields, T.StructField("track_id", T.LongType())])
    found = pieces.groupBy(*keys, "_session").applyInPandas(lambda rows: follow(TrackerState(), rows)[schema.names], schema)
    found = cut(found, "tracks")  # read twice
    sizes = found.groupBy(*keys, "_session").agg((F.max("track_id") + 1).alias("_ids"))
    before = F.sum("_ids").over(Window.partitionBy(*keys).orderBy("_session")) - F.col("_ids")
    offsets = sizes.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_session").alias("_piece"), before.alias("_before"))
    own = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)), F.col("_session") == F.col("_piece"))
    return found.join(offsets, own).select(*detections.columns, (F.col("track_id") + F.col("_before")).alias("track_id"))


def camera_to_reference(motions: DataFrame, keys: Sequence[str], order: str = "frame_index") -> DataFrame:
    """Product of the homographies up to each frame: keys, order, homography_to_ref.

    An unreliable or missing estimate counts as no motion. Spans of SPAN frames are multiplied up
    by themselves; only the spans' products are folded video by video, and each span then carries
    the product of those before it along its frames.
    """
    identity = F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))
    move = F.when(F.coalesce("low_confidence", F.lit(True)), identity).otherwise(F.coalesce("homography_to_prev", identity))
    row = F.struct(F.col(order).cast("long").alias("i"), move.alias("h"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, move)) - 1
    placed = motions.select(*keys, row.alias("_row"), F.floor(place / SPAN).alias("_span"))
    spans = placed.groupBy(*keys, "_span").agg(F.sort_array(F.collect_list("_row")).alias("_all"))

    def running(rows: str, start, carried):
        """The rows' places with the product carried to them: `carried` picks it from the products before and after a row."""
        empty = F.array().cast("array<struct<i:bigint,h:array<double>>>")

        def step(a, r):
            after = F.array(matrix_product(a["h"], r["h"]))
            return F.transform(after, lambda h: F.struct(h.alias("h"), F.array_append(a["done"], F.struct(r["i"].alias("i"), carried(a["h"], h).alias("h"))).alias("done")))[0]

        return F.aggregate(rows, F.struct(start.alias("h"), empty.alias("done")), step, lambda a: a["done"])

    product = F.aggregate("_all", identity, lambda a, r: matrix_product(a, r["h"]))
    videos = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_span").alias("i"), product.alias("h")))).alias("_spans"))
    before = videos.select(*keys, F.explode(running("_spans", identity, lambda old, new: old)).alias("_b"))
    before = before.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_b.i").alias("_at"), F.col("_b.h").alias("_carry"))
    met = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)), F.col("_span") == F.col("_at"))
    done = spans.join(before, met).select(*keys, F.explode(running("_all", F.col("_carry"), lambda old, new: new)).alias("_r"))
    return done.select(*keys, F.col("_r.i").alias(order), F.col("_r.h").alias("homography_to_ref"))
