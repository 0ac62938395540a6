"""One-to-one matching by rounds, tracking by pieces, outlines snapped to lines: each against a plain loop."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from snapframe.operators import field, joins, piles, sequences, tracking


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def greedy(pairs):
    taken, out = set(), []
    for key, a, b in pairs:
        if not {(key, "a", a), (key, "b", b)} & taken:
            taken |= {(key, "a", a), (key, "b", b)}
            out.append((key, a, b))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_of_best_pairs_equal_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    rows = list({(rng.choice("xxy"), rng.randrange(30), rng.randrange(30)): float(rng.randrange(6)) for _ in range(400)}.items())
    rows = [(*k, v) for k, v in rows]
    found = joins.match_greedily(frame(spark, rows, "k string, a int, b int, v double"), ["k"], "a", "b", ["v", "a", "b"], [False, True, True])
    want = greedy((k, a, b) for k, a, b, v in sorted(rows, key=lambda r: (-r[3], r[1], r[2])))
    assert sorted((r.k, r.a, r.b) for r in found.collect()) == want and found.columns == ["k", "a", "b", "v"]


def test_a_chain_in_which_each_pair_waits_for_the_one_before(spark):
    rows = [("k", i, j, float(2 * i + j)) for i in range(12) for j in (i, i + 1)]
    found = joins.match_greedily(frame(spark, rows, "k string, a int, b int, v double"), ["k"], "a", "b", ["v"], [True])
    assert sorted((r.a, r.b) for r in found.collect()) == [(i, i) for i in range(12)]
    empty = frame(spark, rows, "k string, a int, b int, v double").limit(0)
    assert joins.match_greedily(empty, ["k"], "a", "b", ["v"], [True]).count() == 0


DETECTIONS = "video_id string, play_index int, frame_index int, detection_index int, bbox array<double>, look array<double>"


def walkers(rng, frames):
    """Boxes that drift, with two pauses longer than any track outlives and one shorter."""
    rows = []
    for f in frames:
        at = f + (f >= 20) * 60 + (f >= 35) * 30 + (f >= 50) * 200
        rows += [("v", 0, at, d, [60.0 * d + 2 * f, 0.0, 60.0 * d + 2 * f + 25, 40.0], [1.0, float(d), rng.random()]) for d in range(4) if rng.random() < 0.8]
    return rows


def test_pieces_of_a_play_equal_the_whole(spark):
    rows = walkers(random.Random(4), range(70))
    want = tracking.follow(tracking.TrackerState(), pd.DataFrame(rows, columns=["video_id", "play_index", "frame_index", "detection_index", "bbox", "look"]))
    want = sorted(zip(want["frame_index"], want["detection_index"], want["track_id"], strict=True))
    found = tracking.track(frame(spark, rows, DETECTIONS).repartition(3), ["video_id", "play_index"])
    assert sorted((r.frame_index, r.detection_index, r.track_id) for r in found.collect()) == want
    assert len({t for _, _, t in want}) > 8 and found.columns == [*pd.Index(["video_id", "play_index", "frame_index", "detection_index", "bbox", "look"]), "track_id"]


def test_frames_without_detections_age_tracks(spark):
    box = lambda at: ("v", None, at, 0, [0.0, 0.0, 20.0, 40.0], [1.0, 0.0])
    ids = lambda *at: [r.track_id for r in tracking.track(frame(spark, [box(a) for a in at], DETECTIONS), ["video_id", "play_index"]).orderBy("frame_index").collect()]
    assert ids(0, 11) == [0, 0] and ids(0, 12) == [0, 1]
    assert ids(0, 100, 101) == [0, 1, 1]


def snapped(corners, lines, band, turn=20.0):
    moves, n = [None] * len(corners), len(corners)
    for i, p in enumerate(np.array(corners, float)):
        e = np.array(corners[(i + 1) % n], float) - p
        size = np.linalg.norm(e)
        if size < 1e-6:
            continue
        d, offs = e / size, []
        for x1, y1, x2, y2 in lines:
            v = np.array([x2 - x1, y2 - y1], float)
            if np.linalg.norm(v) < 1e-6 or abs(d @ v) / np.linalg.norm(v) < math.cos(math.radians(turn)):
                continue
            m = np.array([(x1 + x2) / 2, (y1 + y2) / 2]) - p
            if 0 <= m @ d <= size and abs(m @ np.array([-d[1], d[0]])) <= band:
                offs.append(m @ np.array([-d[1], d[0]]))
        if offs and np.std(offs) <= band / 2:
            moves[i] = np.array([-d[1], d[0]]) * np.mean(offs)
    out = []
    for i, p in enumerate(np.array(corners, float)):
        own = [m for m in (moves[i], moves[i - 1]) if m is not None]
        out.append(tuple(int(c) for c in p + (np.mean(own, axis=0) if own else 0)))
    return out


def test_outlines_snap_as_a_loop_does(spark):
    rng = random.Random(6)
    corners = {"a": [(10, 10), (200, 12), (190, 100), (15, 95)], "b": [(0, 0), (0, 0), (100, 5), (50, 90)], "c": [(5, 5), (90, 5), (50, 60)]}
    lines = {k: [(x := rng.uniform(0, 200), y := rng.uniform(0, 110), x + rng.uniform(-40, 40), y + rng.choice((0.5, 2, 30))) for _ in range(40)] for k in "ab"}
    lines["a"] += [(20, 14, 180, 16), (30, 13, 170, 15), (5.0, 5.0, 5.0, 5.0)]
    c = frame(spark, [(k, i, float(x), float(y)) for k, p in corners.items() for i, (x, y) in enumerate(p)], "k string, corner int, x double, y double")
    drawn = frame(spark, [(k, *map(float, v)) for k, vs in lines.items() for v in vs], "k string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.k, r.corner): (r.x, r.y) for r in field.snap_to_lines(c, drawn, ["k"], band=22.0).collect()}
    want = {(k, i): p for k in corners for i, p in enumerate(snapped(corners[k], lines.get(k, []), 22.0))}
    assert got == want and got["c", 0] == (5, 5) and any(got["a", i] != corners["a"][i] for i in range(4))


def test_piles_meet_over_cells_of_their_own_frame(spark):
    rng = random.Random(7)
    rows = []
    for f, width in enumerate((4.0, 40.0, 4.0)):
        for i in range(30):
            x, y = (rng.uniform(0, 40), rng.uniform(0, 40)) if i < 9 + f else (rng.uniform(-3000, 3000), rng.uniform(-3000, 3000))
            rows.append((f, i, [x, y, x + width, y + 10]))
    got = {}
    for r in piles.piles(frame(spark, rows, "frame int, track_id int, bbox array<double>"), ["frame"]).collect():
        got.setdefault(r.frame, set()).add(r.track_id)
    for f, width in enumerate((4.0, 40.0, 4.0)):
        c = {i: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for g, i, b in rows if g == f}
        near = {i: {j for j in c if math.dist(c[i], c[j]) <= 8 * width} for i in c}
        best = min(near, key=lambda i: (-len(near[i]), i))
        assert got.get(f, set()) == (near[best] if len(near[best]) >= 6 else set())


@pytest.mark.parametrize("inclusive,whole", [(False, True), (True, True), (False, False)])
def test_long_chains_are_thinned_as_by_a_fold(spark, monkeypatch, inclusive, whole):
    monkeypatch.setattr(sequences, "LONG_CHAIN", 50)
    monkeypatch.setattr(sequences, "CELL", 8)
    rng = random.Random(3)
    rows = []
    for key in ("a", None, "b"):
        at = rng.randint(-500, 500)
        for _ in range(700 if key != "b" else 30):
            at += rng.choice((0, 1, 1, 2, 3, 5, 5, 40 if rng.random() < 0.02 else 4))
            rows.append((key, at if whole else at / 4))
    gap = 5 if whole else 1.25
    want = []
    for key in ("a", None, "b"):
        last = None
        for v in sorted({v for k, v in rows if k == key}):
            if last is None or (v - last >= gap if inclusive else v - last > gap):
                want.append((key, v))
                last = v
    df = frame(spark, rows, f"k string, at {'long' if whole else 'double'}")
    found = sequences.thin(df.repartition(3), ["k"], "at", gap, inclusive)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
