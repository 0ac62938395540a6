"""Slotted range joins, exact quantiles, bucketed tables, and streams that equal their batches."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapframe.operators import audio, joins, rollup, tracking
from snapframe.plans import grading
from snapframe.sources.buckets import BucketTable
from snapframe.streaming.audio import Listener, Settings, whistle_stream
from snapframe.streaming.tracking import run_available, track_stream

POINT = "struct<x: double, y: double, z: double, confidence: double>"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ range join


def test_slots_cover_a_range_exactly(spark):
    rng = random.Random(1)
    spans = [(rng.randint(-50, 3000), rng.choice((0, 1, 7, 8, 63, 500, 2900))) for _ in range(60)] + [(5, -1), (0, 511), (-8, 7)]
    df = frame(spark, [(i, a, a + n) for i, (a, n) in enumerate(spans)] + [(900, None, 5), (901, 5, None)], "i int, a int, b int")
    got = {}
    for r in df.withColumn("s", F.explode(joins.slots_of_range(F.col("a"), F.col("b")))).select("i", "s.*").collect():
        got.setdefault(r.i, []).append((r.level, r.slot))
    for i, (a, n) in enumerate(spans):
        covered = [f for level, slot in got.get(i, []) for f in range(slot * 8**level, (slot + 1) * 8**level)]
        assert sorted(covered) == list(range(a, a + n + 1)) and len(got.get(i, [])) <= 14 * 5
    assert 900 not in got and 901 not in got


def test_frames_of_reps_equal_a_loop(spark):
    rng = random.Random(2)
    pick = lambda *v: rng.choice(v)
    reps = [(pick("v", "v", "w"), i, pick(None, 0, 1), pick(None, 1, 2), a := rng.randint(0, 400), a + pick(-3, 0, 5, 90, 700)) for i in range(40)]
    pose = [(pick("v", "v", "v", "w"), pick(None, 0, 1), pick(None, 1, 2), f, float(f)) for f in range(500)]
    found = joins.frames_of_reps(
        frame(spark, reps, "video_id string, rep_index int, play_index int, track_id int, start_frame int, end_frame int"), frame(spark, pose, "video_id string, play_index int, track_id int, frame_index int, value double")
    )
    want = sorted((r[1], p[3]) for r in reps for p in pose if r[0] == p[0] and r[4] <= p[3] <= r[5] and r[2] in (None, p[1]) and r[3] in (None, p[2]))
    assert sorted((r.rep_index, r.frame_index) for r in found.collect()) == want and len(want) > 300
    assert found.columns == ["video_id", "rep_index", "play_index", "track_id", "start_frame", "end_frame", "frame_index", "value"]


def test_no_pair_is_made_that_is_not_in_the_result(spark):
    reps = frame(spark, [("v", i, None, None, i * 40, i * 40 + 30) for i in range(50)], "video_id string, rep_index int, play_index int, track_id int, start_frame int, end_frame int")
    plan = joins.frames_of_reps(reps, frame(spark, [("v", 0, 1, 3)], "video_id string, play_index int, track_id int, frame_index int"))._jdf.queryExecution().executedPlan().toString()
    assert "BETWEEN" not in plan and "frame_index >= start_frame" not in plan and "NestedLoop" not in plan


def test_no_reps_no_frames(spark):
    reps = frame(spark, [], "video_id string, rep_index int, play_index int, track_id int, start_frame int, end_frame int")
    assert joins.frames_of_reps(reps, frame(spark, [("v", 0, 1, 3)], "video_id string, play_index int, track_id int, frame_index int")).count() == 0


# ------------------------------------------------------------------ quantiles, roll-ups


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=500).tolist(), "b": [1.0] * 70, "c": [*rng.random(40).tolist(), 1e12, -1e9], None: [3.0, 4.0], "one": [7.0]}
    rows = [(k, v, 1) for k, vs in groups.items() for v in vs] + [("a", None, 1), ("gone", None, 1), ("w", 1.0, 3), ("w", 2.0, 1)]
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in rollup.quantiles(frame(spark, rows, "k string, v double, c long"), ["k"], "v", "c", wanted, buckets=16).collect()}
    assert set(got) == {*groups, "w"}
    for k, vs in {**groups, "w": [1.0, 1.0, 1.0, 2.0]}.items():
        assert [got[k][n] for n in wanted] == pytest.approx([np.quantile(vs, q) for q in wanted.values()])


def test_a_missing_trait_counts_as_zero_in_every_figure(spark):
    rows = [("g", {"t": 4.0, "u": -2.0}), ("g", {"t": 6.0}), ("g", {}), ("h", None), ("n", {"t": None})]
    got = {(r.k, r.trait): tuple(r)[2:] for r in rollup.trait_summary(frame(spark, rows, "k string, traits map<string,double>"), ["k"], median=True).collect()}
    assert got["g", "t"] == (3, pytest.approx(10 / 3), 0.0, 6.0, 4.0) and got["g", "u"] == (3, pytest.approx(-2 / 3), -2.0, 0.0, 0.0)
    assert got["g", None][0] == 3 and got["h", None][0] == 1 and got["n", "t"] == (1, 0.0, 0.0, 0.0, 0.0)
    stats = {r.k: r for r in rollup.roll_up_with_stats(frame(spark, rows, "k string, traits map<string,double>"), ["k"], "median").collect()}
    assert stats["g"]["count"] == 3 and stats["g"].averages == {"t": 4.0, "u": 0.0} and stats["h"].averages == {}


# ------------------------------------------------------------------ bucketed tables


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    store = BucketTable(spark, f"{tmp_path}/t", "k string, t int, v double, n long", ["k"], ["t"], buckets=16)
    assert store.version() is None and store.read().count() == 0
    schema = "k string, t int, v double, n long"
    assert store.upsert(frame(spark, [(f"k{i}", None if i % 2 else 1, float(i), 1) for i in range(200)], schema), 1, "n")
    before = files(tmp_path / "t/data")
    assert store.upsert(frame(spark, [("k3", None, -1.0, 2), ("k3", None, -2.0, 3), ("new", 5, 9.0, 1)], schema), 2, "n")
    after = files(tmp_path / "t/data")
    assert {k: after[k] for k in before} == before and 1 <= len({p.split("/")[1] for p in set(after) - set(before)}) <= 2
    got = {(r.k, r.t): r.v for r in store.read().collect()}
    assert len(got) == 201 and got["k3", None] == -2.0 and got["new", 5] == 9.0 and got["k4", 1] == 4.0
    assert not store.upsert(frame(spark, [("k3", None, 7.0, 9)], schema), 2, "n") and store.version() == 2
    with pytest.raises(ValueError):
        store.upsert(frame(spark, [("k3", None)], "k string, t int"), 3, "n")


def test_a_crash_between_write_and_publish_changes_nothing(spark, tmp_path, monkeypatch):
    schema = "k string, v double, n long"
    store = BucketTable(spark, f"{tmp_path}/t", schema, ["k"], buckets=4)
    store.upsert(frame(spark, [("a", 1.0, 1), ("b", 2.0, 1)], schema), 1, "n")
    change = frame(spark, [("a", 5.0, 2), ("c", 3.0, 2)], schema)

    def crash(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_publish", crash)
        with pytest.raises(RuntimeError):
            store.upsert(change, 2, "n")
    assert sorted(tuple(r)[:2] for r in store.read().collect()) == [("a", 1.0), ("b", 2.0)] and store.version() == 1
    assert store.upsert(change, 2, "n") and sorted(tuple(r)[:2] for r in store.read().collect()) == [("a", 5.0), ("b", 2.0), ("c", 3.0)]
    assert store.upsert(change.limit(0), 3, "n") and store.version() == 3 and store.read().count() == 3


# ------------------------------------------------------------------ running analysis


def poses(track, play, frames, seed):
    rng = random.Random(seed)
    names = ("left_ankle", "right_ankle", "left_hip", "right_hip", "left_shoulder", "right_shoulder")
    point = lambda: (rng.random(), rng.random(), 0.0, rng.choice((0.1, 0.9)))
    return [("v", f, track, play, {n: point() for n in names if rng.random() < 0.9}) for f in frames]


def test_running_analysis_equals_the_whole_after_every_batch(spark, tmp_path):
    pose = poses(1, 0, range(0, 120, 2), 1) + poses(None, 0, range(1, 90, 2), 2) + poses(2, None, range(30, 60), 3)
    schema = f"video_id string, frame_index int, track_id int, play_index int, landmarks map<string,{POINT}>"
    reps = frame(spark, [("v", 0, 1, 0, 0, 60), ("v", 1, 1, 0, 60, 200), ("v", 0, None, 0, 10, 80), ("v", 0, 2, None, 0, 99), ("v", 5, 1, 0, 900, 950)], "video_id string, rep_index int, track_id int, play_index int, start_frame int, end_frame int")
    running = grading.RunningAnalysis(reps, f"{tmp_path}/states")
    key = lambda r: str((r.video_id, r.rep_index, r.track_id, r.play_index))
    for batch, (low, high) in enumerate([(0, 25), (25, 26), (26, 70), (70, 500)]):
        part = frame(spark, [p for p in pose if low <= p[1] < high], schema)
        running.update(part, batch)
        if batch == 2:
            running.update(part, batch)  # repeated after a crash
        want = {key(r): r for r in grading.analyse(reps, frame(spark, [p for p in pose if p[1] < high], schema)).collect()}
        got = {key(r): r for r in running.current().collect()}
        assert set(got) == set(want) and len(got) == 5
        for k in want:
            assert got[k].traits == pytest.approx(want[k].traits) and got[k].overall_grade == pytest.approx(want[k].overall_grade)


# ------------------------------------------------------------------ streams

DETECTIONS = "video_id string, play_index int, frame_index int, detection_index int, bbox array<double>, look array<double>, at timestamp"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def detections(frames, play=0, seconds=0.0):
    return [
        ("v", play, f, d, [100.0 * d + f, 0.0, 100.0 * d + f + 20, 40.0], [1.0, float(d)], START + datetime.timedelta(seconds=seconds + f / 15)) for f in frames for d in range(3) if not (d == 2 and 5 <= f < 25)
    ]


def streamed(spark, tmp_path, **limits):
    source = spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = []
    run_available(track_stream(source, **limits), lambda batch, _: got.extend(tuple(r) for r in batch.collect()), f"{tmp_path}/cp")
    return got


def give(spark, tmp_path, n, rows):
    frame(spark, rows, DETECTIONS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")


def test_tracking_stream_equals_batch_across_a_restart(spark, tmp_path):
    rows = detections(range(12))
    want = sorted((r.frame_index, r.detection_index, r.track_id) for r in tracking.track(frame(spark, rows, DETECTIONS), ["video_id", "play_index"]).collect())
    give(spark, tmp_path, 0, detections(range(4)))
    got = streamed(spark, tmp_path)
    give(spark, tmp_path, 1, detections(range(4, 8)))
    give(spark, tmp_path, 2, detections(range(8, 12)))
    got += streamed(spark, tmp_path)
    assert sorted(r[2:] for r in got) == want


def test_a_silent_play_is_dropped_after_its_timeout(spark, tmp_path):
    give(spark, tmp_path, 0, detections(range(3)))
    give(spark, tmp_path, 1, detections(range(3), play=1, seconds=500))
    give(spark, tmp_path, 2, detections(range(3, 5), play=1, seconds=500))
    got = streamed(spark, tmp_path, timeout_seconds=60.0, lateness="1 second")
    give(spark, tmp_path, 3, [(*r[:6], r[6] + datetime.timedelta(seconds=500)) for r in detections(range(40, 42))])  # play 0 again, long after
    got += streamed(spark, tmp_path, timeout_seconds=60.0, lateness="1 second")
    ids = {(r[1], r[2]): r[4] for r in sorted(got) if r[3] == 1}
    assert ids[0, 2] == ids[1, 4] == 1 and ids[0, 40] == 1  # a new play's tracks count from 0 again
    assert len({r[4] for r in got if r[1] == 0 and r[2] == 40}) == 3 and max(r[4] for r in got) == 2


SETTINGS = Settings(4, 8.0, 0.3, 2.0, 1.0, 60_000)


@pytest.mark.parametrize("seed", range(5))
def test_any_cutting_of_a_recording_gives_the_same_whistles(seed):
    rng = np.random.default_rng(seed)
    loud = np.repeat(rng.random(60) < 0.4, rng.integers(1, 20))
    index, value = np.arange(len(loud)), np.where(loud, rng.random(len(loud)) * 2, 0.1)
    keep = rng.random(len(loud)) < 0.99  # lost samples
    index, value = index[keep], value[keep]

    def heard(cuts):
        listener, found = Listener(SETTINGS), []
        for a, b in zip([0, *cuts], [*cuts, len(index)], strict=True):
            listener = Listener(SETTINGS, listener.state())
            listener.hear(index[a:b], value[a:b])
            found += listener.out
        listener.out = []
        listener.finish()
        return [tuple(round(x, 9) for x in e) for e in found + listener.out]

    whole = heard([])
    assert len(whole) > 0 and all(heard(sorted(rng.integers(0, len(index), k).tolist())) == whole for k in (1, 2, 7, 40))


def test_whistle_stream_equals_the_whole_table(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(k, i, float(v), START + datetime.timedelta(seconds=i / 8)) for k in ("a", "b") for i, v in enumerate(np.where(np.repeat(rng.random(50) < 0.4, 6), rng.random(300) * 2, 0.1))]
    schema = "video_id string, i long, v double, at timestamp"
    whole = frame(spark, rows, schema)
    want = sorted(tuple(r) for r in audio.whistles(whole, ["video_id"], "i", "v", 4, 8.0, 0.3, 2.0, 1.0).collect())
    for n, (low, high) in enumerate([(0, 33), (33, 34), (34, 250), (250, 301)]):
        part = [r for r in rows if low <= r[1] < high] + ([(k, 300, None, START + datetime.timedelta(seconds=38)) for k in ("a", "b")] if high == 301 else [])
        frame(spark, part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = []
    run_available(whistle_stream(source, ["video_id"], "i", "v", 4, 8.0, 0.3, 2.0, 1.0), lambda batch, _: got.extend(tuple(r) for r in batch.collect()), f"{tmp_path}/cp")
    assert len(want) > 3 and sorted(got) == [pytest.approx(r) for r in want]
