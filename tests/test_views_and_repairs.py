"""Lookups, pages, repairs and failures of the queue, players, keypoints and pose files on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from snapframe.functions import scores
from snapframe.operators import features, joins, queueing, rollup, sequences, upsert
from snapframe.sources import readers, sinks

POINT = "struct<x: double, y: double, z: double, confidence: double>"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_a_failed_play_completes_its_video_only_if_it_was_the_last_one(spark):
    failed = frame(spark, [("a", "pose", 1, "no data"), ("b", "pose", 1, "no data"), ("c", "download", None, "gone"), ("d", "pose", 0, "x"), ("d", "download", None, "x")], "video_id string, stage_name string, play_index int, error string")
    stages = frame(spark, [("a", "pose", 1, "processing", None)], "video_id string, stage_name string, play_index int, status string, error string")
    plays = frame(spark, [("a", 0, "completed"), ("a", 1, "pending"), ("b", 0, "pending"), ("b", 1, "pending"), ("d", 0, "pending"), ("e", 0, "completed")], "video_id string, play_index int, status string")
    videos = frame(spark, [(v, "processing") for v in "abcde"], "video_id string, status string")
    s, p, v = queueing.settle_failures(failed, stages, plays, videos)
    assert {r.video_id: r.status for r in v.collect()} == {"a": "completed", "b": "processing", "c": "failed", "d": "failed", "e": "processing"}
    assert {(r.video_id, r.play_index): r.status for r in p.collect()}["b", 1] == "failed" and s.filter("status = 'failed'").count() == 5


def test_watchdog_repairs_both_cases(spark):
    videos = frame(spark, [("p", "pending"), ("q", "pending"), ("d", "downloaded"), ("r", "processing"), ("c", "completed"), ("f", "failed"), ("n", None)], "video_id string, status string")
    queue = frame(spark, [("q",), ("q",)], "video_id string")
    got = {r.video_id: (r.stage, r.priority, r.reason) for r in queueing.repairs(videos, queue).collect()}
    assert got == {"p": ("metadata", 7, "pending with no queue entry"), "d": ("download", 7, "orphaned (downloaded)"), "r": ("download", 7, "orphaned (processing)")}


def test_cleanup_and_its_dry_run(spark):
    now = datetime.datetime(2024, 1, 1, 12, tzinfo=datetime.UTC)
    ago = lambda minutes: now - datetime.timedelta(minutes=minutes)
    videos = frame(spark, [("old", "pending", ago(61)), ("new", "pending", ago(60)), ("done", "completed", ago(900)), ("odd", "pending", None)], "video_id string, status string, created_at timestamp")
    queue = frame(spark, [("old",), ("done",)], "video_id string")
    at = F.lit(now)
    plan, left, entries = queueing.cleanup(videos, queue, at, dry_run=True)
    assert [tuple(r) for r in plan.collect()] == [("old", 61.0, True, "would_delete")] and left.count() == 4 and entries.count() == 2
    plan, left, entries = queueing.cleanup(videos, queue, at)
    assert [r.action for r in plan.collect()] == ["deleted"] and {r[0] for r in left.collect()} == {"new", "done", "odd"} and {r[0] for r in entries.collect()} == {"done"}


def test_pages_hold_the_oldest(spark):
    jobs = frame(spark, [(i, "pending" if i % 2 else "done", 5 + i % 3, 100 - i) for i in range(20)], "id int, status string, priority int, created int")
    assert [r.id for r in queueing.with_status(jobs, "pending", "created", "id", 3).collect()] == [19, 17, 15]
    assert [r.id for r in queueing.by_priority(jobs, 5, "created", "id", 2).collect()] == [18, 15]


TRACKS = "v string, track_id int, play_index int, jersey_number string, jersey_confidence double, total_frames_tracked int, row_id int"


def test_players_list_their_instances_in_order_of_first_sight(spark):
    rows = [("v", 3, 6, "23", 0.85, 50, 1), ("v", 0, 2, "23", 0.9, 100, 0), ("v", 0, 3, "23", 0.5, 7, 2), ("v", 0, None, None, None, None, 3), ("v", 1, 2, "", 0.9, 5, 4)]
    got = {r.player_id: (r.jersey_number, r.total_frames_tracked, [tuple(i) for i in r.instances]) for r in rollup.player_instances(frame(spark, rows, TRACKS), ["v"]).collect()}
    assert got == {"jersey_23": ("23", 150, [(0, 2), (3, 6)]), "track_0_3": (None, 7, [(0, 3)]), "track_0_x": (None, 0, [(0, None)]), "track_1_2": (None, 5, [(1, 2)])}


def test_signals(spark):
    rows = [("still", i, 0.1, None if i == 0 else 0.0, None if i == 0 else 0.2) for i in range(3)] + [("fine", i, 0.1 * (i + 1), None if i == 0 else 10.0, None if i == 0 else 9.0) for i in range(3)] + [("one", 0, 0.5, None, None)]
    got = {r.k: (r.reasons, r.flagged, r.confidence) for r in rollup.frame_signals(frame(spark, rows, "k string, i int, e double, d double, m double"), ["k"], "e", "d", "m").collect()}
    assert got["still"] == (["low_edge_density_variance", "suspiciously_static"], True, "medium")
    assert got["fine"] == ([], False, "low") and got["one"] == (["not_enough_readable_frames"], False, "unknown")
    flags = frame(spark, [({"a": False, "b": True},), ({"a": None},), (None,)], "s map<string,boolean>")
    assert [r[0] for r in flags.select(rollup.any_signal(F.col("s"))).collect()] == [True, False, False]


def test_keypoints_are_smoothed_over_neighbouring_rows_only(spark):
    rows = [("v", f, None if m is None else {k: (x, 0.0, 0.0, c) for k, (x, c) in m.items()}) for f, m in [(0, {"a": (0.0, 0.5), "b": (1.0, 0.9)}), (4, {"a": (3.0, 0.6)}), (9, {"a": (6.0, 0.7), "b": (5.0, 0.9)}), (10, {}), (11, None)]]
    got = {r.f: r.landmarks for r in sequences.smooth_keypoints(frame(spark, rows, f"v string, f int, landmarks map<string,{POINT}>"), ["v"], "f").collect()}
    assert [got[f]["a"]["x"] for f in (0, 4, 9)] == [1.5, 3.0, 4.5] and got[0]["b"]["x"] == 1.0 and got[9]["b"]["x"] == 5.0
    assert got[4]["a"]["confidence"] == 0.6 and set(got[4]) == {"a"} and got[10] == {} and got[11] == {}


def test_pose_files_are_written_and_read_back(spark, tmp_path):
    rows = [(i, i / 15, {"nose": (0.1 * i, 0.2, 0.0, 0.9)}) for i in (3, 4, 120)]
    sinks.write_pose_files(frame(spark, rows, f"frame_index int, timestamp double, landmarks map<string,{POINT}>"), f"{tmp_path}/pose")
    got = {r.frame_index: (r.timestamp, r.landmarks["nose"]["x"]) for r in readers.pose_files(spark, f"{tmp_path}/pose/*/*.txt").collect()}
    assert got == {i: (pytest.approx(i / 15), pytest.approx(0.1 * i)) for i in (3, 4, 120)}


def test_reps_are_found_by_exact_keys(spark):
    reps = frame(spark, [("v", 0, None, None, 9), ("v", 0, 1, None, 5), ("v", 0, 1, None, 3), ("v", 0, 1, 2, 7)], "video_id string, rep_index int, track_id int, play_index int, start_frame int")
    wanted = frame(spark, [("v", 0, None, None), ("v", 0, 1, None), ("v", 0, 1, 2), ("v", 0, None, 2)], "video_id string, rep_index int, track_id int, play_index int")
    assert {(r.track_id, r.play_index): r.start_frame for r in joins.find_reps(wanted, reps).collect()} == {(None, None): 9, (1, None): 3, (1, 2): 7, (None, 2): None}


def test_nested_stages_and_set_columns(spark):
    roots = frame(spark, [("a",), ("b",)], "video_id string")
    stages = frame(spark, [("a", "pose", 2, "queued", 1), ("a", "pose", 2, "done", 2), ("a", "pose", None, "failed", 1)], "video_id string, stage_name string, play_index int, status string, attempt int")
    got = {r.video_id: {k: tuple(v) for k, v in r.stages.items()} for r in upsert.with_stages(roots, stages, "video_id", "attempt").collect()}
    assert got == {"a": {"pose": ("failed", 1), "pose_p0002": ("done", 2)}, "b": {}}
    base = frame(spark, [("a", None, "x"), ("a", 1, "x"), ("b", None, "x")], "k string, p int, s string")
    chosen = frame(spark, [("a", None), ("a", None)], "k string, p int")
    assert sorted((r.k, r.p or 0, r.s) for r in upsert.set_columns(base, chosen, ["k", "p"], {"s": F.lit("y")}).collect()) == [("a", 0, "y"), ("a", 1, "x"), ("b", 0, "x")]


def test_weights_of_features_that_no_rep_has_do_not_count(spark, monkeypatch):
    reps = frame(spark, [(0, {"f": 80.0}), (1, None)], "i int, features map<string,double>")
    traits = {"t": {"f": 0.25, "g": 0.75}}
    seen = scores.batch_features(reps, "features")
    assert {r.i: r.traits["t"] for r in features.score_reps(reps, ["i"], traits, seen).collect()} == {0: 80.0, 1: 0.0}
    assert {r.i: r.traits["t"] for r in features.score_reps(reps, ["i"], traits).collect()} == {0: 20.0, 1: 0.0}
    monkeypatch.setattr(scores, "MOST_FEATURES", 0)
    with pytest.raises(ValueError):
        scores.batch_features(reps, "features")


def test_track_summaries_and_best_traits(spark):
    rows = [("v", 1, f) for f in (3, 4, 9)] + [("v", 2, f) for f in (0, 20)]
    got = {r.t: tuple(r)[2:] for r in rollup.track_summary(frame(spark, rows, "v string, t int, f int"), ["v", "t"], "f").collect()}
    assert got == {1: (3, 9, 3, "lost"), 2: (0, 20, 2, "active")}
    best = rollup.top_traits(frame(spark, [("p", t, s) for t, s in (("b", 5.0), ("a", 5.0), ("c", 1.0), ("d", 9.0))], "p string, trait string, score double"), ["p"])
    assert [(r.trait, r["rank"]) for r in best.orderBy("rank").collect()] == [("d", 1), ("a", 2), ("b", 3)]
