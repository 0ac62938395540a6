"""Operators on small fixtures, against plain loops."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapframe.functions import geometry, scores, text
from snapframe.operators import audio, features, joins, piles, queueing, rollup, sequences, tracking, upsert
from snapframe.plans import grading
from snapframe.plans.config import Configs, deep_merge, merge_all
from snapframe.sources import readers, schemas, sinks

POINT = schemas.POINT


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ scores


@pytest.mark.parametrize("score,bucket,band", [(59.9, "poor", "average"), (60, "below_average", "average"), (89, "high", "high"), (89.5, "high", "average"), (90, "elite", "elite"), (100, "elite", "elite")])
def test_bucket_edges(spark, score, bucket, band):
    c = F.lit(float(score))
    assert one(spark, scores.bucket(c)) == bucket and one(spark, scores.band(c)) == band


def test_missing_feature_policies(spark):
    f = F.create_map(F.lit("a"), F.lit(80.0))
    w = {"a": 0.5, "b": 0.5}
    assert one(spark, scores.weighted_score(f, w)) == 40
    assert one(spark, scores.present_score(f, w)) == 80
    assert one(spark, scores.neutral_score(f, w)) == 40.25
    empty = F.create_map().cast("map<string,double>")
    assert one(spark, scores.weighted_score(empty, w)) == 0 and one(spark, scores.present_score(empty, w)) == 50 and one(spark, scores.neutral_score(empty, w)) == 0.5
    assert one(spark, scores.composite(empty, w)) == 50 and one(spark, scores.rank_score(F.lit(0), F.lit(0))) == 50


def test_roll_up_counts_a_missing_trait_as_zero(spark):
    df = frame(spark, [("g", {"a": 50.0, "b": 60.0}), ("g", {"a": 70.0, "b": 80.0}), ("g", {"a": 60.0})], "g string, traits map<string,double>")
    for method, want in (("mean", (60, 140 / 3)), ("median", (60, 60)), ("max", (70, 80)), ("min", (50, 0)), ("weighted", (60, 140 / 3))):
        got = rollup.roll_up(df, ["g"], method).first().traits
        assert got["a"] == pytest.approx(want[0]) and got["b"] == pytest.approx(want[1])


def test_players_merge_only_by_sure_jerseys(spark):
    rows = [(0, 2, "23", 0.9, 100, 0), (3, 6, "23", 0.85, 50, 1), (4, 6, "23", 0.5, 7, 2), (5, None, None, None, None, 3), (5, 1, None, None, 1, 4)]
    found = {r.player_id: (r.frames, r.instances) for r in rollup.players(frame(spark, rows, "track_id int, play_index int, jersey_number string, jersey_confidence double, total_frames_tracked int, row_id int"), []).collect()}
    assert found == {"jersey_23": (150, 2), "track_4_6": (7, 1), "track_5_x": (0, 1), "track_5_1": (1, 1)}


# ------------------------------------------------------------------ sequences


def series(spark, values, kind="double"):
    return frame(spark, [("k", i, v) for i, v in enumerate(values)], f"k string, i int, v {kind}")


def loop_static(flags, gap, least, most):
    out, start, run = [], 0, 0
    for i, s in enumerate(flags):
        run = run + 1 if s else 0
        if s and run % gap == 0:
            if i - start >= least and start < i - gap:
                out.append((start, i - gap))
            start = i
    n = len(flags)
    if n and n - 1 - start >= least:
        out.append((start, n - 1))
    return [(a, b) for a, b in out if least <= b - a + 1 <= most]


def loop_bursts(values, calm, burst, streak, cooldown):
    out, run, since = [], 0, cooldown
    for i, v in enumerate(values):
        since += 1
        if v is None:
            continue
        if v <= calm:
            run += 1
            continue
        if v >= burst and run >= streak and since >= cooldown:
            out.append(i)
            since = 0
        run = 0
    return out


def test_sequence_operators_equal_loops(spark):
    rng = random.Random(7)
    flags, motion = [], []
    for k in range(60):
        n = rng.randint(1, 60)
        flags.append([rng.random() < 0.8 for _ in range(n)])
        motion.append([None if rng.random() < 0.1 else rng.choice([0.05, 0.1, 0.3, 0.9, 0.95]) for _ in range(n)])
    rows = [(k, i, f, v) for k in range(60) for i, (f, v) in enumerate(zip(flags[k], motion[k], strict=True))]
    df = frame(spark, rows, "k int, i int, s boolean, v double").cache()
    got = {k: [] for k in range(60)}
    for r in sequences.static_segments(df, ["k"], "i", "s", gap=4, least=3).collect():
        got[r.k].append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: loop_static(flags[k], 4, 3, 300) for k in range(60)}
    got = {k: [] for k in range(60)}
    for r in sequences.bursts(df, ["k"], "i", "v", streak=2, cooldown=5).collect():
        got[r.k].append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {k: loop_bursts(motion[k], 0.15, 0.8, 2, 5) for k in range(60)}


def test_thinning_chain_keeps_by_last_kept(spark):
    df = frame(spark, [("k", x) for x in (0.0, 4.0, 8.0, 8.0)], "k string, at double")
    assert sorted(r["at"] for r in sequences.thin(df, ["k"], "at", 5.0).collect()) == [0, 8]
    both = sequences.merge_candidates([df, frame(spark, [("k", 6.0)], "k string, at double")], ["k"], "at", 5.0)
    assert sorted(r["at"] for r in both.collect()) == [0, 6]


def test_debounce_lets_a_confirmed_null_reset(spark):
    df = series(spark, ["a", "a", None, None, "a", "a", "b", "a"], "string")
    assert [r.i for r in sequences.debounce(df, ["k"], "i", "v").orderBy("i").collect()] == [1, 5]


def test_replays_going_back_are_rejected_and_unread_clocks_stay(spark):
    df = frame(spark, [("k", 0, 1, 600), ("k", 1, 1, 500), ("k", 2, 1, 550), ("k", 3, None, None), ("k", 4, 2, 900), ("k", 5, 1, 10)], "k string, i int, q int, s int")
    assert [r.i for r in sequences.reject_replays(df, ["k"], "i", "q", "s").orderBy("i").collect()] == [0, 1, 3, 4]


def test_ranges_cover_everything(spark):
    points = frame(spark, [("k", 10), ("k", 50)], "k string, at int")
    lasts = frame(spark, [("k", 99), ("m", 7)], "k string, last int")
    got = [(r.k, r.start, r.end) for r in sequences.ranges(points, lasts, ["k"], "at").orderBy("k", "start").collect()]
    assert got == [("k", 0, 49), ("k", 50, 99), ("m", 0, 7)]


def test_sampling(spark):
    df = series(spark, [1.0] * 150)
    assert sequences.sample_stride(df, ["k"], "i", 15, 1).count() == 10
    assert sorted(r.i for r in sequences.sample_evenly(df, ["k"], "i", 4).collect()) == [0, 37, 75, 112]
    assert sequences.sample_evenly(df.limit(3), ["k"], "i", 4).count() == 3


# ------------------------------------------------------------------ geometry, text


def test_geometry(spark):
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, geometry.iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(25 / 175)
    assert one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, geometry.area(F.array(F.lit(1.0)))) == 0
    t = np.radians(2)
    h = F.array(*(F.lit(float(x)) for x in (np.cos(t), -np.sin(t), 15, np.sin(t), np.cos(t), -8, 0, 0, 1)))
    m = one(spark, geometry.motion(h))
    assert (m.tx, m.ty) == (15, -8) and m.rotation_deg == pytest.approx(2) and m.scale == pytest.approx(1)
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    assert one(spark, geometry.inside_polygon(F.lit(5.0), F.lit(5.0), square)) and not one(spark, geometry.inside_polygon(F.lit(15.0), F.lit(5.0), square))


def keypoints(**points):
    return {k: (float(x), float(y), 0.0, float(c)) for k, (x, y, c) in points.items()}


def test_keypoint_maps(spark):
    a = keypoints(left_hip=(0.4, 0.5, 0.9), right_hip=(0.6, 0.5, 0.3), nose=(0.5, 0.2, 0.3))
    b = keypoints(left_hip=(0.4, 0.6, 0.9), right_hip=(0.6, 0.5, 0.29), nose=(0.5, 0.2, 0.3))
    df = frame(spark, [(a, b)], f"a map<string,{POINT}>, b map<string,{POINT}>")
    r = df.select(
        geometry.displacement(F.col("a"), F.col("b")).alias("d"), geometry.torso_centre(F.col("a")).alias("c"), geometry.keypoint_box(F.col("a")).alias("box"), geometry.keypoint_box(F.col("b")).alias("none"),
        geometry.denormalised(F.col("a"), F.lit(101), F.lit(50))["nose"].alias("n"), geometry.torso_box(F.col("a"), F.lit(640), F.lit(480)).alias("t"),
    ).first()
    assert r.d == pytest.approx(0.05) and (r.c.x, r.c.y) == (0.4, 0.5) and r.box == [0.4, 0.2, 0.6, 0.5] and r.none is None and (r.n.x, r.n.y) == (50, 10) and r.t is None


def test_text(spark):
    assert one(spark, text.down_and_distance(F.lit("xx 3RD &  7 yy"))) == "3rd &  7"
    assert tuple(one(spark, text.game_clock(F.lit("lst 12:05")))) == (1, 725)
    assert one(spark, text.game_clock(F.lit("2nd 25:00"))) is None
    for address, want in (("https://www.video.example/watch?v=abcdefghijk&t=1", "abcdefghijk"), ("https://youtu.be/abcdefghijk", "abcdefghijk"), ("abcdefghijk", "abcdefghijk"), ("nothing", None)):
        assert one(spark, text.video_id(F.lit(address))) == want
    sides = one(spark, text.teams(F.lit("Alabama vs. Ohio St | 2023")))
    assert (sides.team1, sides.team2) == ("Alabama", "Ohio State")
    assert one(spark, text.level(F.lit("A program"))) == "nfl" and one(spark, text.level(F.lit("x"))) == "college"
    assert one(spark, text.row_key("frame", F.lit(7), F.lit(3))) == "frame_000007_p0003"
    assert one(spark, text.is_safe_path(F.lit("a/../b"))) is False
    assert one(spark, text.is_accepted_source(F.lit("https://m.site.example/x.MP4"), (), (".mp4",))) is True


# ------------------------------------------------------------------ joins, changes


def test_analysis_falls_back_on_the_rep_index_alone(spark):
    reps = frame(spark, [("v", 0, 1, 0, 10, 20, 1.0), ("v", 0, None, None, 5, 9, 2.0), ("v", 3, 2, 1, 30, 40, 3.0)], "video_id string, rep_index int, track_id int, play_index int, start_frame int, end_frame int, duration_seconds double")
    analysis = frame(spark, [("v", 0, 1, 0), ("v", 0, None, None), ("v", 3, None, None), ("v", 3, 9, 1)], "video_id string, rep_index int, track_id int, play_index int")
    got = sorted((r.rep_index, r.track_id, r.start_frame) for r in joins.join_analysis(analysis, reps).collect() if r.start_frame is not None)
    assert got == [(0, 0, 5), (0, 1, 10), (3, 0, 30)]


def test_null_on_the_rep_side_is_no_filter(spark):
    reps = frame(spark, [("v", 0, None, None, 0, 2), ("v", 1, 1, None, 0, 2), ("v", 2, 1, 5, 0, 2)], "video_id string, rep_index int, track_id int, play_index int, start_frame int, end_frame int")
    pose = frame(spark, [("v", i, t, p) for i in range(4) for t, p in ((1, 5), (1, None), (2, 5))], "video_id string, frame_index int, track_id int, play_index int")
    got = {r.rep_index: r["count"] for r in joins.frames_of_reps(reps, pose).groupBy("rep_index").count().collect()}
    assert got == {0: 9, 1: 6, 2: 3}


def test_box_and_time_matching(spark):
    box = lambda x: [float(x), 0.0, float(x) + 10, 10.0]
    poses = frame(spark, [(0, 0, box(0)), (0, 1, box(1)), (0, 2, box(100))], "f int, pose_id int, bbox array<double>")
    tracks = frame(spark, [(0, 5, box(1)), (0, 9, box(4))], "f int, track_id int, bbox array<double>")
    assert sorted((r.pose_id, r.track_id) for r in joins.match_boxes(poses, tracks, ["f"]).collect()) == [(0, 9), (1, 5)]
    c = frame(spark, [("v", x) for x in (1.0, 4.0, 20.0)], "v string, at double")
    t = frame(spark, [("v", x) for x in (3.0, 5.0, 40.0)], "v string, at double")
    m = joins.match_times(c, t, ["v"], 5.0)
    assert sorted((r.candidate, r.truth) for r in m.collect()) == [(1, 3), (4, 5)]
    q = rollup.detection_quality(c, t, m, ["v"]).first()
    assert (q.recall, q.precision, q.missed, q.false_positives) == (2 / 3, 2 / 3, 1, 1)


def test_upsert_treats_null_keys_as_equal(spark):
    base = frame(spark, [("v", None, 1, "x"), ("v", 2, 2, "y")], "k string, t int, a int, b string")
    out = upsert.upsert(base, frame(spark, [("v", None, 10), ("w", None, 3)], "k string, t int, a int"), ["k"], ["t"])
    assert sorted(map(tuple, out.collect()), key=str) == [("v", 2, 2, "y"), ("v", None, 10, "x"), ("w", None, 3, None)]
    m = one(spark, upsert.merge_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))))
    assert m == {"a": 2, "b": 3}


def test_queue_rules(spark):
    assert one(spark, queueing.next_stage(F.lit("pose"))) == "torso_crop" and one(spark, queueing.next_stage(F.lit("complete"))) is None
    assert tuple(one(spark, queueing.after_failure(F.lit(2), F.lit(3)))) == ("failed", 3)
    rows = [(1, "v", None, "pose", 5, 2), (2, "v", None, "download", 1, 3), (3, "w", 0, "pose", 5, 1), (4, "w", 1, "pose", 9, 4)]
    q = frame(spark, rows, "id int, video string, play int, stage string, priority int, created int").withColumn("rank", queueing.stage_rank(F.col("stage")))
    assert [r.id for r in queueing.pick_next(q, ["video", "play"], "rank", "priority", "created", "id", 3).collect()] == [4, 3, 2]


# ------------------------------------------------------------------ features, grading


def pose_rows(n, move, track=1, play=0):
    out = []
    for i in range(n):
        y = 0.5 + (0.03 * (i % 2) if move else 0)
        points = keypoints(left_ankle=(0.4, y, 0.9), right_ankle=(0.6, y, 0.9), left_hip=(0.45, 0.5, 0.9), right_hip=(0.55, 0.5, 0.9), left_shoulder=(0.45, 0.3, 0.9), right_shoulder=(0.55, 0.3, 0.9))
        out.append(("v", i * 2, track, play, points))
    return out


POSE = f"video_id string, frame_index int, track_id int, play_index int, landmarks map<string,{POINT}>"


def test_features_of_still_and_moving_reps(spark):
    df = frame(spark, pose_rows(20, False, 1) + pose_rows(20, True, 2) + pose_rows(1, False, 3), POSE)
    got = {r.track_id: r.features for r in features.rep_features(df, ["track_id"]).collect()}
    assert got[1]["linear_speed"] < 5 and got[1]["core_stability"] > 90
    assert got[2]["linear_speed"] == pytest.approx(20) and got[3]["linear_speed"] == 0
    assert all(0 <= x <= 100 for f in got.values() for x in f.values()) and len(got[1]) == 15


def test_an_empty_rep_scores_zero_and_leaves_others_alone(spark):
    pose = frame(spark, pose_rows(40, True), POSE)
    reps = frame(spark, [("v", 0, 1, 0, 0, 78), ("v", 1, 1, 0, 500, 600)], "video_id string, rep_index int, track_id int, play_index int, start_frame int, end_frame int")
    alone = grading.analyse(reps.filter("rep_index = 0"), pose).first()
    both = {r.rep_index: r for r in grading.analyse(reps, pose).collect()}
    assert both[1].overall_grade == 0 and set(both[1].buckets.values()) == {"poor"}
    assert both[0].traits == alone.traits and both[0].overall_grade > 0
    assert grading.grade_videos(grading.analyse(reps, pose)).first().grade == pytest.approx(both[0].overall_grade / 2)


def test_reps_use_real_frame_numbers(spark):
    found = grading.provisional(frame(spark, pose_rows(40, False) + pose_rows(10, False, 2, None), POSE))
    assert sorted((r.track_id, r.play_index, r.rep_index) for r in found.fillna(-1, ["play_index"]).collect()) == [(1, 0, 0), (2, -1, 0)]
    reps = {r.track_id: (r.start_frame, r.end_frame) for r in grading.extract_reps(frame(spark, pose_rows(40, False) + pose_rows(10, False, 2, None), POSE)).collect()}
    assert reps == {1: (0, 78), 2: (0, 18)}


def test_play_boundaries(spark):
    camera = frame(spark, [("v", i, 30.0 if i in (100, 110, 300) else 0.0, 0.0, 0.0, False) for i in range(0, 400, 10)], "video_id string, frame_index int, translation_x double, translation_y double, rotation_deg double, low_confidence boolean")
    reads = frame(spark, [("v", i, d, 1, s) for i, d, s in ((150, "1st & 10", 700), (165, "1st & 10", 690), (200, "2nd & 5", 650), (215, "2nd & 5", 640))], "video_id string, frame_index int, down_distance string, quarter int, seconds int")
    lasts = frame(spark, [("v", 399)], "video_id string, last int")
    got = [(r.start, r.end) for r in grading.play_boundaries(camera, reads, lasts).orderBy("play_index").collect()]
    assert got == [(0, 214), (215, 299), (300, 399)]


# ------------------------------------------------------------------ piles, audio, tracking


def test_one_snap_from_a_calm_pile(spark):
    rng = random.Random(1)
    rows = []
    for f in range(55):
        for t in range(8):
            step = 0 if f < 30 else 12 * min(f - 29, 5)
            x = 100 + 14 * t + rng.random() + (step if t % 2 else -step) * 1.0
            rows.append(("v", f, t, [x, 50.0, x + 10, 70.0]))
    boxes = frame(spark, rows, "video_id string, frame int, track_id int, bbox array<double>")
    pile = piles.piles(boxes, ["video_id", "frame"], reach=40.0)
    motion = piles.pile_motion(pile, ["video_id"], "frame")
    snaps = [r.frame for r in sequences.bursts(motion, ["video_id"], "frame", "motion", calm=0.3).collect()]
    assert len(snaps) == 1 and 28 <= snaps[0] <= 32


def test_snap_pipelines(spark):
    rng = random.Random(1)
    rows = []
    for f in range(55):
        for t in range(8):
            x = 100 + 4 * t + rng.random() * 0.5 + 12 * max(0, min(f - 29, 5))
            rows.append(("v", f, t, [x, 50.0, x + 10, 70.0]))
    rows += [("w", f, t, [4.0 * t, 0.0, 4.0 * t + 10, 20.0]) for f in range(9) for t in range(8)]
    boxes = frame(spark, rows, "video_id string, frame int, track_id int, bbox array<double>")
    for found in (piles.snaps_of_tracks(boxes, ["video_id"], "frame"), piles.snaps_of_detections(boxes, ["video_id"], "frame", "track_id")):
        assert [(r.video_id, 28 <= r.frame <= 32) for r in found.collect()] == [("v", True)]
    assert piles.snaps_of_tracks(boxes.limit(0), ["video_id"], "frame").count() == 0


def test_overlapping_boxes_meet_once(spark):
    rng = random.Random(5)
    sides = [(rng.randint(-90, 90), rng.randint(-90, 90), rng.randint(0, 70), rng.randint(0, 70)) for _ in range(80)]
    box = lambda v: [float(v[0]), float(v[1]), float(v[0] + v[2]), float(v[1] + v[3])]
    rows = [(i % 2, i, box(v)) for i, v in enumerate(sides)]
    a = frame(spark, rows, "f int, i int, a array<double>")
    b = frame(spark, rows, "f int, j int, b array<double>")
    got = sorted((r.i, r.j) for r in joins.overlapping(a, b, ["f"], "a", "b", 16.0).collect())
    meets = lambda p, q: min(p[2], q[2]) > max(p[0], q[0]) and min(p[3], q[3]) > max(p[1], q[1])
    assert got == sorted((i, j) for f, i, p in rows for g, j, q in rows if f == g and meets(p, q))


def test_jobs_after_the_end(spark):
    queue = frame(spark, [(1, "processing"), (2, "queued"), (None, "queued")], "id int, status string")
    finished, left = queueing.mark_completed(queue, frame(spark, [(1,), (1,), (9,)], "id int"), "id", F.lit("t"))
    assert [(r.id, r.status, r.completed_at) for r in finished.collect()] == [(1, "completed", "t")]
    assert sorted(str(r.id) for r in left.collect()) == ["2", "None"]
    counted = queueing.count_attempts(frame(spark, [("v", None, 2)], "v string, p int, attempt int"), frame(spark, [("v", None), ("v", 1), ("v", 1)], "v string, p int"), ["v", "p"])
    assert sorted((str(r.p), r.attempt) for r in counted.collect()) == [("1", 2), ("None", 3)]
    kinds = frame(spark, [("QueueError",), ("PipelineError",), (None,)], "e string").select(queueing.is_retryable(F.col("e")).alias("x"))
    assert [r.x for r in kinds.collect()] == [True, False, False]


def test_failures_reach_play_or_video(spark):
    failed = frame(spark, [("a", "pose", 1, "x"), ("b", "pose", None, "y")], "video_id string, stage_name string, play_index int, error string")
    stages = frame(spark, [("a", "pose", 1, "processing", None), ("a", "pose", 2, "completed", None)], "video_id string, stage_name string, play_index int, status string, error string")
    plays = frame(spark, [("a", 1, "processing"), ("a", 2, "completed")], "video_id string, play_index int, status string")
    s, p, v = queueing.propagate_failures(failed, stages, plays, frame(spark, [("a", "processing"), ("b", "processing")], "video_id string, status string"))
    assert sorted((r.video_id, r.play_index or 0, r.status, r.error) for r in s.collect()) == [("a", 1, "failed", "x"), ("a", 2, "completed", None), ("b", 0, "failed", "y")]
    assert sorted((r.play_index, r.status) for r in p.collect()) == [(1, "failed"), (2, "completed")]
    assert sorted((r.video_id, r.status) for r in v.collect()) == [("a", "processing"), ("b", "failed")]


def test_two_lines_make_a_formation(spark):
    line = [("v", 0, t, [x, 20.0 * t, x + 10, 20.0 * t + 15]) for t in range(10) for x in [0.0 if t % 2 else 60.0]]
    heap = [("v", 1, t, [float(t), float(t), t + 10.0, t + 15.0]) for t in range(10)]
    found = piles.formations(frame(spark, line + heap, "video_id string, frame int, track_id int, bbox array<double>"), ["video_id", "frame"]).collect()
    assert [(r.frame, r.axis, r.group_a, r.group_b) for r in found] == [(0, 0, 5, 5)]


def loop_merge(events, gap):
    out = []
    for t, c, o, s, d in sorted(events):
        if out and t - out[-1][0] <= gap:
            p = out[-1]
            out[-1] = [t if c > p[1] else p[0], (c + p[1]) / 2, (o + p[2]) / 2, (s + p[3]) / 2, max(d, p[4])]
        else:
            out.append([t, c, o, s, d])
    return out


def test_whistles(spark):
    rng = random.Random(4)
    events = [(round(rng.random() * 4, 2), rng.random(), rng.random(), rng.random(), rng.random()) for _ in range(60)]
    df = frame(spark, [("v", *e) for e in events], "v string, timestamp double, confidence double, onset_strength double, spectral_centroid double, duration double")
    got = sorted(list(r)[1:] for r in audio.merge_events(df, ["v"], 0.1).collect())
    assert np.allclose(got, sorted(loop_merge(events, 0.1)))
    assert audio.plausible(df).count() == sum(c >= 0.5 and 0.05 <= d <= 2 for _, c, _, _, d in events)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        s = rng.normal(size=(n, m))
        best = max(sum(s[i, j] for i, j in (zip(range(n), c, strict=False) if n <= m else zip(c, range(m), strict=False))) for c in itertools.permutations(range(max(n, m)), min(n, m)))
        pairs = tracking.assign(s)
        assert len(pairs) == min(n, m) and sum(s[i, j] for i, j in pairs) == pytest.approx(best)


DETECTIONS = "video_id string, play_index int, frame_index int, detection_index int, bbox array<double>, look array<double>"


def detections(n):
    return [("v", 0, f, d, [100.0 * d + f, 0.0, 100.0 * d + f + 20, 40.0], [1.0, float(d)]) for f in range(n) for d in range(3) if not (d == 2 and 5 <= f < 5 + 20)]


def test_tracks_keep_their_identity_and_age(spark):
    rows = tracking.track(frame(spark, detections(40), DETECTIONS), ["video_id", "play_index"]).collect()
    ids = {d: {r.track_id for r in rows if r.detection_index == d} for d in range(3)}
    assert len(ids[0]) == len(ids[1]) == 1 and len(ids[2]) == 2  # the third was lost for too long


def test_camera_products(spark):
    rng = np.random.default_rng(2)
    mats = [np.eye(3) + 0.1 * rng.normal(size=(3, 3)) for _ in range(6)]
    rows = [("v", i, m.ravel().tolist() if i else None, i == 3) for i, m in enumerate(mats)]
    df = frame(spark, rows, "video_id string, frame_index int, homography_to_prev array<double>, low_confidence boolean")
    want = np.eye(3)
    got = {r.frame_index: r.homography_to_ref for r in tracking.camera_to_reference(df, ["video_id"]).collect()}
    for i, m in enumerate(mats):
        want = want @ (np.eye(3) if i in (0, 3) else m)
        assert np.allclose(got[i], want.ravel())


# ------------------------------------------------------------------ sources, configuration


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "pose").mkdir()
    (tmp_path / "pose/frame_3.json").write_text(json.dumps({"timestamp": 0.2, "data": {"nose": {"x": 0.1, "y": 0.2, "z": 0, "confidence": 0.9}}}))
    (tmp_path / "pose/frame_4.json").write_text("{broken")
    assert [r.frame_index for r in readers.pose_files(spark, f"{tmp_path}/pose/*.json").collect()] == [3]
    (tmp_path / "log.txt").write_text("frame 9 (0.6s)\n== found ==\nframe 15 (1.0s)\nframe 30 (2.0s)\n")
    assert sorted((r.frame_index, r.seconds) for r in readers.candidates(spark, f"{tmp_path}/log.txt", "== found ==").collect()) == [(15, 1.0), (30, 2.0)]
    (tmp_path / "frames").mkdir()
    for i in (1, 2, 10):
        (tmp_path / f"frames/frame_{i:06d}.jpg").write_bytes(b"x")
    assert [r.frame_index for r in readers.frame_paths(spark, f"{tmp_path}/frames", 2).collect()] == [2, 10]
    rows = frame(spark, [("v", 1, 5), ("v", None, 6), ("v", 1, 7)], "video_id string, play_index int, start_frame int")
    assert [r.start_frame for r in sinks.write_rows(spark, f"{tmp_path}/tables", "plays", rows, 1, "start_frame").collect()] == [7]
    with pytest.raises(ValueError):
        readers.scan(spark, str(tmp_path), "plays", where=[("play_index", "!=", 1)])


def test_configuration_layers(spark, tmp_path):
    for name, doc in {"base/universal": {"a": {"x": 1, "y": [1]}, "traits": {"t": {"features": ["f"], "weights": [1]}}}, "levels/hs": {"a": {"x": 2}}, "positions/qb": {"a": {"y": [2]}}}.items():
        path = tmp_path / f"{name}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(doc))
    configs = Configs.read(spark, str(tmp_path))
    assert configs.resolve("qb", "hs")["a"] == {"x": 2, "y": [2]} and configs.positions() == ["qb"]
    assert [tuple(r) for r in configs.trait_weights(spark).collect()] == [("qb", "t", "f", 1.0)]
    assert merge_all([{"l": [1]}, {"l": [2]}], accumulate=True) == {"l": [1, 2]}
    assert deep_merge({"k": 1}, {"k": 2}, custom=lambda _, a, b: a + b) == {"k": 3}


def test_weights_of_features_no_row_of_the_batch_has_do_not_count(spark):
    from snapframe.functions import scores

    df = spark.sql("SELECT map('a', 80.0D) AS f UNION ALL SELECT map('a', 40.0D)")
    weights = {"a": 0.5, "b": 0.5}
    seen = scores.batch_features(df, "f")
    got = sorted(r[0] for r in df.select(scores.weighted_score(df["f"], weights, seen)).collect())
    assert seen == {"a"} and got == [40.0, 80.0]
    assert sorted(r[0] for r in df.select(scores.weighted_score(df["f"], weights)).collect()) == [20.0, 40.0]


def test_median_puts_zeros_in_their_place(spark):
    df = spark.sql("SELECT 1 AS g, map('a', -5.0D) AS traits UNION ALL SELECT 1, map('a', -1.0D, 'b', 4.0D) UNION ALL SELECT 1, map('b', 2.0D) UNION ALL SELECT 1, map('a', 3.0D, 'b', 6.0D)")
    from snapframe.operators import rollup

    assert rollup.roll_up(df, ["g"], "median").first().traits == {"a": -0.5, "b": 3.0}


def test_folds_over_cut_groups_equal_whole_ones(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from snapframe.operators import audio, sequences, tracking

    draw = random.Random(3)
    points = [(k, draw.randrange(300)) for k in ("a", None) for _ in range(80)] + [("a", None), ("b", None), ("c", 5), ("c", 5)]
    for inclusive in (False, True):
        want = []
        for key in ("a", None, "c"):
            last = None
            for x in sorted({v for k, v in points if k == key and v is not None}):
                if last is None or x - last > 4 or (inclusive and x - last == 4):
                    want.append((key, x))
                    last = x
        got = sequences.thin(spark.createDataFrame(points, "k string, x long"), ["k"], "x", 4, inclusive).collect()
        assert sorted(map(str, ((r.k, r.x) for r in got))) == sorted(map(str, want))

    events = [("v", draw.randrange(400) / 16, draw.random(), draw.random(), 1.0, draw.random()) for _ in range(120)]
    names = ["timestamp", "confidence", "onset_strength", "spectral_centroid", "duration"]
    want = []
    for e in sorted(e[1:] for e in events):
        if want and e[0] - want[-1][0] <= 0.125:
            a = want[-1]
            want[-1] = (e[0] if e[1] > a[1] else a[0], min(1.0, max(0.0, (a[1] + e[1]) / 2)), (a[2] + e[2]) / 2, (a[3] + e[3]) / 2, max(a[4], e[4]))
        else:
            want.append(e)
    got = audio.merge_events(spark.createDataFrame(events, ["k", *names]), ["k"], 0.125).collect()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(want)

    turn = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    moves = [(v, i, None if i == 4 else turn if i % 2 else [1.0, 0.0, float(i), 0.0, 1.0, 2.0, 0.0, 0.0, 1.0], i % 5 == 3) for v in ("a", None) for i in range(23)]
    frame = spark.createDataFrame(moves, "v string, frame_index long, homography_to_prev array<double>, low_confidence boolean")
    paths = []
    for span in (1024, 4):
        monkeypatch.setattr(tracking, "SPAN", span)
        rows = tracking.camera_to_reference(frame, ["v"]).orderBy(F.col("v"), "frame_index").collect()
        paths.append([(r.v, r.frame_index, r.homography_to_ref) for r in rows])
    assert len(paths[0]) == 46 and paths[0] == paths[1]
