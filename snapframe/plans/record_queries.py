"""Record joins, job outcomes and file checks over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapframe.functions import geometry, text
from snapframe.operators import joins, queueing, rollup, tracking, upsert
from snapframe.plans.registry import query
from snapframe.session import table


def _play(c: Column) -> Column:
    return F.when(c % 4 > 0, c % 4)


@query("""
    WITH t AS (SELECT c_nationkey AS video_id, c_custkey % 9 AS track_id, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS play_index, max(c_mktsegment) AS role FROM customer GROUP BY ALL)
    SELECT o_orderkey, role FROM orders LEFT JOIN t ON o_custkey % 30 = video_id AND o_orderkey % 9 = track_id AND CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END IS NOT DISTINCT FROM play_index""")
def boxes_with_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    tracks = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("video_id"), (c % 9).alias("track_id"), _play(c).alias("play_index"), F.col("c_mktsegment").alias("role"))
    boxes = table(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 30).alias("video_id"), (k % 9).alias("track_id"), _play(k).alias("play_index"))
    return joins.with_roles(boxes, tracks).select("o_orderkey", "role")


@query("""
    WITH j AS (SELECT c_nationkey AS v, c_custkey % 9 AS t, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS p, max(c_name) AS jersey FROM customer GROUP BY ALL),
    o AS (SELECT o_orderkey, o_custkey % 30 AS v, o_orderkey % 9 AS t, CASE WHEN o_orderkey % 7 < 5 THEN o_orderkey % 7 END AS p FROM orders)
    SELECT o_orderkey, coalesce(a.jersey, b.jersey) AS jersey_number FROM o LEFT JOIN j a ON o.v = a.v AND o.t = a.t AND o.p IS NOT DISTINCT FROM a.p LEFT JOIN j b ON o.v = b.v AND o.t = b.t AND b.p IS NULL""")
def tracks_with_jerseys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    read = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("video_id"), (c % 9).alias("track_id"), _play(c).alias("play_index"), F.col("c_name").alias("jersey_number"))
    tracks = table(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 30).alias("video_id"), (k % 9).alias("track_id"), F.when(k % 7 < 5, k % 7).alias("play_index"))
    return joins.with_jerseys(tracks, read).select("o_orderkey", "jersey_number")


@query("""
    WITH w AS (SELECT l_orderkey AS video_id, l_suppkey AS track_id, CAST(l_partkey AS VARCHAR) AS jersey FROM lineitem WHERE l_partkey % 5 > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber DESC, CAST(l_partkey AS VARCHAR) DESC) = 1)
    SELECT video_id, track_id, coalesce(c_name, jersey) AS player_id FROM w LEFT JOIN customer ON jersey = CAST(c_custkey AS VARCHAR)""")
def players_from_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    jersey = F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey").cast("string"))
    reps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_suppkey").alias("track_id"), F.col("l_linenumber").alias("rep_index"), jersey.alias("jersey_number"))
    roster = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("jersey_number"), F.col("c_name").alias("name"))
    return joins.players_of_tracks(reps, roster)


@query("""
    SELECT o_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""")
def posed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate")
    pose = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return joins.frames_with_pose(frames, pose, ["o_orderkey"])


@query("""
    SELECT l_orderkey, count(*) AS tracks, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY ALL""")
def frame_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("track_id"), F.array("l_quantity").alias("bbox"))
    ids = F.concat_ws(",", F.transform("tracks", lambda t: t["track_id"].cast("string")))
    return joins.tracks_by_frame(tracks, ["l_orderkey"]).select("l_orderkey", F.size("tracks").cast("long").alias("tracks"), ids.alias("ids"))


@query("""
    SELECT 'finished' AS part, o_orderkey, 'completed' AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)
    UNION ALL SELECT 'queue', o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)""")
def completed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    done = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    finished, left = queueing.mark_completed(queue, done, "o_orderkey", F.lit("2024-02-15"))
    part = lambda df, name: df.select(F.lit(name).alias("part"), "o_orderkey", "status")
    return part(finished, "finished").union(part(left, "queue"))


@query("""
    WITH f AS (SELECT o_custkey AS v, o_orderpriority AS s, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS p, max(o_orderkey) AS e FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL),
    t AS (SELECT o_custkey AS v, o_orderpriority AS s, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS p FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
    SELECT 'stage' AS kind, coalesce(t.v, f.v) AS video_id, coalesce(t.p, f.p) AS play_index, coalesce(t.s, f.s) AS stage_name, CASE WHEN f.v IS NULL THEN 'done' ELSE 'failed' END AS status FROM t FULL JOIN f ON t.v = f.v AND t.s = f.s AND t.p IS NOT DISTINCT FROM f.p
    UNION ALL SELECT 'play', c_custkey, p, NULL, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.v = c_custkey AND f.p = q.p) THEN 'failed' ELSE 'done' END FROM customer, (VALUES (1), (2)) q(p)
    UNION ALL SELECT 'video', c_custkey, NULL, NULL, CASE WHEN c_custkey IN (SELECT v FROM f WHERE p IS NULL) THEN 'failed' ELSE 'done' END FROM customer""")
def propagated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderpriority").alias("stage_name"), F.when(k % 3 > 0, k % 3).alias("play_index"), k.cast("string").alias("error"), "o_orderstatus")
    failed, other = jobs.filter("o_orderstatus = 'P'").drop("o_orderstatus"), jobs.filter("o_orderstatus <> 'P'")
    done = F.lit("done").alias("status")
    stages = other.select("video_id", "stage_name", "play_index").distinct().withColumns({"status": F.lit("done"), "error": F.lit(None).cast("string")})
    videos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), done)
    plays = videos.select("video_id", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("play_index"), "status")
    found = queueing.propagate_failures(failed, stages, plays, videos)
    none = F.lit(None)
    return (
        found[0].select(F.lit("stage").alias("kind"), "video_id", "play_index", "stage_name", "status")
        .union(found[1].select(F.lit("play"), "video_id", "play_index", none.cast("string"), "status"))
        .union(found[2].select(F.lit("video"), "video_id", none.cast("bigint"), none.cast("string"), "status"))
    )


@query("""
    WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS play, event_type = 'error' AS again FROM events)
    SELECT user_id, event_type, play, count(*) AS attempt, bool_or(again) AS retryable FROM e GROUP BY user_id, event_type, play""")
def counted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of high value as attempts on top of the count of the others."""
    k = F.col("event_id")
    tries = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(k % 3 > 0, k % 3).alias("play"), "value")
    keys = ["user_id", "event_type", "play"]
    before = tries.filter("value < 50").groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("attempt"))
    found = queueing.count_attempts(before, tries.filter("value >= 50 OR value IS NULL"), keys)
    error = F.when(F.col("event_type") == "error", "QueueError").otherwise("ValidationError")
    return found.withColumn("retryable", queueing.is_retryable(error))


@query("""
    SELECT event_id FROM events WHERE event_type <> 'error' AND date_diff('microsecond', ts, TIMESTAMP '2024-02-15') > 960 * 3600000000::BIGINT""")
def unclaimed_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc = F.expr("to_timestamp(concat(cast(ts as string), '+00:00'))")
    e = table(spark, sf_dir, "events").select("event_id", utc.alias("created_at"), F.when(F.col("event_type") == "error", utc).alias("claimed_at"))
    return queueing.unclaimed(e, "claimed_at", "created_at", F.expr("to_timestamp('2024-02-15 00:00:00+00:00')"), 960).select("event_id")


@query("""
    SELECT l_suppkey, count(*) AS frames, round(coalesce(avg(CASE WHEN l_linenumber < 7 THEN l_discount::DOUBLE END), 0), 9) AS mean_inlier_ratio FROM lineitem GROUP BY ALL""")
def camera_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col("l_linenumber") < 7, F.col("l_discount").cast("double"))
    found = rollup.inlier_summary(table(spark, sf_dir, "lineitem").select("l_suppkey", ratio.alias("inlier_ratio")), ["l_suppkey"])
    return found.withColumn("mean_inlier_ratio", F.round("mean_inlier_ratio", 9))


@query("""
    WITH f AS (SELECT l_orderkey, count(*) AS sampled, count(*) FILTER (l_returnflag = 'A') AS keyframes FROM lineitem GROUP BY ALL),
    j AS (SELECT o_orderkey, coalesce(sampled, 0) AS sampled, coalesce(keyframes, 0) AS keyframes, o_orderstatus = 'P' AS bare FROM orders LEFT JOIN f ON o_orderkey = l_orderkey),
    r AS (SELECT *, concat_ws(',', CASE WHEN bare THEN 'missing_encoder_and_creation_time_metadata' END,
                 CASE WHEN keyframes > 0 AND 30.0 / keyframes > 12 THEN format('sparse_keyframe_interval_{:.1f}s', 30.0::DOUBLE / keyframes) WHEN sampled > 0 AND keyframes = 0 THEN 'no_keyframe_in_sample_window' END) AS reasons FROM j)
    SELECT o_orderkey, sampled, keyframes, reasons, reasons <> '' AS flagged, CASE WHEN reasons <> '' THEN 'medium' ELSE 'low' END AS confidence FROM r""")
def file_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "I").otherwise("P")
    frames = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), kind.alias("pict_type"))
    tag = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    tags = table(spark, sf_dir, "orders").select("o_orderkey", tag.alias("encoder"), F.lit(None).cast("string").alias("creation_time"))
    found = rollup.file_integrity(frames, tags, "o_orderkey")
    return found.select("o_orderkey", "sampled", "keyframes", F.concat_ws(",", "reasons").alias("reasons"), "flagged", "confidence")


@query("""
    WITH c AS (SELECT c_custkey, (c_custkey % 41) AS w, (c_custkey % 100) / 100.0::DOUBLE AS s, (c_custkey % 37) / 37.0::DOUBLE AS r FROM customer)
    SELECT c_custkey, CASE WHEN w < 20 THEN 'uncertain' WHEN s < 0.35 THEN 'player' WHEN r >= 0.25 THEN 'referee' ELSE 'player' END AS role,
           round(CASE WHEN w < 20 THEN 0 WHEN s < 0.35 THEN least(0.95, 0.5 + 0.35 - s) WHEN r >= 0.25 THEN least(0.95, 0.5 + r - 0.25) ELSE least(0.95, 0.5 + 0.25 - r) END::DOUBLE, 9) AS confidence,
           CASE WHEN w > 0 AND c_custkey % 5 > 0 THEN round(1280 / w::DOUBLE, 9) END AS scale_x, s >= 0.7 AND c_custkey % 3 > 0 AS pose_accepted FROM c""")
def crop_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    share, rows = k % 100 / F.lit(100.0), k % 37 / F.lit(37.0)
    landmarks = F.when(k % 3 > 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    scale = geometry.resolution_scale(F.lit(1280), F.lit(720), k % 41, k % 5)
    found = table(spark, sf_dir, "customer").select(k, geometry.uniform_role(k % 41, F.lit(40), share, rows).alias("u"), scale.alias("s"), geometry.accepted_pose(landmarks, share).alias("pose_accepted"))
    return found.select(k, "u.role", F.round("u.confidence", 9).alias("confidence"), F.round("s.x", 9).alias("scale_x"), "pose_accepted")


# --------------------------------------------------------------------------- poses and camera


def _keypoints(k: Column) -> Column:
    """Four torso keypoints of a number, some of them without confidence."""
    point = lambda i: F.struct(
        ((k * 7 + i * 13) % 100 / F.lit(100.0)).alias("x"), ((k * 11 + i * 29) % 100 / F.lit(100.0)).alias("y"), F.lit(0.0).alias("z"), ((k * 3 + i * 17) % 10 / F.lit(10.0)).alias("confidence")
    )
    return F.create_map(*(x for i, name in enumerate(geometry.TORSO) for x in (F.lit(name), point(i))))


@query("""
    WITH p AS (SELECT c_custkey, i, (c_custkey * 7 + i * 13) % 100 / 100.0::DOUBLE AS x, (c_custkey * 11 + i * 29) % 100 / 100.0::DOUBLE AS y, (c_custkey * 3 + i * 17) % 10 / 10.0::DOUBLE AS c,
                      ((c_custkey + 1) * 7 + i * 13) % 100 / 100.0::DOUBLE AS x2, ((c_custkey + 1) * 11 + i * 29) % 100 / 100.0::DOUBLE AS y2, ((c_custkey + 1) * 3 + i * 17) % 10 / 10.0::DOUBLE AS c2 FROM customer, range(4) t(i))
    SELECT c_custkey, round(coalesce(avg(x) FILTER (c > 0.3), 0.5), 9) AS cx, round(coalesce(avg(y) FILTER (c > 0.3), 0.5), 9) AS cy,
           round(coalesce(avg(sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2))) FILTER (c >= 0.3 AND c2 >= 0.3), 0), 9) AS moved,
           CASE WHEN count(*) FILTER (c >= 0.3) >= 3 THEN min(x) FILTER (c >= 0.3) END AS left_edge, CASE WHEN count(*) FILTER (c >= 0.3) >= 3 THEN max(y) FILTER (c >= 0.3) END AS lower_edge,
           max(trunc(x * 1280)) FILTER (i = 0) AS px, round(max(x / 1280) FILTER (i = 0), 9) AS nx FROM p GROUP BY c_custkey""")
def pose_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, _keypoints(k).alias("now"), _keypoints(k + 1).alias("next"))
    now, first = F.col("now"), geometry.TORSO[0]
    centre, box, size = geometry.torso_centre(now), geometry.keypoint_box(now), (F.lit(1280), F.lit(720))
    return rows.select(
        k, F.round(centre["x"], 9).alias("cx"), F.round(centre["y"], 9).alias("cy"), F.round(geometry.displacement(now, F.col("next")), 9).alias("moved"), box[0].alias("left_edge"), box[3].alias("lower_edge"),
        geometry.denormalised(now, *size)[first]["x"].alias("px"), F.round(geometry.normalised(now, *size)[first]["x"], 9).alias("nx"),
    )


@query("""
    SELECT user_id, event_id, sum(CASE WHEN event_id % 7 > 0 THEN event_id % 5 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS tx,
           sum(CASE WHEN event_id % 7 > 0 THEN event_id % 3 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS ty FROM events""")
def camera_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, one, zero = F.col("event_id"), F.lit(1.0), F.lit(0.0)
    move = F.array(one, zero, (k % 5).cast("double"), zero, one, (k % 3).cast("double"), zero, zero, one)
    motions = table(spark, sf_dir, "events").select("user_id", k, move.alias("homography_to_prev"), (k % 7 == 0).alias("low_confidence"))
    h = F.col("homography_to_ref")
    return tracking.camera_to_reference(motions, ["user_id"], "event_id").select("user_id", "event_id", h[2].alias("tx"), h[5].alias("ty"))


@query("""
    WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS truths, count(*) FILTER (event_type = 'error') AS candidates, count(*) FILTER (event_type = 'click') AS matched FROM events GROUP BY ALL)
    SELECT user_id, truths, candidates, matched, CASE WHEN truths > 0 THEN round(matched / truths, 9) ELSE 0 END AS recall, CASE WHEN candidates > 0 THEN round(matched / candidates, 9) ELSE 0 END AS precision,
           truths - matched AS missed, candidates - matched AS false_positives FROM n WHERE truths + candidates > 0""")
def found_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = lambda name: e.filter(F.col("event_type") == name).select("user_id")
    found = rollup.detection_quality(kind("error"), kind("signup"), kind("click"), ["user_id"])
    return found.withColumns({c: F.round(c, 9) for c in ("recall", "precision")})


# --------------------------------------------------------------------------- stages and fields


@query("""
    SELECT o_orderkey, ['metadata', 'download', 'authenticity_check', 'whistle_detection', 'frame_extraction', 'motion_compensation', 'play_detection', 'detection', 'tracking', 'pose', 'torso_crop', 'role_classification',
                        'jersey_ocr', 'rep_extraction', 'biomechanics', 'complete'][o_orderkey % 16 + 2] AS following, regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS priority,
           length(CAST(o_custkey AS VARCHAR)) <= 3 AS jersey, o_orderstatus AS status, CASE WHEN o_orderkey % 3 > 0 THEN '1' END AS tries FROM orders""")
def stage_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    stage = F.element_at(F.array(*(F.lit(s) for s in queueing.STAGES)), (k % 16 + 1).cast("int"))
    held = F.when(k % 3 > 0, F.create_map(F.lit("pose"), F.create_map(F.lit("status"), F.lit("old"), F.lit("tries"), F.lit("1")))).otherwise(F.create_map(F.lit("tracking"), F.create_map(F.lit("status"), F.lit("old"))))
    rows = table(spark, sf_dir, "orders").withColumn("stages", held)
    pose = upsert.set_nested(F.col("stages"), "pose", "status", F.col("o_orderstatus"))["pose"]
    return rows.select(
        k, queueing.next_stage(stage).alias("following"), text.digits(F.col("o_orderpriority")).alias("priority"), text.is_jersey(F.col("o_custkey").cast("string")).alias("jersey"), pose["status"].alias("status"), pose["tries"].alias("tries")
    )


@query("SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-02-15') AS age FROM events")
def event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages in minutes, told in whole microseconds."""
    utc = F.expr("to_timestamp(concat(cast(ts as string), '+00:00'))")
    now = F.expr("to_timestamp('2024-02-15 00:00:00+00:00')")
    return table(spark, sf_dir, "events").select("event_id", F.round(text.age_minutes(utc, now) * 60_000_000).cast("long").alias("age"))
