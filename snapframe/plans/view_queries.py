"""Lookups, pages, repairs, players and keypoints over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapframe.functions import scores
from snapframe.operators import features, joins, queueing, rollup, sequences, upsert
from snapframe.plans import grading
from snapframe.plans.registry import query
from snapframe.session import table


def _some(c: Column, n: int) -> Column:
    return F.when(c % n > 0, c % n)


@query("SELECT o_orderkey, o_orderstatus AS status, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def status_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderdate")
    return queueing.with_status(orders, "P", "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, CAST(o_orderkey % 10 + 1 AS INT) AS priority FROM orders WHERE o_orderkey % 10 + 1 = 7 ORDER BY o_orderdate, o_orderkey LIMIT 10")
def priority_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").withColumn("priority", (F.col("o_orderkey") % 10 + 1).cast("int"))
    return queueing.by_priority(jobs, 7, "o_orderdate", "o_orderkey").select("o_orderkey", "priority")


_VIDEO_STATUS = "CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'downloaded' WHEN 3 THEN 'completed' ELSE 'failed' END"


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as videos; their orders are queue entries."""
    named = F.array(*(F.lit(s) for s in ("pending", "processing", "downloaded", "completed", "failed")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), F.get(named, (F.col("c_custkey") % 5).cast("int")).alias("status"))


@query(f"""
    SELECT video_id, CASE WHEN status = 'pending' THEN 'metadata' ELSE 'download' END AS stage, 7 AS priority, CASE WHEN status = 'pending' THEN 'pending with no queue entry' ELSE 'orphaned (' || status || ')' END AS reason
    FROM (SELECT c_custkey AS video_id, {_VIDEO_STATUS} AS status FROM customer) WHERE status IN ('pending', 'processing', 'downloaded') AND video_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def watchdog_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("video_id"))
    return queueing.repairs(_videos(spark, sf_dir), queue)


@query("""
    WITH v AS (SELECT o_orderkey AS video_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P'), q AS (SELECT DISTINCT l_orderkey AS video_id FROM lineitem WHERE l_returnflag = 'R')
    SELECT v.video_id, round((epoch_us(TIMESTAMP '1998-08-01') - epoch_us(created_at)) / 60000000, 1) AS age_minutes, q.video_id IS NOT NULL AS queue_exists, a.action
    FROM v LEFT JOIN q USING (video_id), (SELECT 'would_delete' AS action UNION ALL SELECT 'deleted') a WHERE epoch_us(TIMESTAMP '1998-08-01') - epoch_us(created_at) > 1000000::BIGINT * 60000000
    UNION ALL SELECT v.video_id, NULL, q.video_id IS NOT NULL, 'left' FROM v LEFT JOIN q USING (video_id) WHERE NOT epoch_us(TIMESTAMP '1998-08-01') - epoch_us(created_at) > 1000000::BIGINT * 60000000""")
def stale_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run, the deletions and the pending videos that are left."""
    videos = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("video_id"), F.lit("pending").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    queue = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("video_id"))
    now = F.lit("1998-08-01 00:00:00").cast("timestamp")
    dry, same, _ = queueing.cleanup(videos, queue, now, 1_000_000, dry_run=True)
    gone, left, _ = queueing.cleanup(same, queue, now, 1_000_000)
    entries = queue.distinct().withColumn("queue_exists", F.lit(True))
    rest = left.join(entries, "video_id", "left").select("video_id", F.lit(None).cast("double").alias("age_minutes"), F.coalesce("queue_exists", F.lit(False)).alias("queue_exists"), F.lit("left").alias("action"))
    return dry.unionByName(gone).unionByName(rest)


@query("""
    WITH h AS (SELECT l_orderkey AS video_id, l_linestatus, bool_or(l_discount > 0.05) OVER (PARTITION BY l_orderkey, l_linenumber) AS hit FROM lineitem),
    p AS (SELECT video_id, hit, CASE WHEN hit THEN 'failed' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status FROM h),
    v AS (SELECT video_id, bool_or(hit) AS hit, count(*) FILTER (status = 'pending') AS open FROM p GROUP BY ALL)
    SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN hit AND open = 0 THEN 'completed' ELSE 'processing' END AS status FROM orders LEFT JOIN v ON o_orderkey = v.video_id""")
def settled_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as plays, of which the dear ones have failed; every eleventh video fails as a whole."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("play_index"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("pending").alias("status"), "l_discount")
    videos = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.lit("processing").alias("status"))
    job = [F.lit("pose").alias("stage_name"), F.lit("no data").alias("error")]
    failed = items.filter("l_discount > 0.05").select("video_id", *job, "play_index").unionByName(videos.filter("video_id % 11 = 0").select("video_id", *job, F.lit(None).cast("int").alias("play_index")))
    stages = failed.select("video_id", "stage_name", "play_index", F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error")).distinct()
    return queueing.settle_failures(failed, stages, items.drop("l_discount"), videos)[2]


@query("""
    WITH t AS (
        SELECT c_nationkey, c_custkey, c_custkey % 40 AS track_id, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 30 AS VARCHAR) END AS jersey, c_acctbal / 10000 AS conf, c_custkey % 100 AS frames,
               CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 END AS play FROM customer),
    p AS (SELECT *, CASE WHEN jersey IS NOT NULL AND conf >= 0.8 THEN 'jersey_' || jersey ELSE 'track_' || track_id || '_' || coalesce(CAST(play AS VARCHAR), 'x') END AS player_id FROM t)
    SELECT c_nationkey, player_id, max(CASE WHEN player_id LIKE 'jersey%' THEN jersey END) AS jersey_number, CAST(sum(frames) AS BIGINT) AS total_frames_tracked, min(c_custkey) AS first_seen,
           string_agg(track_id || ':' || coalesce(CAST(play AS VARCHAR), 'x'), ' ' ORDER BY c_custkey) AS instances FROM p GROUP BY c_nationkey, player_id""")
def player_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tracks = table(spark, sf_dir, "customer").select(
        "c_nationkey", (k % 40).alias("track_id"), _some(k, 5).alias("play_index"), F.when(k % 7 > 0, (k % 30).cast("string")).alias("jersey_number"),
        (F.col("c_acctbal") / 10000).alias("jersey_confidence"), (k % 100).alias("total_frames_tracked"), k.alias("row_id"),
    )
    shown = F.array_join(F.transform("instances", lambda x: F.concat(x["track_id"].cast("string"), F.lit(":"), F.coalesce(x["play_index"].cast("string"), F.lit("x")))), " ")
    return rollup.player_instances(tracks, ["c_nationkey"]).withColumn("instances", shown)


@query("""
    WITH d AS (SELECT user_id, event_type, event_id, value / 1000 AS edges, lag(value) OVER w AS before, value FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)),
    s AS (SELECT user_id, event_type, count(*) AS frames, var_pop(edges) AS v, coalesce(max(abs(value - before)), 0) AS d, avg(abs(value - before)) AS m FROM d GROUP BY ALL)
    SELECT user_id, event_type, frames, round(v, 8) AS edge_variance, round(d, 6) AS max_drift, round(m, 6) AS mean_motion,
           CASE WHEN frames < 2 THEN 'not_enough_readable_frames' ELSE concat_ws(',', CASE WHEN v < 0.015 THEN 'low_edge_density_variance' END, CASE WHEN d > 450 THEN 'histogram_drift_spike' END, CASE WHEN m < 140 THEN 'suspiciously_static' END) END AS reasons,
           frames >= 2 AND (v < 0.015 OR d > 450 OR coalesce(m < 140, false)) AS flagged,
           CASE WHEN frames < 2 THEN 'unknown' WHEN v < 0.015 OR d > 450 OR coalesce(m < 140, false) THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def frame_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("event_id")))
    frames = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("value") / 1000).alias("edges"), step.alias("drift"))
    found = rollup.frame_signals(frames, ["user_id", "event_type"], "edges", "drift", "drift", 0.015, 450.0, 140.0)
    return found.withColumns({"edge_variance": F.round("edge_variance", 8), "max_drift": F.round("max_drift", 6), "mean_motion": F.round("mean_motion", 6), "reasons": F.array_join("reasons", ",")})


POINT = "struct<x: double, y: double, z: double, confidence: double>"


def _pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of their user with up to four keypoints; the right ankle is missing in every third."""
    v, k = F.col("value") / 500, F.col("event_id")
    point = lambda x, y, c: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z"), c.cast("double").alias("confidence"))
    sure = F.when(k % 4 == 0, 0.2).otherwise(0.9)
    entries = F.array_compact(F.array(
        F.struct(F.lit("left_ankle").alias("k"), point(v, v / 2, sure).alias("p")), F.when(k % 3 > 0, F.struct(F.lit("right_ankle").alias("k"), point(v / 3, v, F.lit(0.8)).alias("p"))),
        F.struct(F.lit("left_hip").alias("k"), point(v / 4, v / 5, F.lit(0.7)).alias("p")), F.struct(F.lit("right_hip").alias("k"), point(v / 4 + 0.1, v / 5, F.lit(0.7)).alias("p")),
    ))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.lit(0).alias("play_index"), F.lit(1).alias("track_id"), k.cast("int").alias("frame_index"), F.map_from_entries(entries).alias("landmarks"))


_POINTS = """
    f AS (SELECT user_id AS video_id, event_id, value / 500 AS v, CASE WHEN event_id % 4 = 0 THEN 0.2 ELSE 0.9 END::DOUBLE AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
    p AS (SELECT video_id, event_id, i, 'left_ankle' AS name, v AS x, v / 2 AS y, c FROM f UNION ALL SELECT video_id, event_id, i, 'right_ankle', v / 3, v, 0.8 FROM f WHERE event_id % 3 > 0
          UNION ALL SELECT video_id, event_id, i, 'left_hip', v / 4, v / 5, 0.7 FROM f UNION ALL SELECT video_id, event_id, i, 'right_hip', v / 4 + 0.1::DOUBLE, v / 5, 0.7 FROM f)"""


@query(f"""
    WITH {_POINTS}
    SELECT video_id, CAST(event_id AS INT) AS frame_index, name, round(avg(x) OVER w, 9) AS x, round(avg(y) OVER w, 9) AS y, round(c, 9) AS confidence
    FROM p WINDOW w AS (PARTITION BY video_id, name ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def smoothed_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.smooth_keypoints(_pose(spark, sf_dir), ["video_id"], "frame_index").select("video_id", "frame_index", F.explode("landmarks").alias("name", "p"))
    return found.select("video_id", "frame_index", "name", *(F.round(f"p.{c}", 9).alias(c) for c in ("x", "y", "confidence")))


_STEPS = """
    s AS (
        SELECT a.video_id, a.i, a.name, CASE WHEN a.c >= 0.3 AND b.c >= 0.3 THEN sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) ELSE 0 END AS d
        FROM p a JOIN p b ON a.video_id = b.video_id AND a.name = b.name AND a.i = b.i + 1),
    t AS (SELECT f.video_id, avg(CASE WHEN f.event_id % 3 > 0 THEN (f.c + 2.2) / 4 ELSE (f.c + 1.4) / 3 END) AS conf, (stddev_pop(v / 4 + 0.05::DOUBLE) + stddev_pop(v / 5)) / 2 AS sway, count(*) AS n FROM f GROUP BY ALL),
    a AS (SELECT video_id, avg(d) AS mean, max(d) AS most, arg_max(d, i * 2 + CASE WHEN name = 'right_ankle' THEN 1 ELSE 0 END) AS final FROM s WHERE name LIKE '%ankle' GROUP BY ALL),
    h AS (SELECT video_id, avg(d) AS mean FROM s WHERE name LIKE '%hip' GROUP BY ALL),
    m AS (
        SELECT t.video_id, least(100, greatest(0, coalesce(a.mean, 0) / 0.15 * 100)) AS linear, least(100, greatest(0, coalesce(most, 0) / 0.15 * 100)) AS fast, least(100, greatest(0, coalesce(h.mean, 0) / 0.15 * 100)) AS side,
               least(100, greatest(0, greatest(0, coalesce(most - final, 0)) / 0.15 * 100)) AS slow, least(100, greatest(0, 100 - 300 * sway)) AS still, least(100, greatest(0, 100 * conf)) AS sure
        FROM t LEFT JOIN a USING (video_id) LEFT JOIN h USING (video_id))"""


@query(f"WITH {_POINTS}, {_STEPS} SELECT video_id, round(linear, 6) AS linear_speed, round(fast, 6) AS acceleration, round(side, 6) AS lateral_speed, round(slow, 6) AS deceleration, round(still, 6) AS balance, round(sure, 6) AS footwork FROM m")
def pose_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.rep_features(_pose(spark, sf_dir), ["video_id"])
    return found.select("video_id", *(F.round(F.col("features")[c], 6).alias(c) for c in ("linear_speed", "acceleration", "lateral_speed", "deceleration", "balance", "footwork")))


@query(f"""
    WITH {_POINTS}, {_STEPS},
    g AS (SELECT video_id, [0.5::DOUBLE * fast + 0.3::DOUBLE * still + 0.2::DOUBLE * sure, 0.4::DOUBLE * still + 0.3::DOUBLE * still + 0.3::DOUBLE * side, 0.35::DOUBLE * fast + 0.4::DOUBLE * linear + 0.25::DOUBLE * slow,
                 sure, 0.33::DOUBLE * sure + 0.33::DOUBLE * still + 0.34::DOUBLE * sure] AS s FROM m)
    SELECT video_id, round(list_avg(s), 6) AS overall_grade, round(s[3], 6) AS speed, CASE WHEN list_avg(s) >= 90 THEN 'A' WHEN list_avg(s) >= 80 THEN 'B' WHEN list_avg(s) >= 70 THEN 'C' WHEN list_avg(s) >= 60 THEN 'D' ELSE 'F' END AS letter FROM g""")
def graded_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rep a user over all its frames: range join, features, traits and grade."""
    pose = _pose(spark, sf_dir)
    reps = pose.groupBy("video_id", "track_id", "play_index").agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame")).withColumn("rep_index", F.lit(0))
    found = grading.analyse(reps, pose)
    return found.select("video_id", F.round("overall_grade", 6).alias("overall_grade"), F.round(F.col("traits")["speed"], 6).alias("speed"), "letter")


@query("""
    WITH s AS (SELECT o_custkey AS video_id, o_orderpriority AS stage_name, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END AS play, o_orderstatus AS status, o_orderkey FROM orders),
    l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY video_id, stage_name, play ORDER BY o_orderkey DESC) = 1),
    n AS (SELECT video_id, stage_name || CASE WHEN play IS NOT NULL THEN printf('_p%04d', play) ELSE '' END AS name, status, o_orderkey FROM l)
    SELECT c_custkey AS video_id, coalesce((SELECT string_agg(name || '=' || status || '@' || o_orderkey, ' ' ORDER BY name) FROM n WHERE n.video_id = c_custkey), '') AS stages FROM customer""")
def nested_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    stages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderpriority").alias("stage_name"), _some(k, 4).cast("int").alias("play_index"), F.col("o_orderstatus").alias("status"), k.alias("attempt"))
    found = upsert.with_stages(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id")), stages, "video_id", "attempt")
    shown = F.transform(F.array_sort(F.map_entries("stages")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["status"], F.lit("@"), e["value"]["attempt"].cast("string")))
    return found.select("video_id", F.array_join(shown, " ").alias("stages"))


@query("""
    WITH r AS (SELECT l_suppkey AS v, l_orderkey % 20 AS i, CASE WHEN l_linenumber % 4 > 0 THEN l_linenumber % 4 END AS t, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 END AS p, min(l_orderkey) AS start_frame FROM lineitem GROUP BY ALL)
    SELECT o_orderkey, start_frame FROM orders LEFT JOIN r ON o_custkey % 100 = v AND o_orderkey % 25 = i AND CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 6 END IS NOT DISTINCT FROM t AND CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END IS NOT DISTINCT FROM p""")
def found_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") % 20).alias("rep_index"), _some(F.col("l_linenumber"), 4).alias("track_id"), _some(F.col("l_partkey"), 3).alias("play_index"), F.col("l_orderkey").alias("start_frame"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    wanted = table(spark, sf_dir, "orders").select(o, (c % 100).alias("video_id"), (o % 25).alias("rep_index"), _some(o, 6).alias("track_id"), _some(c, 5).alias("play_index"))
    return joins.find_reps(wanted, items).select("o_orderkey", "start_frame")


@query("""
    SELECT l_orderkey, l_linenumber, round(least(100, greatest(0, (l_quantity * 2 * 0.5::DOUBLE + l_discount * 1000 * 0.3::DOUBLE) / 0.8::DOUBLE)), 6) AS strength,
           round(least(100, greatest(0, l_quantity * 2)), 6) AS power FROM lineitem""")
def batch_trait_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that no rep of the batch has carry no weight."""
    weights = {"strength": {"leg_power": 0.5, "core_stability": 0.3, "upper_body": 0.2}, "power": {"leg_power": 0.4, "grip": 0.6}}
    reps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.create_map(F.lit("leg_power"), F.col("l_quantity") * 2, F.lit("core_stability"), F.col("l_discount") * 1000).alias("features"))
    scored = features.score_reps(reps, ["l_orderkey", "l_linenumber"], weights, scores.batch_features(reps, "features"))
    return scored.select("l_orderkey", "l_linenumber", *(F.round(F.col("traits")[t], 6).alias(t) for t in weights))


@query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS play_index, CASE WHEN c_acctbal < 0 THEN 'claimed' ELSE o_orderstatus END AS status, CASE WHEN c_acctbal < 0 THEN true ELSE false END AS clip_ready
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def column_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = table(spark, sf_dir, "orders").select("o_orderkey", _some(F.col("o_custkey"), 3).alias("play_index"), F.col("o_orderstatus").alias("status"), F.lit(False).alias("clip_ready"), "o_custkey")
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    chosen = plays.join(poor, "o_custkey", "left_semi").select("o_orderkey", "play_index")
    return upsert.set_columns(plays, chosen, ["o_orderkey", "play_index"], {"status": F.lit("claimed"), "clip_ready": F.lit(True)}).drop("o_custkey")


@query("SELECT user_id, round(avg(value / 500), 6) AS confidence FROM events GROUP BY ALL HAVING avg(value / 500) >= 0.1")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").withColumn("sure", F.col("value") / 500)
    return features.quality_gate(frames, ["user_id"], "sure", 0.1).withColumn("confidence", F.round("confidence", 6))


@query("""
    SELECT o_custkey AS video_id, o_orderkey AS play_index, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN '/videos/' || o_custkey || '/plays/' || o_orderkey || '/clip' END AS clip_url FROM orders WHERE o_custkey = 7""")
def plays_of_a_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("play_index"), "o_totalprice", (F.col("o_orderstatus") == "F").alias("clip_ready"))
    return grading.plays_view(plays, 7).drop("clip_ready")


@query("""
    SELECT l_suppkey AS video_id, l_orderkey AS frame_index, round(l_orderkey / 15, 6) AS timestamp, (l_quantity + l_quantity + 10) / 2 AS x, l_partkey % 50 + 20.0::DOUBLE AS y FROM lineitem WHERE l_linenumber = 2 AND l_partkey % 9 > 0""")
def ground_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, y = F.col("l_quantity"), (F.col("l_partkey") % 50).cast("double")
    box = F.when(F.col("l_partkey") % 9 > 0, F.array(low, y, low + 10, y + 20)).otherwise(F.array(low))
    tracks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("video_id"), F.col("l_orderkey").alias("frame_index"), F.col("l_linenumber").alias("track_id"), box.alias("bbox"))
    return grading.route(tracks, 2).withColumn("timestamp", F.round("timestamp", 6))
