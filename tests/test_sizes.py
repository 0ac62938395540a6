"""What larger tables showed: plans without work that outgrows the input, and results that equal the SQL there."""

import duckdb
from pyspark.sql import functions as F

from snapframe.operators import field, joins, piles, rollup
from snapframe.plans import ORACLES, QUERIES


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


POSE = "video_id string, play_index int, track_id int, frame_index int, value double"


def test_slots_of_ranges_are_not_broadcast(spark):
    null = F.lit(None).cast("int")
    reps = spark.range(50).select(F.lit("v").alias("video_id"), F.col("id").alias("rep_index"), null.alias("play_index"), null.alias("track_id"), (F.col("id") * 40).alias("start_frame"), (F.col("id") * 40 + 30).alias("end_frame"))
    assert "Broadcast" not in plan_of(joins.frames_of_reps(reps, frame(spark, [("v", 0, 1, 3, 0.5)], POSE)))


def test_keys_of_long_numbers_are_those_of_the_sql(spark, tmp_path):
    spark.createDataFrame([(k, 1) for k in (7, 999_999, 1_000_000, 8_765_432)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = {r[0]: r[2] for r in con.execute(ORACLES["identifiers"]).fetchall()}
    got = {r.o_orderkey: r.key for r in QUERIES["identifiers"](spark, str(tmp_path)).collect()}
    assert got == want and want[8_765_432] == "frame_876543"


def test_a_mean_does_not_depend_on_the_order(spark):
    values = [0.1, 7.3, -7.3, 1e-3, -0.1, 3.3, -3.3, -1e-3] * 3
    orders = [sorted(values), sorted(values, reverse=True), values, sorted(values, key=abs)]
    means = {spark.createDataFrame([(v,) for v in o], "v double").coalesce(1).agg(field._mean("v")).first()[0] for o in orders}
    assert means == {0.0}


def test_rows_of_frames_are_not_repeated_for_each_level(spark):
    reps = spark.createDataFrame([("v", 0, 0, 1, 0, 500), ("v", 1, 0, 1, 3, 70)], "video_id string, rep_index int, play_index int, track_id int, start_frame int, end_frame int")
    pose = frame(spark, [("v", 0, 1, f, float(f)) for f in (2, 3, 3, 80)], POSE)
    found = joins.frames_of_reps(reps, pose)
    repeated = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode" in line and "value#" in line]
    assert not repeated
    assert sorted((r.rep_index, r.value) for r in found.collect()) == [(0, 2.0), (0, 3.0), (0, 3.0), (0, 80.0), (1, 3.0), (1, 3.0)]


def test_pairs_of_a_crowded_cell_are_dealt_over_tasks(spark):
    left = spark.range(400).select((F.col("id") * 0).alias("c"), F.col("id").alias("a"))
    right = spark.range(300).select((F.col("id") * 0).alias("c"), F.col("id").alias("b"))
    met = joins.in_pieces(left, right, ["c"], pairs=1000)
    assert met.count() == met.distinct().count() == 120_000
    assert plan_of(met).count("REPARTITION_BY_NUM") == 2 and "_piece" in plan_of(met)
    points = spark.range(300).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    near = joins.within_radius(points, points, ["k"], "x", "y", 3.0)
    rows = [(r.id, r.x, r.y) for r in points.collect()]
    assert sorted((r.a_id, r.b_id) for r in near.collect()) == sorted((a, b) for a, ax, ay in rows for b, bx, by in rows if (ax - bx) ** 2 + (ay - by) ** 2 <= 9)


def test_frames_and_plays_are_dealt_by_number(spark):
    boxes = spark.range(20).select(F.col("id").alias("frame"), F.col("id").alias("track_id"), F.array(*(F.lit(float(v)) for v in (0, 0, 4, 9))).alias("bbox"))
    assert "REPARTITION_BY_NUM" in plan_of(piles.piles(boxes, ["frame"]))
    reps = spark.range(20).select(F.col("id").alias("p"), (F.col("id") % 5).alias("g"), (F.col("id") % 2).alias("s"), F.create_map(F.lit("t"), F.lit(1.0)).alias("traits"))
    assert "REPARTITION_BY_NUM" in plan_of(rollup.trait_levels(reps, ["p"], ["g"], ["s"]))
