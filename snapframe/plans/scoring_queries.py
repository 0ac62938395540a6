"""Scoring, grading and roll-up operators over the test tables.

The tables stand in for motion data: line items are reps with features, orders plays, customers
games and nations seasons; events of a user are a time series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapframe.functions import scores
from snapframe.operators import rollup
from snapframe.plans.registry import query
from snapframe.session import table

STRENGTH = {"leg_power": 0.5, "core_stability": 0.3, "upper_body": 0.2}


def rep_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a feature map; upper_body is missing where there is no tax."""
    items = table(spark, sf_dir, "lineitem")
    one = lambda name, value: F.struct(F.lit(name).alias("k"), value.alias("v"))
    upper = F.when(F.col("l_tax") > 0, one("upper_body", F.col("l_tax") * 1250))
    pairs = F.array(one("leg_power", F.col("l_quantity") * 2), one("core_stability", F.col("l_discount") * 1000), upper)
    features = F.map_from_entries(F.array_compact(pairs))
    return items.withColumn("features", features)


_ITEM = "l_quantity * 2 AS lp, l_discount * 1000 AS cs, CASE WHEN l_tax > 0 THEN l_tax * 1250 END AS ub"


@query(f"""
    WITH f AS (SELECT l_orderkey, l_partkey, {_ITEM} FROM lineitem)
    SELECT l_orderkey, l_partkey,
           round(least(100, greatest(0, lp * 0.5::DOUBLE + cs * 0.3::DOUBLE + coalesce(ub, 0) * 0.2::DOUBLE)), 6) AS weighted,
           round(least(100, greatest(0, lp * 0.5::DOUBLE + cs * 0.3::DOUBLE + coalesce(ub, 0) * 0.2::DOUBLE)), 6) AS single,
           round((lp * 0.5::DOUBLE + cs * 0.3::DOUBLE + coalesce(ub, 0) * 0.2::DOUBLE) / (0.8::DOUBLE + CASE WHEN ub IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END), 6) AS present,
           round(lp * 0.5::DOUBLE + cs * 0.3::DOUBLE + coalesce(ub, 0.5::DOUBLE) * 0.2::DOUBLE, 6) AS neutral
    FROM f""")
def trait_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("features")
    kinds = {"weighted": scores.weighted_score, "single": scores.single_score, "present": scores.present_score, "neutral": scores.neutral_score}
    return rep_features(spark, sf_dir).select("l_orderkey", "l_partkey", *(F.round(run(f, STRENGTH), 6).alias(n) for n, run in kinds.items()))


def _band_sql(level: str) -> str:
    return "CASE " + " ".join(f"WHEN s BETWEEN {lo} AND {hi} THEN '{n}'" for n, (lo, hi) in scores.bands(level).items()) + " ELSE 'average' END"


@query(f"""
    WITH c AS (SELECT c_custkey, c_mktsegment, round((c_acctbal + 1000) / 110, 1) AS s FROM customer)
    SELECT c_custkey, s AS score,
           CASE WHEN s >= 90 THEN 'elite' WHEN s >= 80 THEN 'high' WHEN s >= 70 THEN 'average' WHEN s >= 60 THEN 'below_average' ELSE 'poor' END AS bucket,
           {_band_sql('college')} AS college, {_band_sql('hs')} AS hs, {_band_sql('pro')} AS pro,
           CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS letter,
           CASE WHEN s >= 90 THEN 95.0 WHEN s >= 80 THEN 85.0 WHEN s >= 70 THEN 75.0 WHEN s >= 60 THEN 65.0 ELSE 35.0 END::DOUBLE AS letter_score,
           CASE c_mktsegment WHEN 'MACHINERY' THEN 80.0 WHEN 'HOUSEHOLD' THEN 60.0 ELSE 50.0 END::DOUBLE AS categorical
    FROM c""")
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    scored = table(spark, sf_dir, "customer").withColumn("score", F.round((F.col("c_acctbal") + 1000) / 110, 1))
    graded = scored.withColumn("letter", scores.letter(s))
    return graded.select(
        "c_custkey", "score", scores.bucket(s).alias("bucket"), *(scores.band(s, level).alias(level) for level in ("college", "hs", "pro")), "letter",
        scores.letter_score(F.col("letter")).alias("letter_score"), scores.categorical_score(F.col("c_mktsegment"), {"MACHINERY": 80.0, "HOUSEHOLD": 60.0}).alias("categorical"),
    )


@query("""
    SELECT c_custkey, round((n - r) / n * 100, 6) AS percentile FROM (
        SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""")
def rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = Window.partitionBy("c_nationkey")
    rank = F.rank().over(nation.orderBy(F.desc("c_acctbal")))
    ranked = table(spark, sf_dir, "customer").select("c_custkey", rank.alias("r"), F.count(F.lit(1)).over(nation).alias("n"))
    return ranked.select("c_custkey", F.round(scores.rank_score(F.col("r"), F.col("n")), 6).alias("percentile"))


@query("""
    SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max,
           quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75
    FROM lineitem GROUP BY ALL""")
def trait_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.trait_statistics(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_LONG = f"""
    f AS (SELECT l_suppkey, row_number() OVER () AS i, {_ITEM} FROM lineitem),
    g AS (SELECT l_suppkey, i, unnest(['leg_power', 'core_stability', 'upper_body']) AS trait, unnest([lp, cs, ub]) AS score FROM f),
    h AS (SELECT DISTINCT l_suppkey, trait FROM g WHERE score IS NOT NULL),
    full_grid AS (SELECT g.l_suppkey, g.i, g.trait, coalesce(g.score, 0) AS score FROM g JOIN h USING (l_suppkey, trait))"""


@query(f"""
    WITH {_LONG}
    SELECT 'mean' AS method, l_suppkey, trait, round(avg(score), 6) AS score FROM full_grid GROUP BY ALL
    UNION ALL SELECT 'median', l_suppkey, trait, round(median(score), 6) FROM full_grid GROUP BY ALL
    UNION ALL SELECT 'max', l_suppkey, trait, round(max(score), 6) FROM full_grid GROUP BY ALL
    UNION ALL SELECT 'min', l_suppkey, trait, round(min(score), 6) FROM full_grid GROUP BY ALL""")
def roll_up_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = rep_features(spark, sf_dir).select("l_suppkey", F.col("features").alias("traits"))
    found = rollup.trait_summary(reps, ["l_suppkey"], median=True).filter("trait IS NOT NULL")
    methods = F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in rollup.METHODS))
    return found.select("l_suppkey", "trait", F.inline(methods)).select("method", "l_suppkey", "trait", F.round("score", 6).alias("score"))


@query(f"""
    WITH {_LONG}
    SELECT l_suppkey, trait, count(*) AS count, round(avg(score), 6) AS average, round(min(score), 6) AS low, round(max(score), 6) AS high FROM full_grid GROUP BY ALL""")
def roll_up_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = rep_features(spark, sf_dir).select("l_suppkey", F.col("features").alias("traits"))
    found = rollup.roll_up_with_stats(reps, ["l_suppkey"])
    long = found.select("l_suppkey", "count", F.explode("averages").alias("trait", "average"), "min_values", "max_values")
    return long.select("l_suppkey", "trait", "count", F.round("average", 6).alias("average"), F.round(F.col("min_values")[F.col("trait")], 6).alias("low"), F.round(F.col("max_values")[F.col("trait")], 6).alias("high"))


@query("""
    WITH p AS (SELECT c_nationkey, o_custkey, o_orderkey, avg(l_quantity) AS v, count(*) AS reps FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    g AS (SELECT c_nationkey, o_custkey, avg(v) AS v, sum(reps) AS reps, count(*) AS snaps FROM p GROUP BY ALL)
    SELECT c_nationkey, round(avg(v), 6) AS grade, CAST(sum(reps) AS BIGINT) AS reps, CAST(sum(snaps) AS BIGINT) AS snaps, count(*) AS games FROM g GROUP BY ALL""")
def season_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    reps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity").join(orders, "o_orderkey")
    return rollup.season(reps, ["o_orderkey"], ["o_custkey"], ["c_nationkey"], "l_quantity").withColumn("grade", F.round("grade", 6))


@query("""
    WITH r AS (
        SELECT c_nationkey, o_custkey, o_orderkey, unnest(['leg_power', 'core_stability', 'upper_body']) AS trait, unnest([l_quantity * 2, l_discount * 1000, CASE WHEN l_tax > 0 THEN l_tax * 1250 END]) AS score
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    p AS (SELECT c_nationkey, o_custkey, o_orderkey, trait, count(*) AS rows, avg(coalesce(score, 0)) AS mean, min(coalesce(score, 0)) AS min, max(coalesce(score, 0)) AS max FROM r GROUP BY ALL HAVING count(score) > 0),
    pn AS (SELECT c_nationkey, o_custkey, count(DISTINCT o_orderkey) AS n FROM r GROUP BY ALL),
    g AS (
        SELECT c_nationkey, o_custkey, trait, n AS rows, sum(mean) / n AS mean, CASE WHEN count(*) < n THEN least(min(min), 0) ELSE min(min) END AS min, CASE WHEN count(*) < n THEN greatest(max(max), 0) ELSE max(max) END AS max
        FROM p JOIN pn USING (c_nationkey, o_custkey) GROUP BY c_nationkey, o_custkey, trait, n),
    gn AS (SELECT c_nationkey, count(*) AS n FROM pn GROUP BY ALL),
    s AS (
        SELECT c_nationkey, trait, n AS rows, sum(mean) / n AS mean, CASE WHEN count(*) < n THEN least(min(min), 0) ELSE min(min) END AS min, CASE WHEN count(*) < n THEN greatest(max(max), 0) ELSE max(max) END AS max
        FROM g JOIN gn USING (c_nationkey) GROUP BY c_nationkey, trait, n),
    u AS (
        SELECT 'play' AS level, c_nationkey, o_custkey, o_orderkey, trait, rows, mean, min, max FROM p
        UNION ALL SELECT 'game', c_nationkey, o_custkey, NULL, trait, rows, mean, min, max FROM g UNION ALL SELECT 'season', c_nationkey, NULL, NULL, trait, rows, mean, min, max FROM s)
    SELECT level, c_nationkey, o_custkey, o_orderkey, trait, rows, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max FROM u""")
def trait_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customers, "o_custkey")
    reps = rep_features(spark, sf_dir).join(orders, "l_orderkey").select("c_nationkey", "o_custkey", F.col("l_orderkey").alias("o_orderkey"), F.col("features").alias("traits"))
    found = rollup.trait_levels(reps, ["o_orderkey"], ["o_custkey"], ["c_nationkey"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "min", "max")})


@query("""
    WITH p AS (SELECT l_suppkey, l_partkey % 10 AS g, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
    SELECT a.l_suppkey, round(a.v, 6) AS play, round(b.v, 6) AS game, round(c.v, 6) AS season
    FROM (SELECT l_suppkey, max(v) AS v FROM p GROUP BY ALL) a JOIN (SELECT l_suppkey, min(v) AS v FROM p GROUP BY ALL) b USING (l_suppkey)
    JOIN (SELECT l_suppkey, avg(v) AS v FROM p GROUP BY ALL) c USING (l_suppkey)""")
def compare_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 10).alias("g")).agg(F.avg("l_quantity").alias("v"))
    level = lambda f: p.groupBy("l_suppkey").agg(F.create_map(F.lit("q"), f("v")).alias("traits"))
    found = rollup.compare_levels(level(F.max), level(F.min), level(F.avg), ["l_suppkey"])
    return found.select("l_suppkey", *(F.round(F.col(c)["q"], 6).alias(c) for c in ("play", "game", "season")))


@query(f"""
    WITH f AS (SELECT l_orderkey, l_partkey, {_ITEM} FROM lineitem)
    SELECT l_orderkey, l_partkey, round((lp * 2 + cs + coalesce(ub, 0)) / (3 + CASE WHEN ub IS NULL THEN 0 ELSE 1 END), 6) AS composite, 50.0::DOUBLE AS unweighted FROM f""")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("features")
    return rep_features(spark, sf_dir).select("l_orderkey", "l_partkey", F.round(scores.composite(f, {"leg_power": 2.0}), 6).alias("composite"), scores.composite(f, {}).alias("unweighted"))


@query("""
    SELECT l_orderkey, round(avg(v), 6) AS grade, CASE WHEN avg(v) >= 90 THEN 'A' WHEN avg(v) >= 80 THEN 'B' WHEN avg(v) >= 70 THEN 'C' WHEN avg(v) >= 60 THEN 'D' WHEN avg(v) IS NOT NULL THEN 'F' END AS letter
    FROM (SELECT l_orderkey, CASE WHEN l_returnflag <> 'R' THEN l_quantity * 2 END AS v FROM lineitem) GROUP BY l_orderkey""")
def video_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * 2).alias("v"))
    return rollup.grade_of(items, ["l_orderkey"], "v").withColumn("grade", F.round("grade", 6))


@query("SELECT l_suppkey, round(sum(l_quantity * l_discount) / nullif(sum(l_discount), 0), 6) AS grade FROM lineitem GROUP BY ALL")
def weighted_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.weighted_grade(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount").withColumn("grade", F.round("grade", 6))


@query("""
    WITH t AS (
        SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 30 AS VARCHAR) END AS jersey, c_acctbal / 10000 AS conf, c_custkey % 100 AS frames,
               CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 END AS play FROM customer),
    p AS (SELECT *, CASE WHEN jersey IS NOT NULL AND conf >= 0.8 THEN 'jersey_' || jersey ELSE 'track_' || (c_custkey % 40) || '_' || coalesce(CAST(play AS VARCHAR), 'x') END AS player_id FROM t)
    SELECT c_nationkey, player_id, CAST(sum(frames) AS BIGINT) AS frames, count(*) AS instances, min(c_custkey) AS first_seen FROM p GROUP BY ALL""")
def player_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tracks = table(spark, sf_dir, "customer").select(
        "c_nationkey", (k % 40).alias("track_id"), F.when(k % 5 > 0, k % 5).alias("play_index"), F.when(k % 7 > 0, (k % 30).cast("string")).alias("jersey_number"),
        (F.col("c_acctbal") / 10000).alias("jersey_confidence"), (k % 100).alias("total_frames_tracked"), k.alias("row_id"),
    )
    return rollup.players(tracks, ["c_nationkey"])


@query("""
    WITH s AS (SELECT event_type, user_id, min(event_id) AS first_frame, max(event_id) AS last_frame, count(*) AS total_frames FROM events GROUP BY ALL)
    SELECT *, CASE WHEN last_frame >= max(last_frame) OVER (PARTITION BY event_type) - 400 THEN 'active' ELSE 'lost' END AS status FROM s""")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.track_summary(table(spark, sf_dir, "events"), ["event_type", "user_id"], "event_id", still=400)


@query("""
    SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P",
           count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS unresolved, CAST(least(100, floor(count(*) FILTER (o_orderstatus = 'F') * 100 / count(*))) AS INT) AS progress
    FROM orders GROUP BY ALL""")
def status_and_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    counts = rollup.status_counts(orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"]).join(rollup.unresolved(orders, ["o_custkey"], "o_orderstatus", ["F", "O"]), "o_custkey")
    return counts.withColumn("progress", rollup.progress(F.col("F"), F.col("F") + F.col("O") + F.col("P")))


@query("""
    WITH s AS (
        SELECT user_id, sum(value) FILTER (ok) AS total, avg(value) FILTER (ok) AS mean, min(value) FILTER (ok) AS min, max(value) FILTER (ok) AS max,
               coalesce(stddev_samp(value) FILTER (ok), 0) AS std, max(event_id) FILTER (ok) AS peak, avg(ok::INT) AS success_rate
        FROM (SELECT *, event_type <> 'error' AS ok FROM events) GROUP BY ALL)
    SELECT user_id, round(total, 4) AS total, round(mean, 4) AS mean, min, max, round(std, 4) AS std, peak, round(success_rate, 6) AS success_rate,
           CASE WHEN mean / 240 <= 1.2 THEN 'ok' WHEN mean / 240 <= 1.5 THEN 'warning' ELSE 'critical' END AS status
    FROM s""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    found = rollup.run_statistics(runs, ["user_id"], "value", "event_id", "ok").withColumn("status", scores.share_status(F.col("mean") / 240))
    return found.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 4), "std": F.round("std", 4), "success_rate": F.round("success_rate", 6)})


@query("""
    WITH r AS (SELECT l_returnflag, l_linenumber AS level, avg((l_linestatus = 'F')::INT) AS success_rate, avg(l_discount) AS latency, sum(l_quantity) AS throughput FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, round(avg(success_rate), 6) AS success_rate, round(avg(latency), 6) AS latency, arg_max(level, throughput) AS best_level, max(throughput) AS best_throughput,
           round((max(latency) - min(latency)) / min(latency) * 100, 4) AS degradation_pct FROM r GROUP BY ALL""")
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("level")).agg(
        F.avg((F.col("l_linestatus") == "F").cast("int")).alias("success_rate"), F.avg("l_discount").alias("latency"), F.sum("l_quantity").alias("throughput")
    )
    found = rollup.load_summary(runs, ["l_returnflag"])
    return found.withColumns({"success_rate": F.round("success_rate", 6), "latency": F.round("latency", 6), "degradation_pct": F.round("degradation_pct", 4)})


@query("""
    WITH v AS (SELECT conv_id, CASE role WHEN 'user' THEN 'referee' WHEN 'assistant' THEN 'player' END AS role, turn % 10 / 10.0::DOUBLE AS confidence FROM conversations),
    c AS (SELECT conv_id, count(*) FILTER (role = 'referee') AS r, count(*) FILTER (role = 'player') AS p, avg(confidence) FILTER (role = 'referee') AS cr, avg(confidence) FILTER (role = 'player') AS cp FROM v GROUP BY ALL)
    SELECT conv_id, CASE WHEN r > p THEN 'referee' ELSE 'player' END AS role, round(CASE WHEN r > p THEN cr ELSE cp END, 6) AS role_confidence FROM c WHERE r > p OR p > 0""")
def role_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "user", "referee").when(F.col("role") == "assistant", "player")
    votes = table(spark, sf_dir, "conversations").select("conv_id", role.alias("role"), (F.col("turn") % 10 / F.lit(10.0)).alias("confidence"))
    return rollup.role_vote(votes, ["conv_id"]).withColumn("role_confidence", F.round("role_confidence", 6))


@query("""
    WITH r AS (SELECT user_id, event_id, event_type, value / 500 AS confidence FROM events),
    f AS (SELECT user_id, arg_min(event_id, event_id) AS e FROM r WHERE confidence >= 0.97 GROUP BY ALL),
    b AS (SELECT user_id, event_id AS e FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, event_id) = 1)
    SELECT r.user_id, r.event_type, round(r.confidence, 6) AS confidence, r.event_id FROM b LEFT JOIN f USING (user_id) JOIN r ON r.user_id = b.user_id AND r.event_id = coalesce(f.e, b.e)""")
def best_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "events").withColumn("confidence", F.col("value") / 500)
    return rollup.best_read(reads, ["user_id"], "event_id", "event_type", "confidence", 0.97).withColumn("confidence", F.round("confidence", 6))


@query("""
    SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) = 1""")
def modal_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.modal(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""
    WITH d AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events),
    a AS (SELECT user_id, var_pop(value) AS variance, max(d) AS drift, avg(d) AS mean_step FROM d GROUP BY ALL)
    SELECT user_id, round(variance, 4) AS variance, drift, round(mean_step, 6) AS mean_step,
           concat_ws(',', CASE WHEN drift > 400 THEN 'drift' END, CASE WHEN variance > 10000 THEN 'variance' END) AS reasons, drift > 400 OR variance > 10000 AS flagged FROM a""")
def signal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.signal_flags(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 400.0, 10000.0)
    return found.withColumns({"variance": F.round("variance", 4), "mean_step": F.round("mean_step", 6)})


@query("SELECT DISTINCT user_id, event_type AS trait FROM events")
def trait_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = table(spark, sf_dir, "events").select("user_id", F.create_map("event_type", "value").alias("traits"))
    return rollup.traits_long(maps, ["user_id"]).select("user_id", "trait").distinct()


@query("""
    SELECT user_id, event_type AS trait, round(m, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, event_type) AS rank FROM (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL))
    WHERE rank <= 3""")
def top_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("trait")).agg(F.avg("value").alias("score"))
    return rollup.top_traits(means, ["user_id"]).withColumn("score", F.round("score", 6))


@query("""
    SELECT c_mktsegment, count(*) AS players, round(avg(c_acctbal), 4) AS mean, max(c_acctbal) AS best, bool_or(c_acctbal < -990) AS flagged FROM customer GROUP BY ALL""")
def player_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = F.create_map(F.lit("low"), F.col("c_acctbal") < -990, F.lit("never"), F.lit(False))
    found = rollup.compare_players(table(spark, sf_dir, "customer").withColumn("signals", signals), ["c_mktsegment"], "c_acctbal", "signals")
    return found.withColumn("mean", F.round("mean", 4))
