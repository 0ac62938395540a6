"""Aggregations: trait roll-ups, grades, statistics, counts and votes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapframe.functions import scores

METHODS = ("mean", "median", "max", "min")
BUCKETS = 1024


def traits_long(df: DataFrame, keys: Sequence[str], traits: str = "traits") -> DataFrame:
    """keys, trait, score of a map column."""
    return df.select(*keys, F.explode(traits).alias("trait", "score"))


# --------------------------------------------------------------------------- exact quantiles


def quantiles(runs: DataFrame, keys: Sequence[str], value: str, count: str, wanted: Mapping[str, float], buckets: int = BUCKETS) -> DataFrame:
    """Interpolated quantiles of counted values: keys (null equal to null) and a column for each of `wanted`.

    A group's range is cut into equal buckets. Their counts, one row for each, tell which bucket
    holds a wanted rank; only the values of those buckets are ranked. So no group's values are
    gathered or sorted whole. Null values are left out; a group without others has no row.
    """
    keys = list(keys)
    known = runs.filter(F.col(value).isNotNull() & (F.col(count) > 0)).select(*keys, F.col(value).cast("double").alias("_v"), F.col(count).alias("_c"))
    spans = known.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    share = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    bucket = F.least(F.lit(buckets - 1), F.floor(F.coalesce(share, F.lit(0.0)) * buckets)).cast("int")
    dealt = _null_safe(known, spans, keys, "inner").withColumn("_b", bucket)
    sizes = dealt.groupBy(*keys, "_b").agg(F.sum("_c").alias("_m"), F.max("_n").alias("_n"))
    before = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_m")
    ranks = []
    for name, q in wanted.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        part = at - F.floor(at)
        ranks += [F.struct(F.lit(name).alias("q"), F.floor(at).alias("rank"), (1 - part).alias("w")), F.struct(F.lit(name).alias("q"), (F.floor(at) + 1).alias("rank"), part.alias("w"))]
    held = sizes.withColumn("_before", before).withColumn("_ranks", F.filter(F.array(*ranks), lambda r: (r["w"] > 0) & (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_m"))))
    held = held.filter(F.size("_ranks") > 0).select(*keys, "_b", "_before", "_ranks")
    near = _null_safe(dealt.drop("_lo", "_hi", "_n"), held, [*keys, "_b"], "inner")
    start = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")
    hits = near.withColumn("_start", start).withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r["rank"] >= F.col("_start")) & (r["rank"] < F.col("_start") + F.col("_c")))))
    return hits.groupBy(*keys).agg(*(F.sum(F.when(F.col("_r.q") == name, F.col("_v") * F.col("_r.w"))).alias(name) for name in wanted))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, null equal to null; the left side's keys stay."""
    named = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(named, reduce(lambda a, b: a & b, on), how).drop(*(f"_k{i}" for i in range(len(keys))))


# --------------------------------------------------------------------------- trait roll-ups


def trait_summary(df: DataFrame, keys: Sequence[str], traits: str = "traits", median: bool = False) -> DataFrame:
    """keys, trait, rows, mean, min, max and, if asked for, median of each trait of each group.

    A trait that a row lacks counts as 0 in it; the traits of a group are those of any of its rows.
    Everything comes from one pass over `df`: each row also counts under a null trait, which stays in
    the result with the number of rows alone, so that a group without traits has that row. Values
    are counted before they are shuffled, and zeros are added by count.
    """
    keys = list(keys)
    kind = "array<struct<trait:string,score:double>>"
    entries = F.concat(F.coalesce(F.transform(F.map_entries(traits), lambda e: F.struct(e["key"].cast("string").alias("trait"), e["value"].cast("double").alias("score"))), F.array().cast(kind)), F.array(F.struct(F.lit(None).cast("string").alias("trait"), F.lit(None).cast("double").alias("score"))))
    long = df.select(*keys, F.inline(entries))
    count = F.count(F.lit(1))
    if median:
        long = long.groupBy(*keys, "trait", "score").agg(count.alias("_c"))
        total, count, known = F.sum(F.col("score") * F.col("_c")), F.sum("_c"), F.sum(F.when(F.col("score").isNotNull(), F.col("_c")))
    else:
        total, known = F.sum("score"), F.count("score")
    per = long.groupBy(*keys, "trait").agg(total.alias("_s"), F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.coalesce(known, F.lit(0)).alias("_n"), count.alias("_all"))
    per = per.withColumn("rows", F.max(F.when(F.col("trait").isNull(), F.col("_all"))).over(Window.partitionBy(*keys)))
    zeros = F.col("rows") - F.col("_n")
    zero = lambda f, c: F.when(F.col("trait").isNull(), F.lit(None)).when(zeros > 0, f(F.coalesce(c, F.lit(0.0)), F.lit(0.0))).otherwise(F.col(c))
    mean = F.when(F.col("trait").isNotNull(), F.coalesce("_s", F.lit(0.0)) / F.col("rows"))
    columns = [*keys, "trait", "rows", mean.alias("mean"), zero(F.least, "_lo").alias("min"), zero(F.greatest, "_hi").alias("max")]
    if not median:
        return per.select(*columns)
    missing = per.filter(F.col("trait").isNotNull()).select(*keys, "trait", F.lit(0.0).alias("score"), zeros.alias("_c"))
    middle = quantiles(long.filter(F.col("trait").isNotNull()).unionByName(missing).groupBy(*keys, "trait", "score").agg(F.sum("_c").alias("_c")), [*keys, "trait"], "score", "_c", {"median": 0.5})
    return _null_safe(per.select(*columns), middle, [*keys, "trait"], "left")


def _maps(summary: DataFrame, keys: Sequence[str], named: Mapping[str, str]) -> list[Column]:
    """One map from trait to figure for each (figure, column name)."""
    return [F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("trait").isNotNull(), F.struct("trait", figure))))).alias(name) for figure, name in named.items()]


def roll_up(df: DataFrame, keys: Sequence[str], method: str = "mean", traits: str = "traits") -> DataFrame:
    """One trait map per group; a trait that a row lacks counts as 0 in it. Unknown methods mean the mean.

    The traits of a group are those of any of its rows; groups without any have no row.
    """
    chosen = method if method in METHODS else "mean"
    summary = trait_summary(df, keys, traits, chosen == "median").filter("trait IS NOT NULL")
    return summary.groupBy(*keys).agg(*_maps(summary, keys, {chosen: traits}))


def roll_up_with_stats(df: DataFrame, keys: Sequence[str], method: str = "mean", traits: str = "traits") -> DataFrame:
    """Maps of averages, minima and maxima, and the number of rows; any method but mean is the median.

    All come from one summary. Groups without traits have empty maps.
    """
    chosen = "mean" if method == "mean" else "median"
    summary = trait_summary(df, keys, traits, chosen == "median")
    return summary.groupBy(*keys).agg(F.max("rows").alias("count"), *_maps(summary, keys, {chosen: "averages", "min": "min_values", "max": "max_values"}))


def merge_up(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summary one level up, from a lower level's: keys, trait, rows (groups of the lower level), mean, min, max.

    Means are averaged group by group, a trait that a lower group lacks counting as 0 there;
    extremes are those of the rows of all levels below.
    """
    keys = list(keys)
    per = summary.groupBy(*keys, "trait").agg(F.sum("mean").alias("_s"), F.min("min").alias("_lo"), F.max("max").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("rows", F.max(F.when(F.col("trait").isNull(), F.col("_n"))).over(Window.partitionBy(*keys)))
    short = F.col("_n") < F.col("rows")
    return per.select(
        *keys, "trait", "rows", (F.col("_s") / F.col("rows")).alias("mean"), F.when(short, F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo")).alias("min"), F.when(short, F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi")).alias("max")
    )


def trait_levels(reps: DataFrame, play: Sequence[str], game: Sequence[str], whole: Sequence[str], traits: str = "traits") -> DataFrame:
    """Trait averages of plays, games and seasons from one scan of the reps.

    level, the keys (null above their level), trait, rows (reps, plays or games), mean, min, max. The reps are
    summarised once by play; games merge their plays' summaries and seasons their games'. Reps are dealt by play
    and by number before they are spread over their traits, as a task's share grows with its rows then.
    """
    every = [*whole, *game, *play]
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plays = trait_summary(reps.select(*every, traits).repartition(parts, *every), every, traits)
    games = merge_up(plays, [*whole, *game])
    seasons = merge_up(games, list(whole))
    full = lambda df, name: df.filter("trait IS NOT NULL").select(F.lit(name).alias("level"), *(F.col(c) if c in df.columns else F.lit(None).cast(plays.schema[c].dataType).alias(c) for c in every), "trait", "rows", "mean", "min", "max")
    return full(plays, "play").unionByName(full(games, "game")).unionByName(full(seasons, "season"))


def compare_levels(play: DataFrame, game: DataFrame, season: DataFrame, keys: Sequence[str], traits: str = "traits") -> DataFrame:
    """The trait maps of three levels side by side."""
    named = [df.select(*keys, F.col(traits).alias(n)) for df, n in ((play, "play"), (game, "game"), (season, "season"))]
    return named[0].join(named[1], list(keys), "full_outer").join(named[2], list(keys), "full_outer")


def trait_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation, extremes and interpolated quartiles; null figures where a group has no value.

    Values are counted before they are shuffled, and the quartiles found by bucket and rank.
    """
    runs = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    figures = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return _null_safe(figures, quantiles(runs, keys, value, "_c", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), list(keys), "left")


def grade_of(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of the non-null values and its letter; both null without any."""
    return df.groupBy(*keys).agg(F.avg(value).alias("grade")).withColumn("letter", scores.letter(F.col("grade")))


def weighted_grade(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    up, down = F.sum(F.col(value) * F.col(weight)), F.sum(weight)
    return df.groupBy(*keys).agg(scores.clip(up / F.nullif(down, F.lit(0.0))).alias("grade"))


def season(reps: DataFrame, play: Sequence[str], game: Sequence[str], whole: Sequence[str], value: str) -> DataFrame:
    """Mean of game means of play means, with the reps, plays and games behind it."""
    plays = reps.groupBy(*whole, *game, *play).agg(F.avg(value).alias("v"), F.count(F.lit(1)).alias("reps"))
    games = plays.groupBy(*whole, *game).agg(F.avg("v").alias("v"), F.sum("reps").alias("reps"), F.count(F.lit(1)).alias("snaps"))
    return games.groupBy(*whole).agg(F.avg("v").alias("grade"), F.sum("reps").alias("reps"), F.sum("snaps").alias("snaps"), F.count(F.lit(1)).alias("games"))


def _read_surely(sure: float) -> Column:
    return F.coalesce(F.col("jersey_number") != "", F.lit(False)) & (F.coalesce("jersey_confidence", F.lit(0.0)) >= sure)


def _player(sure: float) -> Column:
    alone = F.concat(F.lit("track_"), F.col("track_id").cast("string"), F.lit("_"), F.coalesce(F.col("play_index").cast("string"), F.lit("x")))
    return F.when(_read_surely(sure), F.concat(F.lit("jersey_"), F.col("jersey_number"))).otherwise(alone)


def players(tracks: DataFrame, keys: Sequence[str], sure: float = 0.8) -> DataFrame:
    """Tracks gathered into players: by jersey if it is read surely, else each track of each play alone.

    `tracks` has track_id, play_index, jersey_number, jersey_confidence, total_frames_tracked and
    row_id, which gives the order of first sight.
    """
    return (
        tracks.withColumn("player_id", _player(sure))
        .groupBy(*keys, "player_id")
        .agg(F.sum(F.coalesce("total_frames_tracked", F.lit(0))).alias("frames"), F.count(F.lit(1)).alias("instances"), F.min("row_id").alias("first_seen"))
    )


def player_instances(tracks: DataFrame, keys: Sequence[str], sure: float = 0.8) -> DataFrame:
    """Players as `players` finds them, with their jersey and the list of their tracks and plays in order of first sight.

    The list is the result's own row, so a player has as many entries as it has tracks.
    """
    found = tracks.withColumn("player_id", _player(sure)).withColumn("_jersey", F.when(_read_surely(sure), F.col("jersey_number")))
    seen = F.sort_array(F.collect_list(F.struct("row_id", "track_id", "play_index")))
    return found.groupBy(*keys, "player_id").agg(
        F.max("_jersey").alias("jersey_number"), F.sum(F.coalesce("total_frames_tracked", F.lit(0))).alias("total_frames_tracked"), F.min("row_id").alias("first_seen"),
        F.transform(seen, lambda x: F.struct(x["track_id"].alias("track_id"), x["play_index"].alias("play_index"))).alias("instances"),
    )


def track_summary(rows: DataFrame, keys: Sequence[str], frame: str, still: int = 0) -> DataFrame:
    """keys, first_frame, last_frame, total_frames, status of each track.

    A track is active if it was seen within `still` frames of its group's last frame (keys without the last one), else lost.
    """
    summed = rows.groupBy(*keys).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count(F.lit(1)).alias("total_frames"))
    last = F.max("last_frame").over(Window.partitionBy(*keys[:-1]))
    return summed.withColumn("status", F.when(F.col("last_frame") >= last - still, "active").otherwise("lost"))


def top_traits(scored: DataFrame, keys: Sequence[str], trait: str = "trait", score: str = "score", n: int = 3) -> DataFrame:
    """The n best traits of each group with their rank; of equal scores the first by name."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), trait))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def any_signal(signals: Column) -> Column:
    """Whether any entry of a map of flags is set; null maps and entries are not."""
    return F.coalesce(F.exists(F.map_values(signals), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def compare_players(players: DataFrame, keys: Sequence[str], value: str, signals: str) -> DataFrame:
    """Players of each group: their number, mean and best value, and whether a signal of any is set."""
    return players.groupBy(*keys).agg(F.count(F.lit(1)).alias("players"), F.avg(value).alias("mean"), F.max(value).alias("best"), F.bool_or(any_signal(F.col(signals))).alias("flagged"))


def frame_signals(frames: DataFrame, keys: Sequence[str], edges: str, drift: str, motion: str, least_variance: float = 0.0005, spike: float = 5000.0, static: float = 1.0) -> DataFrame:
    """Weak signs of a doctored recording from figures of its sampled frames: keys, the figures, reasons, flagged, confidence.

    Hardly varying edge densities, a spike in the drift from frame to frame and a picture that hardly moves each
    are a reason. Drift and motion are null on a first frame. Of fewer than two frames nothing can be said.
    """
    summed = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.var_pop(edges).alias("edge_variance"), F.coalesce(F.max(drift), F.lit(0.0)).alias("max_drift"), F.avg(motion).alias("mean_motion"))
    enough = F.col("frames") >= 2
    signs = {"low_edge_density_variance": F.col("edge_variance") < least_variance, "histogram_drift_spike": F.col("max_drift") > spike, "suspiciously_static": F.coalesce(F.col("mean_motion") < static, F.lit(False))}
    found = F.array_compact(F.array(*(F.when(hit, name) for name, hit in signs.items())))
    reasons = F.when(enough, found).otherwise(F.array(F.lit("not_enough_readable_frames")))
    flagged = enough & (F.size(found) > 0)
    return summed.select("*", reasons.alias("reasons"), flagged.alias("flagged"), F.when(~enough, "unknown").when(F.size(found) > 0, "medium").otherwise("low").alias("confidence"))


def status_counts(df: DataFrame, keys: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values))


def unresolved(df: DataFrame, keys: Sequence[str], status: str, resolved: Sequence[str]) -> DataFrame:
    """Rows whose known status is none of the resolved ones."""
    return df.groupBy(*keys).agg(F.count_if(F.col(status).isNotNull() & ~F.col(status).isin(*resolved)).alias("unresolved"))


def progress(done: Column, total: Column) -> Column:
    """Whole percent, cut down and at most 100; 0 of nothing."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total))).otherwise(0).cast("int")


def run_statistics(runs: DataFrame, keys: Sequence[str], seconds: str, peak: str, success: str) -> DataFrame:
    """Figures of the successful runs, and the share of successful ones among all."""
    ok = lambda c: F.when(F.col(success), F.col(c))
    return runs.groupBy(*keys).agg(
        F.sum(ok(seconds)).alias("total"),
        F.avg(ok(seconds)).alias("mean"),
        F.min(ok(seconds)).alias("min"),
        F.max(ok(seconds)).alias("max"),
        F.coalesce(F.stddev_samp(ok(seconds)), F.lit(0.0)).alias("std"),
        F.max(ok(peak)).alias("peak"),
        F.avg(F.col(success).cast("int")).alias("success_rate"),
    )


def load_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best level by throughput, and how far the slowest level falls behind the fastest in percent."""
    return runs.groupBy(*keys).agg(
        F.avg("success_rate").alias("success_rate"),
        F.avg("latency").alias("latency"),
        F.max_by("level", F.struct("throughput", -F.col("level"))).alias("best_level"),
        F.max("throughput").alias("best_throughput"),
        ((F.max("latency") - F.min("latency")) / F.nullif(F.min("latency"), F.lit(0.0)) * 100).alias("degradation_pct"),
    )


def role_vote(votes: DataFrame, keys: Sequence[str], role: str = "role", confidence: str = "confidence") -> DataFrame:
    """Referee if it has strictly more votes, else player if it has any; with the winner's mean confidence."""
    n = {r: F.count_if(F.col(role) == r) for r in ("referee", "player")}
    mean = {r: F.avg(F.when(F.col(role) == r, F.col(confidence))) for r in n}
    counted = votes.groupBy(*keys).agg(*(n[r].alias(f"n_{r}") for r in n), *(mean[r].alias(f"c_{r}") for r in n))
    winner = F.when(F.col("n_referee") > F.col("n_player"), "referee").when(F.col("n_player") > 0, "player")
    return counted.select(*keys, winner.alias("role"), F.when(F.col("n_referee") > F.col("n_player"), F.col("c_referee")).otherwise(F.col("c_player")).alias("role_confidence")).filter("role IS NOT NULL")


def best_read(reads: DataFrame, keys: Sequence[str], order: str, value: str, confidence: str, enough: float = 0.8) -> DataFrame:
    """The first read that is sure enough, else the surest, the earlier of equal ones."""
    first = F.min(F.when(F.col(confidence) >= enough, F.struct(order, value, confidence)))
    surest = F.max_by(F.struct(order, value, confidence), F.struct(F.col(confidence), -F.col(order)))
    return reads.groupBy(*keys).agg(F.coalesce(first, surest).alias("_r")).select(*keys, f"_r.{value}", f"_r.{confidence}", f"_r.{order}")


def modal(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value of each group, the smallest of equally frequent ones, and its count."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), value))
    return counted.withColumn("_r", rank).filter("_r = 1").select(*keys, value, "votes")


def largest_box(boxes: DataFrame, keys: Sequence[str], area: str, order: str) -> DataFrame:
    """The representative box: the largest, the first of equal ones."""
    return boxes.groupBy(*keys).agg(F.max_by(F.col(order), F.struct(F.col(area), -F.col(order))).alias(order), F.max(area).alias(area))


def detection_quality(candidates: DataFrame, truths: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recall and precision of matched candidates with what was missed and found in vain."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    joined = n(truths, "truths").join(n(candidates, "candidates"), list(keys), "full_outer").join(n(matches, "matched"), list(keys), "left")
    full = joined.na.fill(0, ["truths", "candidates", "matched"])
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return full.select(
        *keys, "truths", "candidates", "matched", share("matched", "truths").alias("recall"), share("matched", "candidates").alias("precision"),
        (F.col("truths") - F.col("matched")).alias("missed"), (F.col("candidates") - F.col("matched")).alias("false_positives"),
    )


def signal_flags(df: DataFrame, keys: Sequence[str], order: str, value: str, most_drift: float, most_variance: float) -> DataFrame:
    """Variance, greatest and mean step of a signal, and the reasons for which it looks tampered with."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    agg = df.withColumn("_d", step).groupBy(*keys).agg(F.var_pop(value).alias("variance"), F.max("_d").alias("drift"), F.avg("_d").alias("mean_step"))
    reasons = F.array_compact(F.array(F.when(F.col("drift") > most_drift, "drift"), F.when(F.col("variance") > most_variance, "variance")))
    return agg.withColumn("reasons", F.concat_ws(",", reasons)).withColumn("flagged", F.size(reasons) > 0)


def inlier_summary(motion: DataFrame, keys: Sequence[str], ratio: str = "inlier_ratio") -> DataFrame:
    """Mean share of inliers of each video's camera motion; 0 without a known one."""
    return motion.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.avg(ratio), F.lit(0.0)).alias("mean_inlier_ratio"))


def file_integrity(frames: DataFrame, tags: DataFrame, key: str, window: float = 30.0, most: float = 12.0) -> DataFrame:
    """Signs of re-encoding, of each file of `tags` (key, encoder, creation_time).

    `frames` (key, pict_type) are those of the file's first `window` seconds; a file with frames
    should have a keyframe at least every `most` seconds. Empty tags count as missing.
    """
    typed = F.col("pict_type").isNotNull() & (F.col("pict_type") != "")
    counts = frames.groupBy(key).agg(F.count_if(typed).alias("sampled"), F.count_if(F.col("pict_type") == "I").alias("keyframes"))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    interval = F.when(F.col("keyframes") > 0, F.lit(window) / F.col("keyframes"))
    reasons = F.array_compact(F.array(
        F.when(~named("encoder") & ~named("creation_time"), "missing_encoder_and_creation_time_metadata"),
        F.when(interval > most, F.format_string("sparse_keyframe_interval_%.1fs", interval)).when((F.col("sampled") > 0) & (F.col("keyframes") == 0), "no_keyframe_in_sample_window"),
    ))
    joined = tags.join(counts, key, "left").na.fill(0, ["sampled", "keyframes"]).withColumn("reasons", reasons)
    flagged = F.size("reasons") > 0
    return joined.select(key, "sampled", "keyframes", F.round(interval, 2).alias("keyframe_interval"), "reasons", flagged.alias("flagged"), F.when(flagged, "medium").otherwise("low").alias("confidence"))
