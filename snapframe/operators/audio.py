"""Whistle events from audio tables: energy, peaks, fusion, filtering, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapframe.functions.scores import clip
from snapframe.operators.sequences import islands, sessions

WEIGHTS = {"onset": 0.40, "energy": 0.35, "spectral": 0.25}
EVENT = ("timestamp", "confidence", "onset_strength", "spectral_centroid", "duration")


def short_time_energy(samples: DataFrame, keys: Sequence[str], index: str, value: str, hop: int) -> DataFrame:
    """Mean square of each whole block of `hop` samples: keys, frame, energy."""
    blocks = samples.groupBy(*keys, F.floor(F.col(index) / hop).alias("frame")).agg(F.avg(F.col(value) * F.col(value)).alias("energy"), F.count(F.lit(1)).alias("_n"))
    return blocks.filter(F.col("_n") == hop).drop("_n")


def energy_peaks(energy: DataFrame, keys: Sequence[str], quantile: float = 0.75, floor: float = 0.0) -> DataFrame:
    """Frames louder than both the floor and the group's quantile."""
    limits = energy.groupBy(*keys).agg(F.greatest(F.percentile("energy", F.lit(quantile)), F.lit(floor)).alias("_limit"))
    return energy.join(limits, list(keys)).filter("energy > _limit").drop("_limit")


def fuse(onset: Column, energy: Column, centroid: Column, low: float = 2000.0, high: float = 4000.0) -> Column:
    """Weighted sum of an onset strength, a loud frame and a centroid within the whistle band, in 0..1."""
    in_band = F.when(centroid.between(low, high), 1.0).otherwise(0.0)
    return clip(WEIGHTS["onset"] * onset + WEIGHTS["energy"] * F.coalesce(energy, F.lit(0.0)) + WEIGHTS["spectral"] * F.coalesce(in_band, F.lit(0.0)), 0.0, 1.0)


def plausible(events: DataFrame, confidence: float = 0.5, shortest: float = 0.05, longest: float = 2.0) -> DataFrame:
    return events.filter((F.col("confidence") >= confidence) & F.col("duration").between(shortest, longest))


def peak_runs(peaks: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """Runs of adjacent peak frames: keys, first, last, rows."""
    by = Window.partitionBy(*keys).orderBy(frame)
    marked = peaks.withColumn("_run", F.col(frame) - F.row_number().over(by))
    return islands(marked, keys, frame, "_run").drop("_run")


def merge_events(events: DataFrame, keys: Sequence[str], gap: float = 0.1) -> DataFrame:
    """Events at most `gap` seconds after the one before, folded into it in order of time.

    The merged event takes the time of the surer one, averages the other figures pairwise and
    keeps the longer duration; the next event is compared with the merged one's time. That time is
    never after the event before, so a key's events are cut at wider gaps and folded piece by piece.
    """
    kind = "array<struct<" + ",".join(f"{c}:double" for c in EVENT) + ">>"
    row = F.struct(*(F.col(c).cast("double").alias(c) for c in EVENT))
    half = lambda a, b, c: ((a[c] + b[c]) / 2).alias(c)

    def merged(a: Column, b: Column) -> Column:
        at = F.when(b["confidence"] > a["confidence"], b["timestamp"]).otherwise(a["timestamp"])
        sure = clip((a["confidence"] + b["confidence"]) / 2, 0.0, 1.0)
        return F.struct(at.alias("timestamp"), sure.alias("confidence"), half(a, b, "onset_strength"), half(a, b, "spectral_centroid"), F.greatest(a["duration"], b["duration"]).alias("duration"))

    def step(done: Column, e: Column) -> Column:
        last = F.element_at(done, -1)
        near = (F.size(done) > 0) & (e["timestamp"] - last["timestamp"] <= gap)
        return F.when(near, F.array_append(F.slice(done, 1, F.size(done) - 1), merged(last, e))).otherwise(F.array_append(done, e))

    cut = sessions(events, keys, "timestamp", lambda at, before: at - before > gap)
    grouped = cut.groupBy(*keys, "_session").agg(F.sort_array(F.collect_list(row)).alias("_all"))
    folded = F.aggregate("_all", F.array().cast(kind), step)
    return grouped.select(*keys, F.explode(folded).alias("_e")).select(*keys, "_e.*")


def whistles(samples: DataFrame, keys: Sequence[str], index: str, value: str, hop: int, rate: float, limit: float, full: float = 1.0, gap: float = 0.1) -> DataFrame:
    """Whistles of whole recordings: keys and the columns of EVENT.

    A whistle is a run of adjacent blocks of `hop` samples whose energy is above `limit`; its strength is
    the greatest energy, and counts in full from `full` on. Runs at most `gap` seconds apart are merged.
    The limit is fixed and not the recording's own quantile, so that a part of it can be judged.
    """
    loud = short_time_energy(samples, keys, index, value, hop).filter(F.col("energy") > limit)
    run = F.col("frame") - F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    runs = loud.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("frame").alias("first"), F.count(F.lit(1)).alias("rows"), F.max("energy").alias("peak"))
    seconds = hop / rate
    found = runs.select(
        *keys, (F.col("first") * seconds).alias("timestamp"), fuse(clip(F.col("peak") / full, 0.0, 1.0), F.lit(1.0), F.lit(None).cast("double")).alias("confidence"), F.col("peak").alias("onset_strength"),
        F.lit(0.0).alias("spectral_centroid"), (F.col("rows") * seconds).alias("duration"),
    )
    return merge_events(found, keys, gap)
