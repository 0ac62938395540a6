"""Mixing sources to target weights along a time-varying curriculum.

Targets: a word budget is shared over the sources by weight; a source that would be repeated
more than `max_repeat` times stops there and its excess is shared among the rest. The final
targets have the form min(cap, weight * level), so the level is found in closed form from one
row per source instead of by rounds.

Documents: each source is read in a fixed shuffled order, again from the start for a second
epoch, until its target is used up, so the words taken equal the rounded target.

Positions: source s asks for words at the rate target_s * (1 + ramp_s * (2t - 1)) at training
time t in [0, 1]. Its integral, the cumulative demand, is inverted at each copy's cumulative
words to give the time at which that copy is read; documents are range-sorted by that time.

Only DataFrame functions are used. Running sums go through hash buckets, so that a hot source
is summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapframe.llm.common import WORD, free_name, materialise

WEIGHTS = (5, 2, 1)
RAMPS = (0.5, 0.0, -0.5)
BUDGET_SHARE = 1.5
MAX_REPEAT = 2
BUCKET_DIGITS = 3


def _row_key() -> Column:
    """Tells rows apart by id, source and text, nulls included."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), "text")


def source_targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, share: float = BUDGET_SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source, source_size, weight, ramp, target.

    `sizes` has source and source_size. Weights and ramps repeat over the sources in code point
    order, null last. These windows hold one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("rank") % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", pick(weights)).withColumn("ramp", pick(ramps))
    capped = ranked.withColumn("cap", F.col("source_size") * max_repeat)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levelled = capped.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    # The first source, by cap per weight, that the level does not fill sets the level for all.
    levelled = levelled.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return levelled.select("source", "source_size", "weight", "ramp", target.alias("target"))


def demand_time(words: Column, target: Column, ramp: Column) -> Column:
    """Inverse of the cumulative demand target * ((1 - ramp) * t + ramp * t * t), in [0, 1]."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), words / F.nullif(target, F.lit(0.0))))
    curved = (F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * part) - (1 - ramp)) / F.nullif(2 * ramp, F.lit(0.0))
    return F.coalesce(F.when(ramp == 0, part).otherwise(curved), F.lit(0.0))


def mix(docs: DataFrame, weights=WEIGHTS, ramps=RAMPS, share: float = BUDGET_SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, source, first_time, second_time, row_key.

    Null text has size 0; a null source is a source of its own, ranked last; null doc_ids order
    first and rows equal in doc_id are told apart by their size and a row counter. The times are
    those of the first and second copy, null where none is taken. Empty input gives an empty
    result. Rows come out range-sorted by first_time, untaken ones last.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(key)
    rows = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), digest.alias("shuffle"), F.substring(digest, 1, BUCKET_DIGITS).alias("bucket"), _row_key().alias("row_key")),
        "mix-sizes",
    )
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    start = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    starts = sums.withColumn("start", start).withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    sizes = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, weights, ramps, share, max_repeat).withColumnRenamed("source", "t")
    starts = starts.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t", "bucket_size")
    within = Window.partitionBy("source", "bucket").orderBy("shuffle", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("upto", F.sum("size").over(within))
    placed = summed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    begin = F.col("start") + F.col("upto") - F.col("size")
    want = F.round("target").cast("long")

    def copy(epoch: int) -> Column:
        return F.least(F.col("size"), F.greatest(F.lit(0), want - begin - F.col("source_size") * epoch))

    def time(epoch: int) -> Column:
        at = demand_time((begin + F.col("source_size") * epoch).cast("double"), F.col("target"), F.col("ramp").cast("double"))
        return F.when(copy(epoch) > 0, at)

    taken = sum((copy(e) for e in range(1, max_repeat)), copy(0))
    mixed = placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", time(0).alias("first_time"), time(1).alias("second_time"), "row_key")
    return mixed.orderBy(F.col("first_time").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, position: str | None = None) -> DataFrame:
    """The documents in training order, each repeated as often as the mix takes it.

    A column named by `position` (with underscores added where the input has it) tells the training
    time in [0, 1] at which a copy is read: files keep no order, so readers sort by it. A copy of which the mix takes at
    least half is kept whole, others go, so that texts are never cut. Rows without words are not
    drawn by any demand and go. Null ids and sources are as in mix(). Rows equal in id, source and
    text are drawn one by one, though it is not told which of them takes which copy. Empty input
    gives an empty result; extra columns of any name are carried along.
    """
    taken = mix(docs)
    half = lambda e: F.col("taken") * 2 >= F.col("size") * (2 * e + 1)
    times = F.array_compact(F.array(F.when(half(0), F.col("first_time")), F.when(half(1), F.col("second_time"))))
    drawn = taken.select(F.col("row_key").alias("mix_key"), times.alias("mix_times"), F.row_number().over(Window.partitionBy("row_key").orderBy("first_time")).alias("mix_twin"))
    packed = docs.select(F.struct("*").alias("row"), _row_key().alias("own_key"))
    packed = packed.withColumn("twin", F.row_number().over(Window.partitionBy("own_key").orderBy(F.lit(0))))
    # As a range the twin's number is no join key, so the texts are shuffled once, for window and join.
    same = (F.col("own_key") == F.col("mix_key")) & (F.col("twin") <= F.col("mix_twin")) & (F.col("twin") >= F.col("mix_twin"))
    timed = packed.join(drawn.filter(F.size("mix_times") > 0), same).select("row", F.explode("mix_times").alias("mix_time"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return timed.repartitionByRange(parts, "mix_time").sortWithinPartitions("mix_time").select("row.*", *([F.col("mix_time").alias(free_name(position, docs.columns))] if position else []))
