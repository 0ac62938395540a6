"""Operators over ordered rows: masks, islands, thinning, ranges, debouncing, bursts.

Every function takes `keys`, the columns of a group (a video, a play, a track), and `order`, a
column that orders its rows. Windows are partitioned by the keys. Where a result depends on the
last row *kept* (thinning), a group's ordered values are folded by a built-in aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapframe.session import cut

Keys = Sequence[str]


def _by(keys: Keys, *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def _upto(keys: Keys, *order: str | Column):
    return _by(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def position(df: DataFrame, keys: Keys, order: str, name: str = "position") -> DataFrame:
    """Number the rows of each group from zero."""
    return df.withColumn(name, F.row_number().over(_by(keys, order)) - 1)


# --------------------------------------------------------------------------- motion, segments


def motion_mask(df: DataFrame, keys: Keys, order: str, value: str, threshold: float = 0.02, name: str = "moving") -> DataFrame:
    """True where a value moved by more than `threshold` since the row before; false on the first."""
    moved = F.abs(F.col(value) - F.lag(value).over(_by(keys, order))) > threshold
    return df.withColumn(name, F.coalesce(moved, F.lit(False)))


def islands(df: DataFrame, keys: Keys, order: str, flag: str) -> DataFrame:
    """Runs of equal `flag`: keys, flag, first and last order value, rows."""
    change = F.coalesce((~F.col(flag).eqNullSafe(F.lag(flag).over(_by(keys, order)))).cast("int"), F.lit(1))
    numbered = df.withColumn("_change", change).withColumn("_run", F.sum("_change").over(_upto(keys, order)))
    return numbered.groupBy(*keys, "_run", flag).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("rows")).drop("_run")


def static_segments(df: DataFrame, keys: Keys, order: str, static: str, gap: int = 30, least: int = 15, most: int = 300) -> DataFrame:
    """Segments that end where `gap` static rows in a row have passed: keys, start, end, duration.

    start and end are row positions. A run of static rows closes a segment at each multiple of
    `gap`; the next one starts there whether or not the closed one was long enough to be kept.
    """
    rows = position(df, keys, order, "i")
    rows = rows.withColumn("_run", F.sum(F.when(F.col(static), 0).otherwise(1)).over(_upto(keys, "i")))
    in_run = F.sum(F.col(static).cast("int")).over(_upto([*keys, "_run"], "i"))
    rows = rows.withColumn("_closes", F.col(static) & (in_run > 0) & (in_run % gap == 0))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ends = rows.withColumn("_n", size).filter(F.col("_closes") | (F.col("i") == F.col("_n") - 1))
    # The last row of a group is the tail's end; if it also closes a segment, it stands for both.
    marked = ends.select(*keys, "i", "_n", F.explode(F.array_compact(F.array(F.when(F.col("_closes"), F.lit(0)), F.when(F.col("i") == F.col("_n") - 1, F.lit(1))))).alias("_tail"))
    start = F.coalesce(F.lag("i").over(_by(keys, "i", "_tail")), F.lit(0))
    spans = marked.withColumn("start", start).withColumn("end", F.when(F.col("_tail") == 1, F.col("i")).otherwise(F.col("i") - gap))
    long_enough = (F.col("i") - F.col("start") >= least) & ((F.col("_tail") == 1) | (F.col("start") < F.col("end")))
    kept = spans.filter(long_enough).withColumn("duration", F.col("end") - F.col("start") + 1)
    return kept.filter(F.col("duration").between(least, most)).select(*keys, "start", "end", "duration")


def transitions(df: DataFrame, keys: Keys, order: str, x: str, y: str) -> DataFrame:
    """Positions at which a path's step departs from its smoothed steps: keys, position.

    Steps are smoothed over five, missing neighbours counting as zero; an outlier differs by more
    than the mean plus one population deviation, and is reported two rows on.
    """
    by = _by(keys, "i")
    rows = position(df, keys, order, "i")
    step = F.sqrt(F.pow(F.lead(x).over(by) - F.col(x), 2) + F.pow(F.lead(y).over(by) - F.col(y), 2))
    steps = rows.withColumn("_d", step).filter("_d IS NOT NULL")
    smooth = F.sum("_d").over(by.rowsBetween(-2, 2)) / 5
    off = steps.withColumn("_off", F.abs(F.col("_d") - smooth))
    whole = Window.partitionBy(*keys)
    limit = F.avg("_off").over(whole) + F.stddev_pop("_off").over(whole)
    return off.withColumn("_limit", limit).filter("_off > _limit").select(*keys, (F.col("i") + 2).alias("position"))


def segments_between(found: DataFrame, sizes: DataFrame, keys: Keys, least: int = 15) -> DataFrame:
    """Cut 0..n-1 at the given positions: keys, segment_index, start, end; neighbours share a row.

    `sizes` has the keys and n. Segments shorter than `least` rows go; a group in which none is
    left, or of fewer than `least` rows, is one segment.
    """
    keyed = list(keys)
    bounds = sizes.select(*keyed, F.lit(0).cast("long").alias("position"))
    bounds = bounds.union(sizes.select(*keyed, (F.col("n") - 1).cast("long"))).union(found.select(*keyed, F.col("position").cast("long"))).distinct()
    cut = bounds.withColumn("end", F.lead("position").over(_by(keys, "position"))).filter("end IS NOT NULL").withColumnRenamed("position", "start")
    cut = cut.join(sizes, keyed).filter((F.col("end") - F.col("start") + 1 >= least) & (F.col("n") >= least)).select(*keyed, "start", "end")
    whole = sizes.join(cut.select(*keyed).distinct(), keyed, "left_anti").select(*keyed, F.lit(0).cast("long").alias("start"), (F.col("n") - 1).cast("long").alias("end"))
    return cut.unionByName(whole).withColumn("segment_index", F.row_number().over(_by(keys, "start")) - 1)


# --------------------------------------------------------------------------- thinning, ranges


def sessions(df: DataFrame, keys: Keys, at: str, far: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows with a number _session, which rises at each row that is `far` from the row before in order of `at`.

    Rows without a comparison, null ones included, start a session.
    """
    by = _by(keys, at)
    starts = F.coalesce(far(F.col(at), F.lag(at).over(by)), F.lit(True)).cast("long")
    return df.withColumn("_starts", starts).withColumn("_session", F.sum("_starts").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_starts")


LONG_CHAIN = 100_000
CELL = 1024


def thin(df: DataFrame, keys: Keys, at: str, gap: float, inclusive: bool = False) -> DataFrame:
    """Keep a row only if it is more than `gap` (with `inclusive`, at least) after the last row kept.

    Result: keys and the kept values of `at`. Equal values count once, nulls not at all. A row that
    far from the row before is always kept, so a key's rows are cut there and folded piece by piece.
    Pieces of more than LONG_CHAIN rows are not gathered but thinned by `_thin_chains`, to the same result.
    """
    far = (lambda x, last: x - last >= gap) if inclusive else (lambda x, last: x - last > gap)
    kind = df.schema[at].dataType.simpleString()
    pieces = sessions(df.filter(F.col(at).isNotNull()), keys, at, far)
    sizes = pieces.groupBy(*keys, "_session").agg(F.count(F.lit(1)).alias("_size"))
    long = sizes.filter(F.col("_size") > LONG_CHAIN).drop("_size")
    first = F.array().cast(f"array<{kind}>")
    fold = F.aggregate(F.col("_all"), first, lambda kept, x: F.when((F.size(kept) == 0) | far(x, F.element_at(kept, -1)), F.array_append(kept, x)).otherwise(kept))
    folded = lambda rows: rows.groupBy(*keys, "_session").agg(F.array_sort(F.collect_set(at)).alias("_all")).select(*keys, F.explode(fold).alias(at))
    if long.isEmpty():
        return folded(pieces)
    parts = [pieces.join(long, _equal(pieces, long, [*keys, "_session"]), how) for how in ("left_anti", "left_semi")]
    return folded(parts[0]).unionByName(_thin_chains(parts[1].select(*keys, "_session", at).distinct(), keys, at, gap, inclusive))


def _equal(left: DataFrame, right: DataFrame, keys: Keys) -> Column:
    """Join condition on equal keys, null equal to null."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def _thin_chains(values: DataFrame, keys: Keys, at: str, gap: float, inclusive: bool) -> DataFrame:
    """Thinning of unbroken chains (keys, _session, distinct values) in rounds that grow with the logarithm of what is kept.

    Every value's successor is the next value far enough from it. In a chain it is at most two gaps
    away, so it is found within cells of CELL gaps, each holding a copy of the next one's beginning.
    What is kept is what can be reached from a chain's first value; each round follows all jumps found so
    far and doubles them. Rows are spread by value, and every round is written.
    """
    group = [*keys, "_session"]
    width = float(gap) * CELL
    cell = lambda c: F.floor(c / width)
    x = F.col(at)
    # A value v looks for the first point after v + gap: both stand in one order, points first or last at equal places.
    points = values.select(*group, x.alias("_place"), F.lit(1 if inclusive else 0).alias("_turn"), x.alias("_point"), F.lit(None).cast(values.schema[at].dataType).alias("_from"))
    probes = values.select(*group, (x + gap).cast(values.schema[at].dataType).alias("_place"), F.lit(0 if inclusive else 1).alias("_turn"), F.lit(None).cast(values.schema[at].dataType).alias("_point"), x.alias("_from"))
    own = points.unionByName(probes).withColumn("_cell", cell(F.col("_place")))
    ahead = points.filter(F.col("_place") - cell(F.col("_place")) * width <= 2 * gap).withColumn("_cell", cell(F.col("_place")) - 1)
    by = Window.partitionBy(*group, "_cell").orderBy("_place", "_turn").rowsBetween(1, Window.unboundedFollowing)
    jumps = own.unionByName(ahead).withColumn("_next", F.first("_point", ignorenulls=True).over(by)).filter(F.col("_from").isNotNull() & F.col("_next").isNotNull())
    jumps = cut(jumps.select(*group, "_from", "_next"), "jumps")
    kept = cut(values.groupBy(*group).agg(F.min(at).alias("_from")), "kept")
    names = [f"_key{i}" for i in range(len(group))]
    renamed = lambda df, a, b: df.select(*(F.col(k).alias(n) for k, n in zip(group, names, strict=True)), F.col("_from").alias(a), F.col("_next").alias(b))
    met = lambda left, right, column: reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[n]) for k, n in zip(group, names, strict=True))) & (left[column] == right["_mid"])
    size = kept.count()
    while True:
        onward = renamed(jumps, "_mid", "_far")
        reached = kept.join(onward, met(kept, onward, "_from")).select(*group, F.col("_far").alias("_from"))
        kept = cut(kept.unionByName(reached).distinct(), "kept")
        if (now := kept.count()) == size:
            return kept.select(*keys, F.col("_from").alias(at))
        size = now
        jumps = cut(jumps.join(onward, met(jumps, onward, "_next")).select(*group, "_from", F.col("_far").alias("_next")), "jumps")


def merge_candidates(lists: Sequence[DataFrame], keys: Keys, at: str, window: float) -> DataFrame:
    """Union of candidate lists, thinned so that the earlier of near ones stays."""
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    return thin(every.select(*keys, at), keys, at, window)


def ranges(points: DataFrame, lasts: DataFrame, keys: Keys, at: str) -> DataFrame:
    """Contiguous ranges that start at the points and cover 0..last: keys, index, start, end.

    `lasts` has the keys and last. The first range starts at 0; a group without points is one range.
    """
    keyed = list(keys)
    full = lasts.join(points, keyed, "left")
    by = _by(keys, at)
    return full.select(
        *keyed,
        (F.row_number().over(by) - 1).alias("index"),
        F.when(F.row_number().over(by) == 1, F.lit(0)).otherwise(F.col(at)).cast("long").alias("start"),
        F.coalesce(F.lead(at).over(by) - 1, F.col("last")).cast("long").alias("end"),
    )


def sample_evenly(df: DataFrame, keys: Keys, order: str, n: int) -> DataFrame:
    """At most n rows of each group, at positions int(i * size / n)."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = position(df, keys, order, "_i").withColumn("_size", size)
    step = F.greatest(F.col("_size"), F.lit(n))
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_size") / n))
    return rows.filter((step == n) | F.array_contains(picked, F.col("_i").cast("long"))).drop("_i", "_size")


def sample_stride(df: DataFrame, keys: Keys, order: str, fps: float, sample_fps: float) -> DataFrame:
    """Every step-th row, the step being fps / sample_fps rounded half to even and at least 1."""
    step = max(1, round(fps / sample_fps))
    return position(df, keys, order, "_i").filter(F.col("_i") % step == 0).drop("_i")


def sample_rate(df: DataFrame, keys: Keys, seconds: str, fps: float) -> DataFrame:
    """The first row of every 1 / fps seconds."""
    slot = F.floor(F.col(seconds) * fps)
    first = F.row_number().over(Window.partitionBy(*keys, slot).orderBy(seconds))
    return df.withColumn("_first", first).filter("_first = 1").drop("_first")


# --------------------------------------------------------------------------- debounce, clocks, gaps


def debounce(df: DataFrame, keys: Keys, order: str, value: str) -> DataFrame:
    """Rows at which a value, null included, has been read twice in a row and is a new non-null one."""
    by = _by(keys, order)
    twice = (F.row_number().over(by) > 1) & F.col(value).eqNullSafe(F.lag(value).over(by))
    rows = df.withColumn("_sure", F.when(twice, F.struct(F.col(value).alias("v"))))
    rows = rows.withColumn("_now", F.last("_sure", ignorenulls=True).over(_upto(keys, order)))
    rows = rows.withColumn("_before", F.lag("_now").over(by))
    fresh = F.col("_now.v").isNotNull() & ~F.col("_now.v").eqNullSafe(F.col("_before.v"))
    return rows.filter(fresh).drop("_sure", "_now", "_before")


def reject_replays(df: DataFrame, keys: Keys, order: str, quarter: str, seconds: str) -> DataFrame:
    """Rows whose game clock does not go back behind the latest one seen; unread clocks stay."""
    key = F.when(F.col(quarter).isNotNull() & F.col(seconds).isNotNull(), F.struct(F.col(quarter).alias("q"), (-F.col(seconds)).alias("s")))
    latest = F.max("_clock").over(_by(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_clock", key).withColumn("_latest", latest)
    return rows.filter(F.col("_clock").isNull() | F.col("_latest").isNull() | (F.col("_clock") >= F.col("_latest"))).drop("_clock", "_latest")


def hold_last(df: DataFrame, keys: Keys, at: str, value: str) -> DataFrame:
    """One row per step from a group's first to last: keys, at, value, known.

    Gaps hold the value before them; `known` tells rows that were there.
    """
    spans = df.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    steps = spans.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(at))
    joined = steps.join(df.select(*keys, at, value, F.lit(True).alias("known")), [*keys, at], "left")
    held = F.last(value, ignorenulls=True).over(_upto(keys, at))
    return joined.select(*keys, at, held.alias(value), F.coalesce("known", F.lit(False)).alias("known"))


def coverage(held: DataFrame, keys: Keys, least: float = 0.9) -> DataFrame:
    """Share of known steps of each group, and whether it is enough to draw on."""
    return held.groupBy(*keys).agg(F.avg(F.col("known").cast("int")).alias("coverage")).withColumn("usable", F.col("coverage") >= least)


# --------------------------------------------------------------------------- smoothing, bursts


def moving_average(df: DataFrame, keys: Keys, order: str, value: str, reach: int = 1, name: str = "smooth") -> DataFrame:
    return df.withColumn(name, F.avg(value).over(_by(keys, order).rowsBetween(-reach, reach)))


def smooth_keypoints(df: DataFrame, keys: Keys, order: str, landmarks: str = "landmarks", reach: int = 1) -> DataFrame:
    """keys, order and the landmarks with each keypoint's place averaged over the rows up to `reach` before and after.

    A keypoint is averaged over those of the rows that have it and keeps its own confidence; one that a row
    lacks is not made up. Rows without landmarks have an empty map.
    """
    rows = position(df, keys, order, "_i")
    long = rows.select(*keys, order, "_i", F.explode(landmarks).alias("_name", "_p"))
    near = Window.partitionBy(*keys, "_name").orderBy("_i").rangeBetween(-reach, reach)
    mean = lambda c: F.avg(f"_p.{c}").over(near).alias(c)
    smooth = long.select(*keys, order, "_i", F.struct("_name", F.struct(mean("x"), mean("y"), mean("z"), F.col("_p.confidence").alias("confidence")).alias("p")).alias("_e"))
    maps = smooth.groupBy(*keys, "_i").agg(F.map_from_entries(F.sort_array(F.collect_list("_e"))).alias("_map"))
    named = maps.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_i").alias("_at"), "_map")
    met = F.col("_i") == F.col("_at")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    empty = F.create_map().cast(maps.schema["_map"].dataType)
    return rows.join(named, met, "left").select(*keys, order, F.coalesce("_map", empty).alias(landmarks))


def shrinkage(df: DataFrame, keys: Keys, at: str, value: str, name: str = "shrink") -> DataFrame:
    """How much a value fell since the step before, at least 0; null where that step is missing."""
    by = _by(keys, at)
    fell = F.greatest(F.lit(0.0), F.lag(value).over(by) - F.col(value))
    return df.withColumn(name, F.when(F.lag(at).over(by) == F.col(at) - 1, fell))


def bursts(df: DataFrame, keys: Keys, order: str, value: str, calm: float = 0.15, burst: float = 0.8, streak: int = 4, cooldown: int = 7) -> DataFrame:
    """Rows at which a value jumps to `burst` after `streak` calm ones: keys and order.

    Null values change nothing; values between calm and burst end a streak. A burst counts only
    `cooldown` rows, null ones included, after the last one that counted.
    """
    rows = position(df, keys, order, "_row")
    known = rows.filter(F.col(value).isNotNull())
    breaks = F.sum((F.col(value) > calm).cast("int")).over(_by(keys, "_row").rowsBetween(Window.unboundedPreceding, -1))
    runs = known.withColumn("_run", F.coalesce(breaks, F.lit(0)))
    calm_before = F.sum((F.col(value) <= calm).cast("int")).over(_by([*keys, "_run"], "_row").rowsBetween(Window.unboundedPreceding, -1))
    ready = runs.withColumn("_calm", F.coalesce(calm_before, F.lit(0))).filter((F.col(value) >= burst) & (F.col("_calm") >= streak))
    kept = thin(ready.select(*keys, "_row"), keys, "_row", cooldown, inclusive=True)
    return rows.join(kept, [*keys, "_row"]).select(*keys, order)
