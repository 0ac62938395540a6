"""Where players stand in a frame: the densest pile, its motion, and two facing lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapframe.functions.geometry import iou
from snapframe.operators.joins import overlapping
from snapframe.operators.sequences import bursts

Keys = Sequence[str]


def _centres(boxes: DataFrame, keys: Keys, who: str) -> DataFrame:
    """Centres with their frame's median width and number of boxes; frames are dealt by number, as they are small but make many neighbours."""
    whole = Window.partitionBy(*keys)
    width = F.col("bbox")[2] - F.col("bbox")[0]
    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return boxes.select(*keys, who, "bbox").repartition(parts, *keys).select(
        *keys, who, ((F.col("bbox")[0] + F.col("bbox")[2]) / 2).alias("x"), ((F.col("bbox")[1] + F.col("bbox")[3]) / 2).alias("y"), F.median(width).over(whole).alias("width"), F.count(F.lit(1)).over(whole).alias("n")
    )


def piles(boxes: DataFrame, keys: Keys, who: str = "track_id", reach: float = 8.0, least: int = 6) -> DataFrame:
    """Members of each frame's densest pile: keys, who, x, y, width.

    A pile is all within `reach` median box widths of one member, of the smallest id among equally
    dense ones; frames of fewer than `least` boxes, or piles of fewer, have none. Neighbours meet over
    cells as wide as their own frame's reach, so a frame's distant boxes make no pairs; only the
    counts of neighbours leave that join, and the members are looked up around the one centre.
    """
    c = _centres(boxes, keys, who).filter((F.col("n") >= least) & (F.col("width") > 0)).withColumn("_r", reach * F.col("width"))
    cell = lambda v: F.floor(F.col(v) / (F.col("_r") * (1 + 1e-9)))
    around = F.sequence(F.lit(-1), F.lit(1))
    here = c.withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    other = here.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_cy").alias("_oy"), F.explode(F.transform(around, lambda d: F.col("_cx") + d)).alias("_cx"))
    other = other.select(*keys, "_x", "_y", "_cx", F.explode(F.transform(around, lambda d: F.col("_oy") + d)).alias("_cy"))
    apart = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    near = here.join(other, [*keys, "_cx", "_cy"]).filter(apart <= F.col("_r"))
    dense = near.groupBy(*keys, who, "x", "y").agg(F.count(F.lit(1)).alias("_m"))
    centre = dense.groupBy(*keys).agg(F.min(F.struct((-F.col("_m")).alias("m"), who, "x", "y")).alias("_best")).filter(-F.col("_best.m") >= least)
    centre = centre.select(*keys, F.col("_best.x").alias("_x"), F.col("_best.y").alias("_y"))
    return c.join(centre, list(keys)).filter(apart <= F.col("_r")).select(*keys, who, "x", "y", "width")


def pile_motion(pile: DataFrame, keys: Keys, frame: str, who: str = "track_id") -> DataFrame:
    """Mean displacement, in widths, of the members shared with the frame before: keys, frame, motion.

    Null where the frame before has no pile or shares none.
    """
    before = pile.select(*keys, (F.col(frame) + 1).alias(frame), who, F.col("x").alias("_x"), F.col("y").alias("_y"))
    moved = pile.join(before, [*keys, frame, who], "left")
    step = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    return moved.groupBy(*keys, frame).agg((F.avg(step) / F.first("width")).alias("motion"))


def centroid_motion(pile: DataFrame, keys: Keys, frame: str) -> DataFrame:
    """Displacement of the pile's centre from the frame before, in widths."""
    c = pile.groupBy(*keys, frame).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.first("width").alias("width"))
    by = Window.partitionBy(*keys).orderBy(frame)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(by), 2) + F.pow(F.col("y") - F.lag("y").over(by), 2)) / F.col("width")
    return c.select(*keys, frame, F.when(F.lag(frame).over(by) == F.col(frame) - 1, step).alias("motion"))


def snaps_of_tracks(boxes: DataFrame, keys: Keys, frame: str, **limits: float) -> DataFrame:
    """Snaps, as keys and frame: a burst of the pile members' own motion after calm frames.

    `limits` are those of `bursts`. Frames without a pile count as frames without motion.
    """
    motion = pile_motion(piles(boxes, [*keys, frame]), keys, frame)
    return _snaps(boxes, motion, keys, frame, limits)


def snaps_of_detections(boxes: DataFrame, keys: Keys, frame: str, who: str = "detection_index", **limits: float) -> DataFrame:
    """As `snaps_of_tracks`, from boxes without identity: the motion is that of the pile's centre."""
    motion = centroid_motion(piles(boxes, [*keys, frame], who), keys, frame)
    return _snaps(boxes, motion, keys, frame, limits)


def _snaps(boxes: DataFrame, motion: DataFrame, keys: Keys, frame: str, limits: dict[str, float]) -> DataFrame:
    every = boxes.select(*keys, frame).distinct().join(motion, [*keys, frame], "left")
    return bursts(every, keys, frame, "motion", **limits)


def formations(boxes: DataFrame, keys: Keys, who: str = "track_id", group: int = 4, gap: float = 1.0, span: float = 6.0) -> DataFrame:
    """Frames split in two lines: keys, axis, gap and span in widths, sizes of both sides.

    Each axis is cut at its largest gap; the axis whose gap is the larger share of its extent
    counts, x of equal ones. Both sides need `group` members, the gap `gap` and the other axis
    `span` median box widths.
    """
    c = _centres(boxes, keys, who).filter((F.col("n") >= 2 * group) & (F.col("width") > 0))
    long = c.select(*keys, "n", "width", F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("x").alias("v")), F.struct(F.lit(1).alias("axis"), F.col("y").alias("v")))).alias("p")).select(*keys, "n", "width", "p.*")
    by = Window.partitionBy(*keys, "axis").orderBy("v")
    cut = long.withColumn("g", F.col("v") - F.lag("v").over(by)).withColumn("below", F.row_number().over(by) - 1)
    axes = cut.groupBy(*keys, "axis").agg(
        (F.max("v") - F.min("v")).alias("extent"), F.max("g").alias("gap_px"), F.max_by("below", F.struct("g", -F.col("below"))).alias("a"), F.first("n").alias("n"), F.first("width").alias("width")
    )
    axes = axes.withColumn("ratio", F.when((F.col("extent") > 0) & (F.col("gap_px") > 0), F.col("gap_px") / F.col("extent")))
    best = axes.filter("ratio IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ratio"), "axis"))).filter("r = 1")
    other = axes.select(*keys, (1 - F.col("axis")).alias("axis"), F.col("extent").alias("across"))
    split = best.join(other, [*keys, "axis"])
    return split.select(
        *keys, "axis", (F.col("gap_px") / F.col("width")).alias("gap"), (F.col("across") / F.col("width")).alias("span"), F.col("a").alias("group_a"), (F.col("n") - F.col("a")).alias("group_b")
    ).filter((F.col("group_a") >= group) & (F.col("group_b") >= group) & (F.col("gap") >= gap) & (F.col("span") >= span))


def crowded(boxes: DataFrame, keys: Keys, who: str = "track_id", overlap: float = 0.35, others: int = 2) -> DataFrame:
    """Whether a box overlaps at least `others` boxes of its frame by more than `overlap`."""
    a = boxes.select(*keys, who, "bbox")
    b = boxes.select(*keys, F.col(who).alias("_w"), F.col("bbox").alias("_b"))
    met = overlapping(a, b, keys, "bbox", "_b").filter((F.col(who) != F.col("_w")) & (iou(F.col("bbox"), F.col("_b")) > overlap))
    counts = met.groupBy(*keys, who).agg(F.count(F.lit(1)).alias("_n"))
    return boxes.join(counts, [*keys, who], "left").select(*boxes.columns, (F.coalesce("_n", F.lit(0)) >= others).alias("crowded"))
