"""The playing field's outline, moved onto the painted lines that run along it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = 22.0
TURN_DEGREES = 20.0
GRID = float(1 << 40)  # sums of multiples of 1 / GRID are exact below 8,192


def _mean(c: str) -> Column:
    """The mean in whatever order rows come: high and low bits of the values are summed apart, so that only the end is rounded."""
    high = F.floor(F.col(c) * GRID) / GRID
    return (F.sum(high) + F.sum(F.col(c) - high)) / F.count(c)


def snap_to_lines(corners: DataFrame, lines: DataFrame, keys: Sequence[str], band: float = BAND, turn: float = TURN_DEGREES) -> DataFrame:
    """Corners (keys, corner from 0 on, x, y) moved by the lines (keys, x1, y1, x2, y2) of their picture, in whole pixels.

    A line counts for an edge if it turns from it by at most `turn` degrees, its middle lies beside the edge
    and at most `band` away. An edge whose lines agree (deviation of at most half a band) moves by their
    mean offset. Each corner moves by the mean of its two edges' moves; offsets are all taken from
    the outline as it came, and summed so that the order of lines does not decide where a corner is cut to
    a whole pixel. Edges and lines without length count for nothing. A picture's outline has few
    edges, so its lines meet each of them.
    """
    keys = list(keys)
    by = Window.partitionBy(*keys).orderBy("corner")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole))
    edges = corners.select(*keys, "corner", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), following("corner").alias("_next"), *(following(c).cast("double").alias(f"_{c}") for c in ("x", "y")))
    length = F.sqrt(F.pow(F.col("_x") - F.col("x"), 2) + F.pow(F.col("_y") - F.col("y"), 2))
    edges = edges.withColumn("_len", length).filter("_len >= 1e-6").withColumns({"_dx": (F.col("_x") - F.col("x")) / F.col("_len"), "_dy": (F.col("_y") - F.col("y")) / F.col("_len")})
    span = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    drawn = lines.select(*keys, span.alias("_span"), *((F.col(b) - F.col(a)).alias(n) for n, a, b in (("_lx", "x1", "x2"), ("_ly", "y1", "y2"))), *(((F.col(a) + F.col(b)) / 2).alias(n) for n, a, b in (("_mx", "x1", "x2"), ("_my", "y1", "y2")))).filter("_span >= 1e-6")
    met = edges.join(drawn, keys)
    parallel = F.abs(F.col("_dx") * F.col("_lx") + F.col("_dy") * F.col("_ly")) / F.col("_span") >= F.cos(F.radians(F.lit(turn)))
    along = (F.col("_mx") - F.col("x")) * F.col("_dx") + (F.col("_my") - F.col("y")) * F.col("_dy")
    offset = (F.col("_my") - F.col("y")) * F.col("_dx") - (F.col("_mx") - F.col("x")) * F.col("_dy")
    fits = met.filter(parallel & along.between(0.0, F.col("_len")) & (F.abs(offset) <= band)).withColumn("_off", offset)
    # Offset times length: exact for whole pixels, and so are its sums; they tell the deviation.
    cross = (F.col("_my") - F.col("y")) * (F.col("_x") - F.col("x")) - (F.col("_mx") - F.col("x")) * (F.col("_y") - F.col("y"))
    fits = fits.withColumn("_c", cross).withColumn("_square", F.pow(F.col("_x") - F.col("x"), 2) + F.pow(F.col("_y") - F.col("y"), 2))
    n, spread = F.count(F.lit(1)), F.count(F.lit(1)) * F.sum(F.col("_c") * F.col("_c")) - F.sum("_c") * F.sum("_c")
    moves = fits.groupBy(*keys, "corner", "_next", "_dx", "_dy").agg(_mean("_off").alias("_mean"), (spread <= (band / 2) ** 2 * F.first("_square") * n * n).alias("_agree")).filter("_agree")
    ends = moves.select(*keys, F.explode(F.array("corner", "_next")).alias("corner"), (-F.col("_dy") * F.col("_mean")).alias("_sx"), (F.col("_dx") * F.col("_mean")).alias("_sy"))
    shifts = ends.groupBy(*keys, "corner").agg(F.avg("_sx").alias("_sx"), F.avg("_sy").alias("_sy"))
    moved = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0.0))).cast("int").alias(c)
    return corners.join(shifts, [*keys, "corner"], "left").select(*keys, "corner", moved("x", "_sx"), moved("y", "_sy"))
