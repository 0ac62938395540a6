"""Column expressions for boxes, points, polygons, keypoint maps and homographies.

Boxes are arrays [x0, y0, x1, y1]; homographies are row-major arrays of nine; keypoints are maps
from a name to a struct (x, y, z, confidence).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keypoints of the torso's centre and of its crop.
CROP_KEYPOINTS = ("nose", "left_shoulder", "right_shoulder", "left_hip", "right_hip", "left_elbow", "right_elbow")
TORSO = ("left_shoulder", "right_shoulder", "left_hip", "right_hip")


def width(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0])


def height(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[3] - box[1])


def area(box: Column) -> Column:
    """Area; 0 for a null or malformed box."""
    return F.when(F.size(box) == 4, F.coalesce(width(box) * height(box), F.lit(0.0))).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where both are empty."""
    across = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    down = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = across * down
    union = width(a) * height(a) + width(b) * height(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def foot(box: Column) -> Column:
    """Bottom centre of a box."""
    return F.struct(((box[0] + box[2]) / 2).alias("x"), box[3].alias("y"))


def padded_box(box: Column, padding: float, frame_width: int, frame_height: int, least: int = 1) -> Column:
    """A box grown by a share of its sides, clamped to the frame and at least `least` pixels wide and high, in whole pixels."""
    dx, dy = width(box) * padding, height(box) * padding
    x0 = F.greatest(F.lit(0), (box[0] - dx).cast("int"))
    y0 = F.greatest(F.lit(0), (box[1] - dy).cast("int"))
    x1 = F.least(F.lit(frame_width), F.greatest((box[2] + dx).cast("int"), x0 + least))
    y1 = F.least(F.lit(frame_height), F.greatest((box[3] + dy).cast("int"), y0 + least))
    return F.array(x0, y0, x1, y1)


def torso_box(keypoints: Column, frame_width: Column, frame_height: Column) -> Column:
    """Whole-pixel box around the confident torso keypoints, padded, clamped and at least 64 x 128.

    Null for fewer than three keypoints of more than 0.3 confidence.
    """
    points = F.filter(F.array(*(keypoints[k] for k in CROP_KEYPOINTS)), lambda p: p.isNotNull() & (p["confidence"] > 0.3))
    xs = F.transform(points, lambda p: (p["x"] * frame_width).cast("int"))
    ys = F.transform(points, lambda p: (p["y"] * frame_height).cast("int"))
    x0 = F.greatest(F.lit(0), (F.array_min(xs) - frame_width * 0.05).cast("int"))
    x1 = F.least(frame_width, (F.array_max(xs) + frame_width * 0.05).cast("int"))
    y0 = F.greatest(F.lit(0), (F.array_min(ys) - frame_height * 0.05).cast("int"))
    y1 = F.least(frame_height, (F.array_max(ys) + frame_height * 0.15).cast("int"))
    cx, cy = F.floor((x0 + x1) / 2).cast("int"), F.floor((y0 + y1) / 2).cast("int")
    least = F.array(F.greatest(F.lit(0), cx - 32), F.greatest(F.lit(0), cy - 64), F.least(frame_width, cx + 32), F.least(frame_height, cy + 64))
    box = F.when((x1 - x0 < 64) | (y1 - y0 < 128), least).otherwise(F.array(x0, y0, x1, y1))
    return F.when(F.size(points) >= 3, box)


def inside_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Even-odd test; a missing polygon or one of fewer than three corners holds everything."""
    if len(polygon) < 3:
        return F.lit(True)
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y0 != y1:
            at = F.lit(x0) + (y - y0) * ((x1 - x0) / (y1 - y0))
            crossings = crossings + (((y < y0) != (y < y1)) & (x < at)).cast("int")
    return crossings % 2 == 1


def motion(h: Column) -> Column:
    """Translation, rotation in degrees and scale of a homography's affine part."""
    det = h[0] * h[4] - h[1] * h[3]
    return F.struct(h[2].alias("tx"), h[5].alias("ty"), F.degrees(F.atan2(h[3], h[0])).alias("rotation_deg"), F.sqrt(F.abs(det)).alias("scale"))


def project(h: Column, x: Column, y: Column) -> Column:
    """A point under a homography; unchanged where it would go to infinity."""
    w = h[6] * x + h[7] * y + h[8]
    good = F.abs(w) >= 1e-9
    return F.struct(
        F.when(good, (h[0] * x + h[1] * y + h[2]) / w).otherwise(x).alias("x"), F.when(good, (h[3] * x + h[4] * y + h[5]) / w).otherwise(y).alias("y")
    )


def matrix_product(a: Column, b: Column) -> Column:
    """Product of two 3 x 3 row-major matrices."""
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def is_spike(tx: Column, ty: Column, rotation: Column, low_confidence: Column, far: float = 25.0, turn: float = 3.0) -> Column:
    """A camera jump: far translation, large turn or an unreliable estimate."""
    return (F.sqrt(tx * tx + ty * ty) > far) | (F.abs(rotation) > turn) | low_confidence


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


# ------------------------------------------------------------------------ keypoint maps


def confident(keypoints: Column, least: float = 0.3) -> Column:
    return F.map_filter(keypoints, lambda _, p: p["confidence"] >= least)


def displacement(before: Column, after: Column, least: float = 0.3) -> Column:
    """Mean distance of the keypoints confident in both; 0 without any."""
    shared = F.array_intersect(F.map_keys(confident(before, least)), F.map_keys(confident(after, least)))
    total = F.aggregate(shared, F.lit(0.0), lambda s, k: s + distance(before[k]["x"], before[k]["y"], after[k]["x"], after[k]["y"]))
    return F.when(F.size(shared) > 0, total / F.size(shared)).otherwise(0.0)


def torso_centre(keypoints: Column, above: float = 0.3) -> Column:
    """Mean of the torso keypoints with more than `above` confidence, else the middle of the frame."""
    points = F.filter(F.array(*(keypoints[k] for k in TORSO)), lambda p: p.isNotNull() & (p["confidence"] > above))
    mean = lambda c: F.when(F.size(points) > 0, F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / F.size(points)).otherwise(0.5)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def _moved(keypoints: Column, x, y) -> Column:
    return F.transform_values(keypoints, lambda _, p: F.struct(x(p).alias("x"), y(p).alias("y"), p["z"].alias("z"), p["confidence"].alias("confidence")))


def normalised(keypoints: Column, frame_width: Column, frame_height: Column) -> Column:
    return _moved(keypoints, lambda p: p["x"] / frame_width, lambda p: p["y"] / frame_height)


def denormalised(keypoints: Column, frame_width: Column, frame_height: Column) -> Column:
    """Pixels, cut to whole numbers."""
    return _moved(keypoints, lambda p: (p["x"] * frame_width).cast("int").cast("double"), lambda p: (p["y"] * frame_height).cast("int").cast("double"))


def keypoint_box(keypoints: Column, least: float = 0.3, at_least: int = 3) -> Column:
    """Box around the confident keypoints; null for fewer than `at_least`."""
    points = F.map_values(confident(keypoints, least))
    side = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.when(F.size(points) >= at_least, F.array(side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")))


def accepted_pose(landmarks: Column, confidence: Column, least: float = 0.7) -> Column:
    """Whether a pose has landmarks and enough confidence."""
    return F.coalesce((confidence >= least) & (F.size(landmarks) > 0), F.lit(False))


def resolution_scale(width: Column, height: Column, stored_width: Column, stored_height: Column) -> Column:
    """(x, y) from stored boxes to the present picture; null if any size is missing or 0."""
    sizes = (width, height, stored_width, stored_height)
    known = reduce(lambda a, b: a & b, (F.coalesce(c != 0, F.lit(False)) for c in sizes))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(known, F.struct(ratio(width, stored_width).alias("x"), ratio(height, stored_height).alias("y")))


def uniform_role(width: Column, height: Column, low_saturation: Column, striped_rows: Column, smallest: int = 20, colourless: float = 0.35, striped: float = 0.25) -> Column:
    """(role, confidence) of a torso crop from its share of unsaturated pixels and of striped rows.

    Colour makes a player, stripes without colour a referee; crops under `smallest` pixels are
    uncertain.
    """
    sure = lambda x: F.least(F.lit(0.95), 0.5 + x)
    role = lambda name, x: F.struct(F.lit(name).alias("role"), x.cast("double").alias("confidence"))
    return (
        F.when((width < smallest) | (height < smallest), role("uncertain", F.lit(0.0)))
        .when(low_saturation < colourless, role("player", sure(colourless - low_saturation)))
        .when(striped_rows >= striped, role("referee", sure(striped_rows - striped)))
        .otherwise(role("player", sure(striped - striped_rows)))
    )
