"""Movement features of a repetition from its ordered pose frames.

`frames` has the rep keys, frame_index and landmarks, a map from keypoint to struct
(x, y, z, confidence). Steps go from row to row, whatever the gap between frame numbers.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapframe.functions import scores
from snapframe.functions.geometry import distance, torso_centre

LEAST_CONFIDENCE = 0.3
FULL_SPEED = 0.15
STABILITY = ("core_stability", "balance", "hip_mobility", "positioning")
CONFIDENCE = ("upper_body", "footwork", "hand_placement", "body_control", "field_vision", "decision_making")


def _steps(side: str) -> list[Column]:
    """Displacements of the left and right joint; 0 for an unsure pair, null where a frame lacks the joint."""
    out = []
    for name in (f"left_{side}", f"right_{side}"):
        a, b = F.col("_before")[name], F.col("landmarks")[name]
        sure = (a["confidence"] >= LEAST_CONFIDENCE) & (b["confidence"] >= LEAST_CONFIDENCE)
        out.append(F.when(a.isNotNull() & b.isNotNull(), F.when(sure, distance(a["x"], a["y"], b["x"], b["y"])).otherwise(0.0)))
    return out


def _speed(x: Column) -> Column:
    return scores.clip(F.coalesce(x, F.lit(0.0)) / FULL_SPEED * 100)


PARTIALS = (
    "ankle_sum double, ankle_n long, fastest double, final struct<frame_index: int, step: double>, hip_sum double, hip_n long, "
    "x_n long, x_mean double, x_m2 double, y_mean double, y_m2 double, conf_sum double, conf_n long, last struct<frame_index: int, landmarks: map<string, struct<x: double, y: double, z: double, confidence: double>>>"
)


def rep_partials(frames: DataFrame, keys: Sequence[str], seen: str | None = None) -> DataFrame:
    """Mergeable figures of each rep's frames: the columns of PARTIALS.

    Frames flagged by the column `seen` have been counted before: they are there only as what the
    next frame is compared with.
    """
    by = Window.partitionBy(*keys).orderBy("frame_index")
    fresh = ~F.col(seen) if seen else F.lit(True)
    rows = frames.withColumn("_before", F.lag("landmarks").over(by)).withColumn("_centre", torso_centre(F.col("landmarks"))).filter(fresh)
    mean = F.aggregate(F.map_values("landmarks"), F.lit(0.0), lambda s, p: s + p["confidence"]) / F.nullif(F.size("landmarks"), F.lit(0))
    left, right = _steps("ankle")
    hip_left, hip_right = _steps("hip")
    last = F.struct(F.col("frame_index").cast("int").alias("frame_index"), "landmarks")
    rows = rows.select(*keys, "frame_index", last.alias("_last"), "_centre", mean.alias("_conf"), left.alias("_al"), right.alias("_ar"), hip_left.alias("_hl"), hip_right.alias("_hr"))
    step = F.coalesce("_ar", "_al")
    total = lambda a, b: F.coalesce(F.sum(a), F.lit(0.0)) + F.coalesce(F.sum(b), F.lit(0.0))
    spread = lambda c: F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        total("_al", "_ar").alias("ankle_sum"), (F.count("_al") + F.count("_ar")).alias("ankle_n"), F.max(F.greatest("_al", "_ar")).alias("fastest"),
        F.max(F.when(step.isNotNull(), F.struct(F.col("frame_index").cast("int").alias("frame_index"), step.alias("step")))).alias("final"),
        total("_hl", "_hr").alias("hip_sum"), (F.count("_hl") + F.count("_hr")).alias("hip_n"),
        F.count("_centre.x").alias("x_n"), F.avg("_centre.x").alias("x_mean"), spread("_centre.x").alias("x_m2"), F.avg("_centre.y").alias("y_mean"), spread("_centre.y").alias("y_m2"),
        F.coalesce(F.sum("_conf"), F.lit(0.0)).alias("conf_sum"), F.count("_conf").alias("conf_n"), F.max_by("_last", "frame_index").alias("last"),
    )


def merge_partials(old: str, new: str) -> list[Column]:
    """The columns of PARTIALS from those of two struct columns, the second being of later frames; either may be null."""
    a, b = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    add = lambda c: (F.coalesce(a(c), F.lit(0)) + F.coalesce(b(c), F.lit(0))).alias(c)
    n, m = F.coalesce(a("x_n"), F.lit(0)), F.coalesce(b("x_n"), F.lit(0))
    gap = lambda c: F.coalesce(b(c), F.lit(0.0)) - F.coalesce(a(c), F.lit(0.0))
    mean = lambda c: F.when(n + m > 0, F.coalesce(a(c), F.lit(0.0)) + gap(c) * m / (n + m)).alias(c)
    m2 = lambda c, of: (F.coalesce(a(c), F.lit(0.0)) + F.coalesce(b(c), F.lit(0.0)) + F.when((n > 0) & (m > 0), gap(of) * gap(of) * n * m / (n + m)).otherwise(0.0)).alias(c)
    return [
        add("ankle_sum"), add("ankle_n"), F.greatest(a("fastest"), b("fastest")).alias("fastest"), F.coalesce(b("final"), a("final")).alias("final"), add("hip_sum"), add("hip_n"),
        (n + m).alias("x_n"), mean("x_mean"), m2("x_m2", "x_mean"), mean("y_mean"), m2("y_m2", "y_mean"), add("conf_sum"), add("conf_n"), F.coalesce(b("last"), a("last")).alias("last"),
    ]


def finished_features(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and a map of 15 features from 0 to 100."""
    share = lambda s, n: F.col(s) / F.nullif(F.col(n), F.lit(0))
    sway = (F.sqrt(share("x_m2", "x_n")) + F.sqrt(share("y_m2", "x_n"))) / 2
    stability = scores.clip(100 - 300 * sway)
    sure = F.coalesce(scores.clip(100 * share("conf_sum", "conf_n")), F.lit(50.0))
    values = {
        "linear_speed": _speed(share("ankle_sum", "ankle_n")),
        "acceleration": _speed(F.col("fastest")),
        "leg_power": _speed(F.col("fastest")),
        "lateral_speed": _speed(share("hip_sum", "hip_n")),
        "deceleration": _speed(F.greatest(F.lit(0.0), F.col("fastest") - F.col("final.step"))),
        **dict.fromkeys(STABILITY, stability),
        **dict.fromkeys(CONFIDENCE, sure),
    }
    return partials.select(*keys, F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))).alias("features"))


def rep_features(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and a map of 15 features from 0 to 100."""
    return finished_features(rep_partials(frames, keys), keys)


def quality_gate(frames: DataFrame, keys: Sequence[str], confidence: str, least: float = 0.5) -> DataFrame:
    """Reps whose mean confidence is high enough."""
    return frames.groupBy(*keys).agg(F.avg(confidence).alias("confidence")).filter(F.col("confidence") >= least)


def score_reps(reps: DataFrame, keys: Sequence[str], traits: Mapping[str, Mapping[str, float]] = scores.TRAITS, batch: Collection[str] | None = None) -> DataFrame:
    """Traits, buckets, grade and letter of every rep; one whose `features` are null scores 0 in each trait.

    `batch` names the features that any rep of the batch has (scores.batch_features), for maps that may lack some;
    rep_features makes all of them for any rep with frames, so its maps need none.
    """
    empty = F.create_map().cast("map<string,double>")
    scored = reps.withColumn("traits", scores.trait_map(F.coalesce("features", empty), traits, batch))
    grade = F.aggregate(F.map_values("traits"), F.lit(0.0), lambda s, x: s + x) / F.size("traits")
    buckets = F.transform_values("traits", lambda _, x: scores.bucket(x))
    return scored.select(*keys, "traits", buckets.alias("buckets"), grade.alias("overall_grade")).withColumn("letter", scores.letter(F.col("overall_grade")))
