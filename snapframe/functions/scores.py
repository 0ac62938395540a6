"""Column expressions for trait scores, buckets and letter grades.

Three policies for a missing feature exist side by side and are not interchangeable: it counts
as zero (weighted_score), is left out of the weights (present_score) or counts as a neutral
half (neutral_score).
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score edges, bands as closed ranges in order of precedence, letters and their scores.
SCORE_EDGES = (("elite", 90), ("high", 80), ("average", 70), ("below_average", 60))
LOWEST_BUCKET = "poor"
BAND_NAMES = ("elite", "high", "average", "below_average", "poor")
BAND_EDGES = {"college": (90, 75, 50, 25, 0), "hs": (85, 70, 50, 30, 0), "pro": (92, 80, 50, 20, 0)}
CATEGORIES = {"excellent": 95.0, "good": 80.0, "average": 60.0, "poor": 35.0, "very_poor": 15.0}
LETTERS = (("A", 90), ("B", 80), ("C", 70), ("D", 60))
LETTER_SCORES = {"A": 95.0, "B": 85.0, "C": 75.0, "D": 65.0, "F": 35.0}
NEUTRAL_SCORE = 50.0
# The five production traits as weights over pose features.
TRAITS = {
    "strength": {"leg_power": 0.5, "core_stability": 0.3, "upper_body": 0.2},
    "agility": {"hip_mobility": 0.4, "balance": 0.3, "lateral_speed": 0.3},
    "speed": {"acceleration": 0.35, "linear_speed": 0.4, "deceleration": 0.25},
    "technique": {"footwork": 0.4, "hand_placement": 0.3, "body_control": 0.3},
    "awareness": {"field_vision": 0.33, "positioning": 0.33, "decision_making": 0.34},
}


def clip(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def _weighted(features: Column, weights: Mapping[str, float], missing: float) -> Column:
    return sum((F.coalesce(features[k], F.lit(missing)) * w for k, w in weights.items()), F.lit(0.0))


MOST_FEATURES = 10_000


def batch_features(df: DataFrame, features: str) -> set[str]:
    """Names of the features that any row of a batch has; more than MOST_FEATURES are an error, as they would be a column's values."""
    names = {r["k"] for r in df.select(F.explode(F.map_keys(features)).alias("k")).distinct().limit(MOST_FEATURES + 1).collect()}
    if len(names) > MOST_FEATURES:
        raise ValueError(f"{features} has more than {MOST_FEATURES} different keys")
    return names


def weighted_score(features: Column, weights: Mapping[str, float], batch: Collection[str] | None = None) -> Column:
    """Weights normalised to one, missing feature 0, clipped to 0..100.

    With `batch`, the features any row of the batch has, weights of others do not count.
    """
    weights = {k: w for k, w in weights.items() if batch is None or k in batch}
    total = sum(weights.values())
    return clip(_weighted(features, weights, 0.0) / total) if total else F.lit(0.0)


def single_score(features: Column, weights: Mapping[str, float]) -> Column:
    """Plain dot product without normalisation, clipped to 0..100."""
    return clip(_weighted(features, weights, 0.0))


def present_score(features: Column, weights: Mapping[str, float]) -> Column:
    """Weights renormalised over the features present; 50 without any; not clipped."""
    total = sum((F.when(features[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.coalesce(_weighted(features, weights, 0.0) / F.nullif(total, F.lit(0.0)), F.lit(NEUTRAL_SCORE))


def neutral_score(features: Column, weights: Mapping[str, float]) -> Column:
    """All weights count; a missing feature is 0.5."""
    total = sum(weights.values())
    return _weighted(features, weights, 0.5) / total if total else F.lit(0.5)


def trait_map(features: Column, traits: Mapping[str, Mapping[str, float]] = TRAITS, batch: Collection[str] | None = None) -> Column:
    """Score of each trait; with `batch`, only the features that any row of the batch has carry weight."""
    return F.create_map(*(x for name, weights in traits.items() for x in (F.lit(name), weighted_score(features, weights, batch))))


def _edges(score: Column, edges, otherwise: str) -> Column:
    out = F
    for name, edge in edges:
        out = out.when(score >= edge, name)
    return out.otherwise(otherwise)


def bucket(score: Column) -> Column:
    """Half-open buckets at 90, 80, 70 and 60; every score falls into one."""
    return _edges(score, SCORE_EDGES, LOWEST_BUCKET)


def bands(level: str) -> dict[str, tuple[int, int]]:
    """Closed integer range of each band: up to one below the next better band."""
    edges = BAND_EDGES[level]
    return dict(zip(BAND_NAMES, zip(edges, (100, *(e - 1 for e in edges)), strict=False), strict=True))


def band(score: Column, level: str = "college") -> Column:
    """Closed integer bands of a level; a score in a gap between bands is average."""
    out = F
    for name, (low, high) in bands(level).items():
        out = out.when(score.between(low, high), name)
    return out.otherwise("average")


def letter(score: Column) -> Column:
    return F.when(score.isNotNull(), _edges(score, LETTERS, "F"))


def letter_score(grade: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LETTER_SCORES.items() for x in kv))[grade], F.lit(NEUTRAL_SCORE))


def categorical_score(value: Column, scores: Mapping[str, float] = CATEGORIES) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in scores.items() for x in kv))[value], F.lit(NEUTRAL_SCORE))


def rank_score(rank: Column, count: Column) -> Column:
    """Percentile of a rank among `count`; 50 for none."""
    return F.when(count > 0, (count - rank) / count * 100).otherwise(NEUTRAL_SCORE)


def composite(traits: Column, weights: Mapping[str, float]) -> Column:
    """Weighted mean of a trait map, weight 1 where none is given; 50 if there is nothing to weigh."""
    pairs = F.map_entries(traits)
    given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))) if weights else None
    if given is None:
        return F.lit(NEUTRAL_SCORE)
    weight = lambda e: F.coalesce(given[e["key"]], F.lit(1.0))
    up = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + e["value"] * weight(e))
    down = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + weight(e))
    return F.when((F.size(pairs) > 0) & (down > 0), up / down).otherwise(NEUTRAL_SCORE)


def share_status(ratio: Column) -> Column:
    """How a measured time compares with its baseline."""
    return F.when(ratio <= 1.2, "ok").when(ratio <= 1.5, "warning").otherwise("critical")
