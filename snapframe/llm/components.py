"""Connected components of an edge table, kept distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapframe.llm.common import materialise, release


def _roots(edges: DataFrame) -> DataFrame:
    """(k, up) for every vertex: its smallest neighbour's, or its own, followed to the end of that chain."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    up = materialise(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("a"), F.min("b")).alias("up")), "labels")
    while True:
        # Chains of smaller and smaller vertices: each turn doubles the way that is followed.
        further = up.join(up.select(F.col("k").alias("up"), F.col("up").alias("top")), "up").select("k", F.col("up").alias("old"), F.col("top").alias("up"))
        new = materialise(further, "labels")
        moved = not new.filter("up <> old").isEmpty()
        release(up)
        up = new.select("k", "up")
        if not moved:
            return up


def components(edges: DataFrame) -> DataFrame:
    """(k, label) for every vertex of `edges` (a, b): label is the smallest k of its component.

    Each round hooks every vertex to its smallest neighbour, follows the hooks to their roots and goes
    on with the edges between different roots, each once. At least half of the vertices that still
    have edges go in a round, and dense groups shrink to few edges at once, so all rounds together
    read little more than the edges given. Every round is written to the shared folder.
    """
    ordered = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, labels = materialise(ordered(edges.select("a", "b")), "edges"), None
    while True:
        up = _roots(left)
        if labels is None:
            labels = up.select("k", F.col("up").alias("label"))
        else:
            labels = labels.join(up.select(F.col("k").alias("label"), F.col("up").alias("top")), "label", "left").select("k", F.coalesce("top", "label").alias("label"))
        side = lambda c, table=up: table.select(F.col("k").alias(c), F.col("up").alias(f"{c}_up"))
        joined = left.join(side("a"), "a").join(side("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))
        rest = materialise(ordered(joined), "edges")
        release(left)
        left = rest
        if left.isEmpty():
            release(left)
            return materialise(labels, "labels")
