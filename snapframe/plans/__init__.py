"""Whole plans: grading, configuration, and the queries over the test tables."""

from snapframe.plans import record_queries, scoring_queries, sequence_queries, table_queries, view_queries  # noqa: F401
from snapframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
