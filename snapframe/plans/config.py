"""Layered configuration: base, level, program and position documents merged into one."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from snapframe.sources.readers import config_texts

Config = dict[str, Any]


def deep_merge(base: Config, over: Config, accumulate: bool = False, custom: Callable[[str, Any, Any], Any] | None = None) -> Config:
    """`over` laid on `base`: objects merge, other values replace; lists join if `accumulate`.

    `custom` may settle a key by returning something other than None.
    """
    out = dict(base)
    for key, value in over.items():
        old = out.get(key)
        settled = custom(key, old, value) if custom and key in out else None
        if settled is not None:
            out[key] = settled
        elif isinstance(old, dict) and isinstance(value, dict):
            out[key] = deep_merge(old, value, accumulate, custom)
        elif accumulate and isinstance(old, list) and isinstance(value, list):
            out[key] = old + value
        else:
            out[key] = value
    return out


def merge_all(parts: Sequence[Config], accumulate: bool = False) -> Config:
    out: Config = {}
    for part in parts:
        out = deep_merge(out, part, accumulate)
    return out


class Configs:
    """The configuration documents of a folder: base/universal, levels/*, programs/*, positions/*."""

    def __init__(self, documents: dict[str, Config]):
        self.documents = documents

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Configs:
        """Documents are few and small; they are read by Spark so that any store will do."""
        rows = config_texts(spark, folder).collect()
        return cls({"/".join(r.path.rsplit("/", 2)[-2:]).removesuffix(".json"): json.loads(r.text) for r in rows})

    def resolve(self, position: str, level: str = "universal", program: str | None = None) -> Config:
        """Base, then level, program and position; layers that do not exist are skipped."""
        names = ["base/universal", f"levels/{level}", *([f"programs/{program}"] if program else []), f"positions/{position}"]
        return merge_all([self.documents.get(n, {}) for n in names])

    def positions(self) -> list[str]:
        return sorted(n.removeprefix("positions/") for n in self.documents if n.startswith("positions/"))

    def trait_weights(self, spark: SparkSession, level: str = "universal", program: str | None = None) -> DataFrame:
        """position, trait, feature, weight of every position, for a join with its reps."""
        rows = []
        for position in self.positions():
            for trait, spec in (self.resolve(position, level, program).get("traits") or {}).items():
                features, weights = spec.get("features", []), spec.get("weights", [])
                rows += [(position, trait, f, float(w)) for f, w in zip(features, weights, strict=False)]
        return spark.createDataFrame(rows, "position string, trait string, feature string, weight double")
