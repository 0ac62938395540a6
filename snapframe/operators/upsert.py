"""Table changes as whole-table transforms: upserts, replacement of ranges, purges, nested updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapframe.operators.joins import latest, same


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], nullable: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Rows of `base` with the columns that `changes` has replaced by its values, and its new rows.

    Of several changes to a key the last by `order` counts. Columns that `changes` lacks keep
    their old value, or are null in new rows.
    """
    every = [*keys, *nullable]
    last = latest(changes, every, [F.col(order).desc()]) if order else changes.dropDuplicates(every)
    given = last.select(*(F.col(c).alias(f"_n_{c}") for c in last.columns if c in base.columns), F.lit(True).alias("_new"))
    on = [base[k] == given[f"_n_{k}"] for k in keys] + [base[k].eqNullSafe(given[f"_n_{k}"]) for k in nullable]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = base.withColumn("_old", F.lit(True)).join(given, condition, "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if f"_n_{c}" in given.columns else F.col(c)
    return joined.select(*(pick(c) for c in base.columns))


def replace_range(base: DataFrame, fresh: DataFrame, key: str, at: str, spans: DataFrame) -> DataFrame:
    """Delete the rows within each key's [low, high] of `spans`, then add the fresh ones."""
    gone = base.join(spans, (base[key] == spans[key]) & base[at].between(spans["low"], spans["high"]), "left_anti")
    return gone.unionByName(fresh)


def purge(tables: Mapping[str, DataFrame], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the doomed keys."""
    gone = doomed.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def insert_new(base: DataFrame, rows: DataFrame, keys: Sequence[str], nullable: Sequence[str] = (), live: Column | None = None) -> DataFrame:
    """Append the rows that no live row of `base` has the keys of."""
    taken = base.filter(live) if live is not None else base
    return base.unionByName(rows.join(taken, same(rows, taken, keys, nullable), "left_anti").select(*base.columns))


def merge_maps(left: Column, right: Column) -> Column:
    """Shallow merge of maps: on equal keys the right one wins."""
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_concat(kept, right))


def set_nested(stages: Column, stage: str, field: str, value: Column) -> Column:
    """stages.<stage>.<field> = value in a map of maps; a stage not there is added."""
    inner = F.coalesce(stages[stage], F.create_map().cast("map<string,string>"))
    return merge_maps(stages, F.create_map(F.lit(stage), merge_maps(inner, F.create_map(F.lit(field), value))))


def pivot_stages(stages: DataFrame, key: str, order: str) -> DataFrame:
    """Map from (stage, play) to status of each key; of repeated entries the last by `order` counts."""
    last = latest(stages, [key, "stage_name", "play_index"], [F.col(order).desc()])
    name = F.concat(F.col("stage_name"), F.when(F.col("play_index").isNotNull(), F.format_string("_p%04d", "play_index")).otherwise(""))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, F.col("status"))))).alias("stages"))


def with_stages(roots: DataFrame, stages: DataFrame, key: str, order: str, fields: Sequence[str] = ("status", "attempt")) -> DataFrame:
    """Every root row with a map from stage, and play if there is one, to a struct of the stage's fields.

    Of repeated entries the last by `order` counts; a root without stages has an empty map.
    """
    last = latest(stages, [key, "stage_name", "play_index"], [F.col(order).desc()])
    name = F.concat(F.col("stage_name"), F.when(F.col("play_index").isNotNull(), F.format_string("_p%04d", "play_index")).otherwise(""))
    nested = last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name.alias("stage"), F.struct(*fields).alias("entry"))))).alias("stages"))
    empty = F.create_map().cast(nested.schema["stages"].dataType)
    return roots.join(nested, key, "left").withColumn("stages", F.coalesce("stages", empty))


def set_columns(base: DataFrame, chosen: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """The rows of the chosen keys, null equal to null, with columns set; other rows and columns stay."""
    named = chosen.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).distinct().withColumn("_set", F.lit(True))
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return base.join(named, met, "left").select(*(F.when(F.col("_set"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns))
