"""Sinks: keyed upserts into Parquet tables, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapframe.sources.buckets import BucketTable
from snapframe.sources.schemas import KEYS, TABLES


def checked(rows: DataFrame, name: str) -> DataFrame:
    """The rows with the table's columns; rows without a required key are left out."""
    required, _ = KEYS[name]
    missing = [k for k in required if k not in rows.columns]
    if missing:
        raise ValueError(f"{name}: no column {', '.join(missing)}")
    good = rows
    for k in required:
        good = good.filter(F.col(k).isNotNull())
    return good


def write_rows(spark: SparkSession, base: str, name: str, rows: DataFrame, version: int, order: str) -> DataFrame:
    """Upsert rows into the bucketed table <base>/<name> as `version` and read it back.

    Rows without a required key are left out. Of several rows of a key the last by the column `order` counts.
    Only the buckets of the rows' keys are rewritten; a version that is there already stays as it is.
    """
    required, nullable = KEYS[name]
    store = BucketTable(spark, f"{base}/{name}", TABLES[name], required, nullable)
    store.upsert(checked(rows, name), version, order)
    return store.read()


def write_pose_files(poses: DataFrame, folder: str) -> None:
    """One JSON document {timestamp, data} a frame (frame_index, timestamp, landmarks), under <folder>/name=frame_<index>.json/.

    `readers.pose_files` reads the folder's files back.
    """
    document = F.to_json(F.struct("timestamp", F.col("landmarks").alias("data")))
    named = poses.select(F.format_string("frame_%06d.json", "frame_index").alias("name"), document.alias("value"))
    named.repartition("name").write.mode("overwrite").partitionBy("name").text(folder)


def report_lines(figures: DataFrame, title: str, order: str) -> DataFrame:
    """A report table as ordered lines of Markdown."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in figures.columns]
    body = figures.select(F.col(order).alias("_o"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = figures.sparkSession.createDataFrame([(i, x) for i, x in enumerate([f"# {title}", "", "| " + " | ".join(figures.columns) + " |", "|" + " --- |" * len(figures.columns)])], "i int, line string")
    return head.select(F.lit(0).alias("part"), F.col("i").cast("string").alias("key"), "line").union(body.select(F.lit(1), F.col("_o").cast("string"), "line"))


def write_report(figures: DataFrame, path: str, kind: str = "json") -> None:
    """Write a report as JSON lines or as text."""
    if kind == "json":
        figures.write.mode("overwrite").json(path)
    else:
        figures.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in figures.columns)).alias("value")).write.mode("overwrite").text(path)
