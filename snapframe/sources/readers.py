"""Sources: collection scans, JSON documents, frame folders, candidate logs, configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapframe.functions.text import frame_index
from snapframe.sources.schemas import POINT, TABLES

_OPERATORS = {"==": "__eq__", ">=": "__ge__", "<=": "__le__", ">": "__gt__", "<": "__lt__"}


def scan(spark: SparkSession, base: str, name: str, video_id: str | None = None, where: Sequence[tuple] = (), order_by: str | None = None) -> DataFrame:
    """Rows of a table, of one video if given, under (field, operator, value) conditions; pushed to Parquet."""
    if bad := [op for _, op, _ in where if op not in _OPERATORS]:
        raise ValueError(f"{bad[0]}: conditions are one of {', '.join(_OPERATORS)}")
    df = spark.read.schema(TABLES[name]).parquet(f"{base}/{name}")
    if video_id is not None:
        df = df.filter(F.col("video_id") == video_id)
    for field, op, value in where:
        df = df.filter(getattr(F.col(field), _OPERATORS[op])(value))
    return df.orderBy(order_by) if order_by else df


def scan_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational database, split by a hash of video_id if asked by options."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()


def frame_paths(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """frame_index and path of the images of a folder, within [low, high] if given; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*").load(folder).select("path")
    found = found.withColumn("frame_index", frame_index(F.col("path"))).filter("frame_index IS NOT NULL")
    if low is not None:
        found = found.filter(F.col("frame_index") >= low)
    if high is not None:
        found = found.filter(F.col("frame_index") <= high)
    return found.select("frame_index", "path").orderBy("frame_index")


def video_files(spark: SparkSession, folder: str, extensions: Sequence[str] = ("mp4", "mov", "webm", "m3u8")) -> DataFrame:
    """Distinct paths of a folder tree with one of the extensions, in order."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    return listed.select("path").distinct().orderBy("path")


def pose_files(spark: SparkSession, path: str) -> DataFrame:
    """frame_index, timestamp and landmarks of JSON pose files {timestamp, data}; unreadable files are left out."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = F.from_json("value", f"timestamp double, data map<string, {POINT}>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return texts.select(frame_index(F.col("path")).alias("frame_index"), parsed.alias("p")).filter("p._bad IS NULL AND p.data IS NOT NULL").select("frame_index", "p.timestamp", F.col("p.data").alias("landmarks"))


def candidates(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """frame_index and seconds of the 'frame N (T.Ts)' lines of logs, after the line holding `section` if given."""
    text = spark.read.text(path, wholetext=True).select("value")
    if section is not None:
        text = text.select(F.substring_index("value", section, -1).alias("value")).filter(F.col("value") != "")
    line = F.explode(F.regexp_extract_all("value", F.lit(r"frame\s+\d+\s+\(\d+(?:\.\d+)?s\)"), F.lit(0))).alias("line")
    return text.select(line).select(
        F.regexp_extract("line", r"frame\s+(\d+)", 1).cast("int").alias("frame_index"), F.regexp_extract("line", r"\((\d+(?:\.\d+)?)s", 1).cast("double").alias("seconds")
    )


def ground_truth(spark: SparkSession, path: str, field: str = "timestamps") -> DataFrame:
    """Labelled boundary times of a JSON document, in order."""
    read = spark.read.json(path, multiLine=True)
    return read.select(F.explode(field).cast("double").alias("at")).orderBy("at")


def config_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of every JSON file of a folder tree."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
