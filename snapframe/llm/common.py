"""Helpers shared by the corpus operators: shared-folder tables and vectorised text scanning.

Text scanning works on the UTF-8 bytes of an Arrow string column. ASCII white space never
occurs inside a multi-byte character, so word boundaries found on bytes are exact.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAKS = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 18


# --------------------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: spark.checkpoint.dir, or, in local mode only, one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="snapframe-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone at interpreter exit
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage.

    The files outlive any executor. They are removed when the driver's interpreter ends,
    because results that a caller has not yet consumed may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files behind a materialised frame that no result reads any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _delete(df.sparkSession, f)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that nothing refers to any more.

    The cleaner follows the driver's garbage collections, which may be long apart; a loop of many
    small jobs calls this so that the disk holds one round's files and not all rounds'.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores added until no column of that name is there."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it several times inside `body`."""
    return F.transform(F.array(value), body)[0]


# --------------------------------------------------------------------------- text scanning


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Yield (first row, bytes, offsets) over runs of whole rows of about `limit` bytes."""
    data, offsets = utf8(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_IS_BREAK = byte_set(WORD_BREAKS)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_break: np.ndarray = _IS_BREAK):
    """Starts, ends and row numbers of the words of a block, in order."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~is_break[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_byte_values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_lower_values = _byte_values.copy()
_lower_values[ord("A") : ord("Z") + 1] = _byte_values[ord("a") : ord("z") + 1]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[i] = np.cumprod(step)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte span; with `lower`, A-Z hash as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_lower_values if lower else _byte_values)[data] * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """For each row of a block its sorted distinct k-word shingle hashes (A-Z lower-cased).

    A row of fewer than k words has its whole word sequence as one shingle; without words none.
    """
    starts, ends, rows = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, lower=True)
    mult = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    first = np.searchsorted(rows, np.arange(len(offsets)), "left")
    n = len(words)
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        full += words[j : n - k + 1 + j] * mult[j]
    full = mix64(full)
    for r in range(len(offsets) - 1):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            yield mix64(np.array([(words[a:b] * mult[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
