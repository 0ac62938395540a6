"""Exact deduplication by recursive hash partitioning and open-addressing tables.

Records are partitioned by a digest of their normalised text. Each bucket is read into an
open-addressing table that compares complete contents. A bucket whose distinct contents
outgrow the table's byte budget is not resolved: its records go on, as spill files in the
shared folder, to the next round, which partitions that bucket again by a fresh hash.
Rounds end when nothing overflows. Only distinct contents take room in a table, so a group
of copies of any size never overflows one, and because every map task collapses its own
copies first, a hot group reaches its bucket as at most a few records per map task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapframe.llm.common import materialise

TABLE_BYTES = 48 << 20
BUCKETS_PER_PARTITION = 4


def normalise(text: str | None) -> bytes:
    """The compared form: null as empty, A-Z lower-cased, nothing else changed."""
    return (text or "").encode().lower()


class ContentTable:
    """Open addressing with linear probing; equal digests are settled by comparing contents."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, np.int64)
        self.starts: list[int] = []
        self.rows: list[list] = []
        self.bytes = 0

    def _slot(self, start: int, digest: bytes, text: str | None) -> int:
        mask = len(self.slots) - 1
        at = start & mask
        while (row := self.slots[at]) >= 0:
            if digest and self.rows[row][0] == digest and normalise(self.rows[row][1]) == normalise(text):
                break
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, text: str | None, keep_id: int | None, size: int, payload) -> None:
        """Merge a record; the largest id's row stays, a null id being the smallest."""
        start = int.from_bytes(digest[:6], "big")
        at = self._slot(start, digest, text)
        row = self.slots[at]
        if row >= 0:
            held = self.rows[row]
            held[3] += size
            if keep_id is not None and (held[2] is None or keep_id > held[2]):
                held[1], held[2], held[4] = text, keep_id, payload
            return
        self.slots[at] = len(self.rows)
        self.starts.append(start)
        self.rows.append([digest, text, keep_id, size, payload])
        self.bytes += len(text or "") + 300
        if 2 * len(self.rows) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for i, old in enumerate(self.starts):
                self.slots[self._slot(old, b"", None)] = i


def _schema(payload: T.DataType) -> T.StructType:
    kinds = {"digest": T.BinaryType(), "text": T.StringType(), "keep_id": T.LongType(), "size": T.LongType(), "payload": payload, "bucket": T.LongType(), "resolved": T.BooleanType()}
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def _batches(table: ContentTable, bucket: int | None, payload: pa.DataType, resolved: bool, texts: bool, step: int = 8 << 20):
    """A table's records as Arrow batches of bounded size."""
    kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), payload]
    names = ["digest", "text", "keep_id", "size", "payload", "bucket", "resolved"]
    first, held = 0, 0
    for i, row in enumerate(table.rows):
        held += len(row[1] or "")
        if held >= step or i + 1 == len(table.rows):
            part = table.rows[first : i + 1]
            columns = [pa.array([r[j] if j != 1 or texts else None for r in part], kind) for j, kind in enumerate(kinds)]
            columns += [pa.array([bucket] * len(part), pa.int64()), pa.array([resolved] * len(part), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names)
            first, held = i + 1, 0


def _collapse(table_bytes: int):
    """Map side: fold a task's own copies together, handing the table on whenever it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = ContentTable(), pa.null()
        for batch in batches:
            kind = batch.schema.field("payload").type
            for text, keep_id, payload in zip(*(batch.column(c).to_pylist() for c in ("text", "keep_id", "payload")), strict=True):
                table.add(hashlib.sha256(normalise(text)).digest(), text, keep_id, 1, payload)
                if table.bytes > table_bytes:
                    yield from _batches(table, None, kind, False, True)
                    table = ContentTable()
        if table.rows:
            yield from _batches(table, None, kind, False, True)

    return run


def _resolve(table_bytes: int, texts: bool):
    """Bucket side: rows come sorted by bucket; a bucket that does not fit is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, current, over, kind = ContentTable(), None, False, pa.null()
        for batch in batches:
            kind = batch.schema.field("payload").type
            for digest, text, keep_id, size, payload, bucket in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "keep_id", "size", "payload", "bucket")), strict=True):
                if bucket != current:
                    yield from _batches(table, current, kind, not over, over or texts)
                    table, current, over = ContentTable(), bucket, False
                table.add(digest, text, keep_id, size, payload)
                if table.bytes > table_bytes and (over or len(table.rows) > 1):  # one text always fits
                    over = True
                    yield from _batches(table, current, kind, False, True)
                    table = ContentTable()
        if table.rows:
            yield from _batches(table, current, kind, not over, over or texts)

    return run


def resolve_copies(records: DataFrame, texts: bool, table_bytes: int = TABLE_BYTES, fanout: int = 16) -> DataFrame:
    """Each distinct text once, with the row that stays and the number of its copies.

    `records` has text, keep_id (long) and payload (any type). Result: digest (SHA-256 of the
    normalised text), text (of the row that stays; null unless `texts`), keep_id, size, payload.
    """
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = _schema(records.schema["payload"].dataType)
    pending = records.select("text", "keep_id", "payload").mapInArrow(_collapse(table_bytes), schema)
    pending = pending.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(parts * BUCKETS_PER_PARTITION)))
    result, level = None, 0
    while True:
        level += 1
        dealt = pending.drop("resolved").repartition(parts, "bucket").sortWithinPartitions("bucket")
        out = materialise(dealt.mapInArrow(_resolve(table_bytes, texts), schema), f"grace-{level}")
        resolved, over = out.filter("resolved"), out.filter("not resolved")
        result = resolved if result is None else result.unionByName(resolved)
        if over.isEmpty():
            return result.select("digest", "text", "keep_id", "size", "payload")
        # A fresh hash splits each overflowing bucket into `fanout` smaller ones.
        pending = over.withColumn("bucket", F.xxhash64("bucket", F.pmod(F.xxhash64(F.lit(level), "digest"), F.lit(fanout))))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(normalise(t)).digest() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary())], ["doc_id", "digest"])


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. The largest doc_id of equal texts stays; a null doc_id is the
    smallest, and a group of null ids has a null keep_id. `kept` is doc_id <=> keep_id, so rows
    repeated with the winning id are all marked kept. Empty input gives an empty result; extra
    columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    records = base.select("text", F.col("doc_id").alias("keep_id"), F.lit(None).cast("int").alias("payload"))
    groups = resolve_copies(records, False, table_bytes).select("digest", "keep_id", F.col("size").alias("group_size"))
    members = base.mapInArrow(_digests, "doc_id long, digest binary")
    return members.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_distinct(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The input's columns with exactly one row, that of the largest doc_id, of each group of
    equal texts. Whole rows travel through the tables, so nothing is joined back.

    Null text counts as empty and a null doc_id is the smallest; of rows that tie any one stays.
    Empty input gives an empty result; extra columns of any name are carried along.
    """
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.col("doc_id").cast("long").alias("keep_id"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("payload"))
    kept = resolve_copies(packed, True, table_bytes)
    return kept.select(*("text" if c == "text" else F.col("payload").getField(c).alias(c) for c in docs.columns))
