"""Substring deduplication by hashing lines, paragraphs and passages.

Units are normalised (A-Z lower-cased, white space runs as one blank, trimmed) and digested.
Digests are grouped over the whole corpus with map-side combining; of each group the earliest
occurrence, by doc_id and then by place, stays, and every other occurrence is removed. Removed
spans keep their offsets in the original text. Units of fewer than `min_words` words never count
as repeats. Only digests and offsets are shuffled for the decision, and a line that a third of
all documents share is a single pre-aggregated row per task.

Passages begin and end anywhere. Of every WINDOW neighbouring sequences of PASSAGE_WORDS words the
one with the least hash is a unit, so that a passage has the same units wherever it stands and
however it is wrapped into lines. Repeated units that overlap make one run, and a run counts from
`min_words` words on. Every word of a run lies in a unit that occurred before. A repeated passage
of min_words + 2 * (WINDOW - 1) words or more is always found, but for up to WINDOW - 1 words at
either end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapframe.llm.common import blocks, free_name, materialise, mix64, release, span_hashes, tidy, word_spans
from snapframe.llm.common import _BASE, _power_tables

MIN_WORDS = 20
PASSAGE_WORDS = 16
WINDOW = 10
SEPARATORS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*\n\s*")}
_BREAKS = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def units(text: str | None, separator: re.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end, in code points, of each unit of a text."""
    at = 0
    for m in separator.finditer(text or ""):
        yield at, m.start()
        at = m.end()
    yield at, len(text or "")


def digest(unit: str, min_words: int) -> bytes | None:
    """MD5 of a normalised unit, or None for a unit that is too short to count."""
    words = [w for w in _BREAKS.split(unit.translate(_LOWER)) if w]
    return hashlib.md5(" ".join(words).encode()).digest() if len(words) >= min_words else None


def _digests(unit: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row_id", "doc_id", "start", "end", "digest"]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for row_id, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "text")), strict=True):
                for start, end in units(text, SEPARATORS[unit]):
                    if found := digest(text[start:end] if text else "", min_words):
                        for column, value in zip(rows, (row_id, doc_id, start, end, found), strict=True):
                            column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    return run


def repeated_spans(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_units, n_removed, removed.

    n_units counts the units long enough to compare; removed is an array of (start, end, keep_id):
    code point offsets in the original text and the document that keeps the unit. Null and empty
    texts have no units. Null doc_ids rank first; rows equal in doc_id rank by their text, and rows
    repeated entirely are ranked as one, so all of them keep their first occurrences. Empty input
    gives an empty result; extra columns are ignored.
    """
    rows = _keyed(docs)
    counts, removed = _removed(rows, unit, min_words)
    return _per_row(rows.select("doc_id", F.xxhash64("row_id").alias("row_key")), counts, removed)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("row_id"))


def _removed(rows: DataFrame, unit: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Units (cd, cr, n_units) and removed spans (d, r, removed) by doc_id and text."""
    found = rows.mapInArrow(_digests(unit, min_words), "row_id string, doc_id long, start long, end long, digest binary")
    found = materialise(found.select(F.xxhash64("row_id").alias("row_key"), "doc_id", "start", "end", "digest"), "units")
    rank = F.struct(F.col("doc_id"), F.col("row_key"), F.col("start"))
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    again = found.join(first.select("digest", "first"), "digest").filter(~rank.eqNullSafe(F.col("first")))
    span = F.struct(F.col("start"), F.col("end"), F.col("first.doc_id").alias("keep_id"))
    removed = again.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("r")).agg(F.sort_array(F.collect_set(span)).alias("removed"))
    return found.groupBy(F.col("doc_id").alias("cd"), F.col("row_key").alias("cr")).agg(F.count_distinct("start").alias("n_units")), removed


def _least_of_windows(grams: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Places of the grams that are the least of a window of WINDOW grams; `whole` marks windows within one row."""
    least = np.where(whole, np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(axis=1), np.uint64(0))
    around = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    held = np.concatenate([np.zeros(WINDOW - 1, bool), whole, np.zeros(WINDOW - 1, bool)])
    view = np.lib.stride_tricks.sliding_window_view
    return np.flatnonzero((view(around, WINDOW).max(axis=1) == grams) & view(held, WINDOW).any(axis=1))


def _block_units(data: np.ndarray, offsets: np.ndarray, min_words: int):
    """Row, start and end in code points, first word, words and two hashes of each unit of a block."""
    starts, ends, rows = word_spans(data, offsets)
    n = len(starts)
    if n == 0:
        return None
    words = span_hashes(data, starts, ends, lower=True)
    power, inverse = _power_tables(n + 1)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power[:n])]) for w in (words, mix64(words ^ np.uint64(_BASE)))]
    hashes = lambda i, at, count: mix64((sums[i][at + count] - sums[i][at]) * inverse[at] + count.astype(np.uint64))

    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    between = np.concatenate([[2], np.where(rows[1:] != rows[:-1], 2, feeds[starts[1:]] - feeds[ends[:-1]])])
    found = []
    lines = np.cumsum(between > 0)
    for least in (1, 2):
        at = np.flatnonzero(between >= least)
        count = np.diff(np.append(at, n))
        kept = count >= min_words
        if least == 2:  # a paragraph of one line is that line
            kept &= lines[at] != lines[at + count - 1]
        at, count = at[kept], count[kept]
        found.append((at, count, hashes(0, at, count), hashes(1, at, count)))
    reach = PASSAGE_WORDS + WINDOW - 1
    if n >= reach:
        at = np.arange(n - PASSAGE_WORDS + 1)
        grams = hashes(0, at, np.full(len(at), PASSAGE_WORDS))
        at = _least_of_windows(grams, rows[: n - reach + 1] == rows[reach - 1 :])
        found.append((at, np.full(len(at), PASSAGE_WORDS), grams[at], np.zeros(len(at), np.uint64)))
    at, count, h, g = (np.concatenate(c) for c in zip(*found, strict=True))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = rows[at]
    base = points[offsets[row]]
    return row, points[starts[at]] - base, points[ends[at + count - 1]] - base, at - np.searchsorted(rows, row), count, h.view(np.int64), g.view(np.int64)


def _passage_units(min_words: int):
    names = ["doc_id", "row_key", "start", "end", "word", "words", "h", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column("text")):
                if (found := _block_units(data, offsets, min_words)) is None:
                    continue
                row, *columns = found
                counts = np.bincount(row, minlength=len(offsets) - 1)
                some = np.flatnonzero(counts)  # a row of 0 words tells the number of a text's units
                none = np.zeros(len(some), np.int64)
                columns = [np.concatenate([c, x]) for c, x in zip(columns, (counts[some], *[none] * 5), strict=True)]
                at = pa.array(first + np.concatenate([row, some]))
                ids = [batch.column(c).take(at) for c in ("doc_id", "row_key")]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c.astype(np.int32)) for c in columns[:4]), *(pa.array(c) for c in columns[4:])], names)

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of repeated_spans, for lines, paragraphs and passages together.

    Repeated units that overlap are one span, whose keep_id is that of its first unit. Spans go from
    the start of a word to the end of a word. Where a text repeats itself with an overlap, the words
    of the first occurrence stay. Ranks, null and empty texts are as in repeated_spans.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.md5(F.coalesce("text", F.lit("")))).alias("row_key"))
    found = rows.mapInArrow(_passage_units(min_words), "doc_id long, row_key long, start int, end int, word int, words int, h long, g long")
    found = materialise(found, "passages")
    counts = found.filter("words = 0").groupBy(F.col("doc_id").alias("cd"), F.col("row_key").alias("cr")).agg(F.max("start").cast("long").alias("n_units"))
    counts = materialise(counts, "passage-counts")
    # Most units occur once. They go by 40 bits of the hash, so that few bytes are shuffled; what is left is compared by all bits.
    part = F.shiftright("h", 24)
    often = found.filter("words > 0").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("part")
    often = materialise(often, "passage-parts")
    tidy(docs.sparkSession)
    repeats = materialise(found.filter("words > 0").join(often, part == F.col("part"), "left_semi"), "passage-repeats")
    for used in (found, often):
        release(used)
    tidy(docs.sparkSession)
    found, place = repeats, F.struct("doc_id", "row_key", "start", "end", "word")
    first = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    first = materialise(first, "passage-firsts")  # a join of two plain shuffles can split a common unit's rows
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    again = found.join(first, ["h", "g"]).filter(~(same & (F.col("start") == F.col("first.start"))))
    overlaps = same & (F.col("start") <= F.col("first.end"))
    again = again.select(
        "doc_id",
        "row_key",
        F.when(overlaps, F.col("first.end") + 1).otherwise(F.col("start")).alias("start"),
        "end",
        F.when(overlaps, F.col("first.word") + F.col("words")).otherwise(F.col("word")).alias("word"),
        (F.col("word") + F.col("words")).alias("last"),
        F.col("first.doc_id").alias("keep_id"),
    )
    by = Window.partitionBy("doc_id", "row_key").orderBy("word", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("opens", F.when(F.col("word") < before, 0).otherwise(1)).withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "row_key", "run").agg(F.min(F.struct("word", "start", F.col("keep_id"))).alias("head"), F.max("end").alias("end"), F.max("last").alias("last"))
    runs = runs.filter(F.col("last") - F.col("head.word") >= min_words)
    span = F.struct(F.col("head.start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("head.keep_id").alias("keep_id"))
    removed = runs.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("r")).agg(F.sort_array(F.collect_list(span)).alias("removed"))
    return _per_row(rows.select("doc_id", "row_key"), counts, removed)


def _per_row(keys: DataFrame, counts: DataFrame, removed: DataFrame) -> DataFrame:
    sides = counts.join(removed, F.col("cd").eqNullSafe(F.col("d")) & (F.col("cr") == F.col("r")), "left").drop("d", "r")
    out = keys.join(sides, F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("row_key") == F.col("cr")), "left")
    none = F.array().cast("array<struct<start: bigint, end: bigint, keep_id: bigint>>")
    return out.select("doc_id", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.greatest(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"))


def cut(text: str | None, spans: list[dict]) -> str:
    """A text without the given spans; a separator next to a removed unit goes with it."""
    kept, at = [], 0
    text = text or ""
    for span in spans:
        kept.append(text[at : span["start"]])
        at = min(len(text), span["end"] + (span["end"] < len(text)))
    return "".join(kept) + text[at:]


def remove_repeats(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """The input's columns with repeated units cut from text, and a column removed_spans (removed_spans_ where it exists).

    Spans belong to a text of a doc_id, null ids included: of rows that share an id each loses its
    own repeats, and rows equal in both are cut alike. Null and empty texts stay as they are; empty
    input gives an empty result.
    """
    added = free_name("removed_spans", docs.columns)
    found = _removed(_keyed(docs), unit, min_words)[1].select(F.col("d").alias("cut_id"), F.col("r").alias("cut_key"), F.col("removed").alias("cut_spans"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.md5(F.coalesce("text", F.lit("")))).alias("own_key"))
    joined = packed.join(found, F.col("own_id").eqNullSafe(F.col("cut_id")) & (F.col("own_key") == F.col("cut_key")), "left").select("row.*", F.col("cut_spans").alias(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if not s else cut(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column(added).to_pylist(), strict=True)]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return joined.mapInArrow(run, joined.schema)
