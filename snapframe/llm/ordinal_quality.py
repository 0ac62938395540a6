"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its
score into grades: P(grade > j) = sigmoid(score - threshold_j). Thresholds are kept ordered by
holding their gaps as exponentials. The expected grade is the sum of the tail probabilities, and
documents are selected by the tail probability at a chosen grade.

Features are byte n-grams of the text with letters folded to their kind of symbol where only the
shape matters, words, and banded shape statistics, hashed into DIMENSIONS slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapframe.llm.common import blocks, materialise, mix64, span_hashes, word_spans
from snapframe.llm.language_id import fold

DIMENSIONS = 1 << 12
SAMPLE_DOCS = 6000  # graded documents that are fitted, about
STEPS = 400
RIDGE = 3e-4
MAX_GRADES = 32

_shape = np.full(256, ord("?"), np.uint8)  # what a byte looks like
_shape[97:123] = _shape[128:] = ord("a")
_shape[65:91] = ord("A")
_shape[48:58] = ord("0")
for _c in b" .,;:!?#*$%&|<>@/\\()[]{}\"'-_=+~^`":
    _shape[_c] = _c
_shape[9:14] = ord("\n")


def _slots(values: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(values.astype(np.uint64) * np.uint64(8) + np.uint64(kind)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def _band(x: float) -> int:
    return int(np.floor(4 * np.log2(x + 1 / 256))) + 64


def features(data: np.ndarray, offsets: np.ndarray):
    """For each text of a block its slots and values: damped counts of unit length by kind."""
    starts, ends, rows = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, lower=True)
    shape = _shape[data].astype(np.uint64)
    grams = np.zeros(len(data), np.uint64)
    for j in range(4):
        grams[: len(data) - j] |= shape[j:] << np.uint64(8 * j)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    symbols = np.concatenate([[0], np.cumsum(~np.isin(shape, np.frombuffer(b"aA0 \n.,", np.uint8)))])
    uppers = np.concatenate([[0], np.cumsum(shape == ord("A"))])
    for r in range(len(offsets) - 1):
        a, b, lo, hi = int(first[r]), int(first[r + 1]), int(offsets[r]), int(offsets[r + 1])
        n, size = b - a, max(hi - lo, 1)
        distinct = len(np.unique(words[a:b]))
        statistics = [n, distinct / max(n, 1), same[a:b].sum() / max(n, 1), (symbols[hi] - symbols[lo]) / max(n, 1), (uppers[hi] - uppers[lo]) / size, size / max(n, 1)]
        banded = np.array([i * 4096 + _band(float(x)) for i, x in enumerate(statistics)], np.uint64)
        slots, values = [np.zeros(1, np.int64), _slots(banded, 1)], [np.ones(1), np.full(len(banded), 0.5)]
        for found, kind in ((grams[lo : max(lo, hi - 3)], 2), (words[a:b], 3)):
            if len(found):
                slot, count = np.unique(_slots(found, kind), return_counts=True)
                weight = np.log1p(count)
                slots.append(slot)
                values.append(weight / np.sqrt((weight**2).sum()))
        slot = np.concatenate(slots)
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], np.concatenate(values)[order]
        edge = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        yield slot[edge], np.add.reduceat(value, edge)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    """thresholds[j] separates the grades up to j from those above; grades run from `lowest`."""

    weights: np.ndarray
    thresholds: np.ndarray
    lowest: int

    def tails(self, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade > lowest + j) for each threshold j."""
        return _sigmoid(float(self.weights[slots] @ values) - self.thresholds)


def fit(slots: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> OrdinalModel:
    """Maximum likelihood by Adam on the cumulative-link model."""
    lowest, k = int(grades.min()), int(grades.max() - grades.min()) + 1
    y = grades - lowest
    index = np.concatenate(slots)
    value = np.concatenate(values)
    doc = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    share = np.clip(np.array([(y > j).mean() for j in range(k - 1)]), 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(k - 1))
    raw = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    params = np.concatenate([np.zeros(DIMENSIONS), raw])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        raw = params[DIMENSIONS:]
        cuts = np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))]) if k > 1 else np.zeros(0)
        score = np.bincount(doc, params[index] * value, minlength=len(y))
        above = _sigmoid(score[:, None] - cuts[None, :])
        edges = np.concatenate([np.ones((len(y), 1)), above, np.zeros((len(y), 1))], 1)
        p = np.maximum(edges[np.arange(len(y)), y] - edges[np.arange(len(y)), y + 1], 1e-12)
        slope = np.concatenate([np.zeros((len(y), 1)), above * (1 - above), np.zeros((len(y), 1))], 1)
        low, high = slope[np.arange(len(y)), y] / p, slope[np.arange(len(y)), y + 1] / p
        d_score = low - high
        gradient = np.zeros_like(params)
        gradient[:DIMENSIONS] = np.bincount(index, d_score[doc] * value, minlength=DIMENSIONS) / len(y) - ridge * params[:DIMENSIONS]
        d_cuts = np.zeros(k + 1)
        np.add.at(d_cuts, y, -low)
        np.add.at(d_cuts, y + 1, high)
        d_cuts = d_cuts[1:k] / len(y)
        tail = np.cumsum(d_cuts[::-1])[::-1]
        gradient[DIMENSIONS:] = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])]) if k > 1 else 0
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        params = params + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    raw = params[DIMENSIONS:]
    cuts = np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))]) if k > 1 else np.zeros(0)
    return OrdinalModel(params[:DIMENSIONS], cuts, lowest)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, values = [], []
        for _, data, offsets in blocks(batch.column("text")):
            for s, v in features(data, offsets):
                slots.append(s.astype(np.int16))
                values.append(v.astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(slots, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "grade", "slots", "values"])


def learn(docs: DataFrame, grades: DataFrame, sample_docs: int = SAMPLE_DOCS) -> OrdinalModel | None:
    """Fit on `grades` (doc_id, grade); about `sample_docs` of them, chosen by a hash of doc_id.

    None if nothing is graded. The sample bounds the broadcast and what reaches the driver.
    """
    graded = grades.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("grade").cast("int")).alias("grade"))
    total = graded.count()
    if not total:
        return None
    sample = graded.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < sample_docs / total)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = texts.mapInArrow(_featurise, "doc_id long, grade int, slots array<short>, values array<float>").toArrow().sort_by("doc_id")
    if not len(rows):
        return None
    y = rows.column("grade").to_numpy().astype(np.int64)
    if y.max() - y.min() >= MAX_GRADES:
        raise ValueError(f"grades from {y.min()} to {y.max()}: more than {MAX_GRADES} grades")
    unpack = lambda c, kind: [np.asarray(x.values.to_numpy(), kind) for x in rows.column(c)]
    return fit(unpack("slots", np.int64), unpack("values", float), y)


def grade(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """One row per input row: doc_id, expected_grade, tails (P(grade > lowest + j) by j).

    Null and empty texts are graded by their shape features alone. Without a model both are null.
    Rows are graded one by one; empty input gives an empty result; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            expected, tails = [], []
            for _, data, offsets in blocks(batch.column("text")):
                for slots, values in features(data, offsets):
                    tail = fitted.tails(slots, values) if fitted else None
                    expected.append(None if tail is None else fitted.lowest + float(tail.sum()))
                    tails.append(tail)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected, pa.float64()), pa.array(tails, pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, p_usable, p_best, selected; learned outside fold 0 of 5.

    The labels give three grades: 0 for low quality, 1 for toxic text of good quality, 2 for the
    rest. A document is selected if it is likelier than not above the lowest grade.
    """
    rated = labels.filter(fold(5) != 0).select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
    model = learn(docs, rated)
    p_best = F.element_at("tails", -1)
    graded = grade(docs, model).withColumn("p_usable", F.get("tails", F.lit(0)))
    return graded.select("doc_id", (fold(5) == 0).alias("held_out"), "expected_grade", "p_usable", p_best.alias("p_best"), (F.coalesce("p_usable", F.lit(1.0)) >= 0.5).alias("selected"))
