"""Language identification by bit-sliced Bloom filters over byte n-grams.

Slot i of the filter holds one bit per language. An n-gram sets its language's bit in K_HASHES
slots; AND-ing the slots of a query n-gram gives the mask of all languages containing it in one
lookup. A document's hits per language are the popcounts of these masks by bit. A language's
filter answers a random n-gram falsely at rate fill ** K_HASHES; the count is corrected by it.
The language with most corrected hits is predicted, and its share of them is the score.

N-grams are four bytes of the lower-cased text in which non-letters are blanks. A language keeps
those n-grams at least RATIO times as frequent in it as in any other language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapframe.llm.common import blocks, free_name, mix64

GRAM_BYTES = 4
K_HASHES = 2
FILTER_BITS = 19
SAMPLE_DOCS = 4000  # training documents per language, about
GRAMS_PER_LANGUAGE = 1 << 15
RATIO = 0.5
LEAST_COUNT = 3
UNKNOWN = "und"

_fold = np.full(256, 32, np.uint8)
_fold[128:] = np.arange(128, 256)
for _c in range(26):
    _fold[65 + _c] = _fold[97 + _c] = 97 + _c


def grams(data: np.ndarray, offsets: np.ndarray):
    """N-grams of a block as uint32, each text standing between two blanks; and row bounds."""
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    padded = np.full(len(data) + 2 * len(lengths) + GRAM_BYTES, 32, np.uint8)
    padded[np.arange(len(data)) + 2 * rows + 1] = _fold[data]
    n = len(data) + 2 * len(lengths)
    found = np.zeros(n, np.uint32)
    for j in range(GRAM_BYTES):
        found |= padded[j : n + j].astype(np.uint32) << np.uint32(8 * j)
    bounds = offsets + 2 * np.arange(len(offsets))
    for d in range(1, GRAM_BYTES):  # what follows a text is blank to it, and not the next text
        at = bounds[1:][np.diff(bounds) >= d] - d
        own = (1 << 8 * d) - 1
        found[at] = (found[at] & np.uint32(own)) | np.uint32(0x20202020 & ~own & 0xFFFFFFFF)
    return found, bounds


def slots(found: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix64(found.astype(np.uint64) + np.uint64(1))
    return [((h >> np.uint64(32 * j)) & np.uint64((1 << bits) - 1)).astype(np.int64) for j in range(K_HASHES)]


@dataclass
class LanguageFilter:
    """planes[p][slot] holds the bits of languages 64p .. 64p+63, in a word as small as fits."""

    languages: list[str]
    priors: np.ndarray
    planes: list[np.ndarray]
    bits: int

    @classmethod
    def build(cls, entries: dict[str, np.ndarray], priors: dict[str, int], bits: int = FILTER_BITS) -> LanguageFilter:
        languages = sorted(priors, key=lambda x: x.encode())
        planes = []
        for first in range(0, len(languages), 64):
            group = languages[first : first + 64]
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= len(group))
            plane = np.zeros(1 << bits, kind)
            for i, lang in enumerate(group):
                for s in slots(entries.get(lang, np.zeros(0, np.uint32)), bits):
                    plane[s] |= kind(1 << i)
            planes.append(plane)
        return cls(languages, np.array([priors[x] for x in languages], float), planes, bits)

    def false_rates(self) -> np.ndarray:
        rates = [float(np.mean(plane >> plane.dtype.type(i) & plane.dtype.type(1))) ** K_HASHES for p, plane in enumerate(self.planes) for i in range(min(64, len(self.languages) - 64 * p))]
        return np.array(rates)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected hits of each text of a block by language."""
        found, bounds = grams(data, offsets)
        where = slots(found, self.bits)
        counts = []
        for p, plane in enumerate(self.planes):
            masks = plane[where[0]]
            for w in where[1:]:
                masks &= plane[w]
            for i in range(min(64, len(self.languages) - 64 * p)):
                counts.append(np.add.reduceat((masks >> plane.dtype.type(i) & plane.dtype.type(1)).astype(np.int32), bounds[:-1]))
        raw, total, false = np.array(counts, float).T, np.diff(bounds)[:, None], self.false_rates()
        return np.maximum(0.0, (raw - total * false) / (1 - np.minimum(false, 0.999)))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; UNKNOWN and 0 without a letter."""
        names, scores = [UNKNOWN] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
        if not self.languages or not len(names):
            return names, scores
        hits = self.hits(data, offsets)
        raw = None
        letter = np.concatenate([[0], np.cumsum((_fold[data] >= 97) & (data < 128))])
        some = letter[offsets[1:]] > letter[offsets[:-1]]
        for r in range(len(names)):
            if not some[r]:
                raw = data.tobytes() if raw is None else raw
                if not any(c.isalpha() for c in raw[offsets[r] : offsets[r + 1]].decode()):
                    continue
            total = hits[r].sum()
            best = max(range(len(self.languages)), key=lambda i: (hits[r, i], self.priors[i], -i))
            names[r] = self.languages[best]
            scores[r] = hits[r, best] / total if total > 0 else 1.0 / len(self.languages)
        return names, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            rows = batch.filter(pa.array(langs == lang)).column("text")
            parts = [grams(data, offsets)[0] for _, data, offsets in blocks(rows)]
            parts = [p[p != 0x20202020] for p in parts]  # blanks alone tell no language
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, per_language: int = GRAMS_PER_LANGUAGE) -> LanguageFilter:
    """Fit the filters on `labelled` (doc_id, text, lang without nulls).

    At most about `sample_docs` documents of each language, chosen by a hash of doc_id, are
    counted, and the `per_language` most frequent n-grams of each are kept, which bounds what
    reaches the driver.
    """
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    priors = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not priors:
        return LanguageFilter.build({}, {})
    share = F.create_map(*(F.lit(x) for lang, n in priors.items() for x in (lang, min(1.0, sample_docs / n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = labelled.filter(draw < share[F.col("lang")]).select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    part = totals.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    own = part.withColumn("top", F.max("p").over(Window.partitionBy("gram"))).filter(F.col("p") >= RATIO * F.col("top"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= per_language)
    entries: dict[str, list[int]] = {}
    for r in ranked.select("lang", "gram").collect():
        entries.setdefault(r["lang"], []).append(r["gram"])
    return LanguageFilter.build({k: np.array(v, np.uint32) for k, v in entries.items()}, priors)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """The input's columns with lang_pred and score added (lang_pred_, score_ where such columns exist); no shuffle.

    Null or empty texts and texts without a letter are `und` with score 0. A text whose letters
    hit no filter gets the commonest language and score 1 / languages. Ties go to the commoner
    language, then by code point. Rows are judged one by one; empty input gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [free_name(c, docs.columns) for c in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, data, offsets in blocks(batch.column("text")):
                n, s = shared.value.predict(data, offsets)
                names += n
                scores += s.tolist()
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def fold(of: int, doc_id: str = "doc_id"):
    """Fold of a row: crc32 of its id as text, modulo `of`."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of)), F.lit(0))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows outside fold 2 of 4."""
    model = learn(docs.filter((fold(4) != 2) & F.col("lang").isNotNull()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


LEAST_SCORE = 1.2


def keep_identified(docs: DataFrame) -> DataFrame:
    """The input's rows and columns whose language can be told: not `und`, score LEAST_SCORE / languages or more.

    A text that hits no filter scores 1 / languages, and with two languages or more it goes however
    many there are; with one language nothing can be told apart and every text with a letter stays.
    Null and empty texts go, and without any labelled row all go. Repeated rows stay or go alike,
    null ids are judged as others, and extra columns of any name are carried along.
    """
    model = learn(docs.filter((fold(4) != 2) & F.col("lang").isNotNull()))
    known = identify(docs.select(F.struct("*").alias("row"), "text"), model)
    return known.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min(1.0, LEAST_SCORE / max(1, len(model.languages))))).select("row.*")
