"""Best-fit packing of token sequences by a configuration linear program.

Documents are encoded in one pass and cut into pieces of at most `capacity` tokens. The lengths'
histogram has one count for each length up to the capacity, however many pieces there are, so
the linear program over ways to fill a sequence (configurations) is solved on the driver:
multiplicative weights price the lengths, lagging ones higher, and a knapsack dynamic program
finds the best configuration at those prices. Rounding keeps the whole part of each
configuration's share; what is left is filled configuration by configuration, each with the
longest piece that remains and the fullest set of others beside it.

A plan is a bounded list of configurations, each with the number of sequences it fills. Pieces
find their place by their rank among the pieces of their length, which is summed over hash
buckets, so that a length that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapframe.llm.bpe import read_tokenizer, without_trimming
from snapframe.llm.common import materialise

CAPACITY = 1024
END_ID = 2
ROUNDS = 600
STEP = 0.25
SHARPNESS = 1.0
EPOCHS = 8
PATIENCE = 2
BASE = 1.2  # first prices are tokens to this power: a long piece is harder to place than short ones of equal size
WORDS_HELD = 250_000
BUCKET_ROWS = 200_000

# --------------------------------------------------------------------------- encoding

# The pattern by which the byte-level tokenizer cuts texts, a fixed value of its format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile(r"\s (?:\s|\Z)")
_SPACED = ("  ", "\n ", "\t ", "\r ", "\v ", "\f ")
_CUTS = re.compile(r"(?<=\S)(?= )")


class Words(dict):
    """Ids, as little-endian bytes, of words that follow `lead`; two generations bound what is held."""

    def __init__(self, lead: str, encode, held: int = WORDS_HELD):
        super().__init__()
        self.lead, self.encode, self.held, self.old = lead, encode, held, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.encode(self.lead + word), "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.held:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """Whole texts' ids from their words' ids.

    A byte-level tokenizer never joins a space to what stands before it, unless that is white
    space too: at every other space a text may be cut, and each word with the space before it is
    encoded once for as long as it is held. Texts with runs of white space about a space are cut
    at the safe places only. Words of Latin letters go to the library's sibling that merges the
    same vocabulary by rank, which gives the same ids; words with other characters, and those
    that may hold an added token, go to the library itself. Other kinds of tokenizers encode
    whole texts with the library.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(without_trimming(spec))
        self.library.no_truncation()
        self.library.no_padding()
        self.by_rank = _ranked(json.loads(spec))
        self.first, self.later = Words("", self._word), Words(" ", self._word)

    def _library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        if "<" in word or not (word.isascii() or max(word) < "ɐ"):
            return self._library(word)
        return self.by_rank.encode_ordinary(word)

    def __call__(self, text: str) -> bytes:
        if self.by_rank is None:
            return np.array(self._library(text), "<u4").tobytes()
        if any(s in text for s in _SPACED) or (not text.isascii() and _ODD.search(text)):
            parts = _CUTS.split(text)
            return self.first[parts[0]] + b"".join([self.later[p[1:]] for p in parts[1:]])
        first, *words = text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, words))


def _ranked(spec: dict):
    """The rank-merging encoder of a byte-level tokenizer, or None where the file is of another kind."""
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
    if model.get("type") != "BPE" or spec.get("normalizer") or not plain or any("<" not in t["content"] for t in spec.get("added_tokens", [])):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    # Byte-level files write each byte as a printable character: itself, or one from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if len(ranks) != len(model["vocab"]) or made != sorted(made) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    import tiktoken

    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


_encoders: dict[str, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = WordEncoder(spec)
    return _encoders[name]


def cut_places(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens start: only the first may be shorter than the capacity."""
    return [0, *range((n - 1) % capacity + 1, n, capacity)] if n else []


def _pieces(broadcast, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(broadcast.value)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for first in range(0, batch.num_rows, 256):
                source, piece, start, length, crc, tokens = [], [], [], [], [], []
                for r, doc in enumerate(text.slice(first, 256).to_pylist(), first):
                    raw = encode(doc or "") + end
                    n = len(raw) // 4
                    starts = cut_places(n, capacity)
                    stops = [*starts[1:], n]
                    source += [r] * len(starts)
                    piece += range(len(starts))
                    start += starts
                    length += [b - a for a, b in zip(starts, stops, strict=True)]
                    view = memoryview(raw)
                    crc += [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts, stops, strict=True)]
                    if with_ids:
                        tokens += [np.frombuffer(raw, "<u4")[a:b].astype(np.int32) for a, b in zip(starts, stops, strict=True)]
                columns = [ids.take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document's tokens, and an end token after them, cut into pieces of at most `capacity`.

    doc_id, piece, start, length, ids_crc32, and ids if asked for. Null and empty texts are one end
    token. Repeated rows are cut one by one; empty input gives an empty result; other columns
    are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return read.mapInArrow(_pieces(spec, capacity, end_id, with_ids), schema)


# --------------------------------------------------------------------------- the linear program


def _split(lengths: np.ndarray, most: np.ndarray) -> list[tuple[int, int]]:
    """(length index, multiple) of items that make up every number of copies up to `most`, longest lengths first."""
    items = []
    for i in range(len(lengths) - 1, -1, -1):
        left, power = int(most[i]), 1
        while left > 0:
            take = min(power, left)
            items.append((i, take))
            left -= take
            power *= 2
    return items


def priced(lengths: np.ndarray, most: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of greatest price (index of length to copies), by a bounded knapsack dynamic program."""
    items = _split(lengths, most)
    best, chosen = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for k, (i, take) in enumerate(items):
        weight = int(lengths[i]) * take
        if weight <= capacity:
            offer = best[: capacity + 1 - weight] + prices[i] * take
            better = offer > best[weight:]
            chosen[k, weight:] = better
            np.copyto(best[weight:], offer, where=better)
    config, room = {}, int(best.argmax())
    for k in range(len(items) - 1, -1, -1):
        if chosen[k, room]:
            i, take = items[k]
            config[i] = config.get(i, 0) + take
            room -= int(lengths[i]) * take
    return config


def fullest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """The longest length that is left and the fullest set of others beside it, of long pieces rather than short ones."""
    top = int(np.flatnonzero(left)[-1])
    room = capacity - int(lengths[top])
    most = np.minimum(left, room // lengths)
    most[top] = min(int(left[top]) - 1, room // int(lengths[top]))
    items = [(i, take) for i, take in _split(lengths, most) if lengths[i] * take <= room]
    reached, mask = [1], (1 << (room + 1)) - 1
    for i, take in items:
        reached.append(reached[-1] | (reached[-1] << (int(lengths[i]) * take)) & mask)
    config, goal = {top: 1}, reached[-1].bit_length() - 1
    for k in range(len(items) - 1, -1, -1):
        if not reached[k] >> goal & 1:
            i, take = items[k]
            config[i] = config.get(i, 0) + take
            goal -= int(lengths[i]) * take
    return config


def fractional(lengths: np.ndarray, demand: np.ndarray, base: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Configurations with the sequences each fills, by multiplicative weights.

    A length's price is its base price times exp(-SHARPNESS * share of its demand that is met), so
    that lengths are met evenly. A round fills as many sequences with the best configuration as
    use up STEP of the demand of one of its lengths, or one piece of it, and never more than is left.
    """
    met, found = np.zeros(len(lengths)), []
    for _ in range(ROUNDS):
        left = demand * (1 - met)
        most = np.minimum(np.ceil(left - 1e-9), capacity // lengths).astype(np.int64)
        if not most.any():
            break
        config = priced(lengths, most, base * np.exp(-SHARPNESS * met), capacity)
        share = min(min(max(STEP * demand[i], 1.0), left[i]) / copies for i, copies in config.items())
        for i, copies in config.items():
            met[i] += share * copies / demand[i]
        met[met > 1 - 1e-9] = 1.0
        found.append((config, share))
    return found


def repriced(lengths: np.ndarray, base: np.ndarray, shares: list[tuple[dict[int, int], float]], capacity: int) -> np.ndarray:
    """Base prices times what a token of each length has cost: lengths that were met in badly filled sequences get dearer."""
    cost, served = np.zeros(len(lengths)), np.full(len(lengths), 1e-300)
    for config, share in shares:
        waste = capacity / sum(int(lengths[i]) * copies for i, copies in config.items())
        for i, copies in config.items():
            cost[i] += share * copies * waste
            served[i] += share * copies
    return base * np.where(cost > 0, cost / served, 1.0)


def rounded(lengths: np.ndarray, demand: np.ndarray, shares: list[tuple[dict[int, int], float]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The whole part of each configuration's share, and the rest filled up."""
    left, used = demand.copy(), []
    for config, share in shares:
        times = min(int(share + 1e-9), *(int(left[i]) // copies for i, copies in config.items()))
        if times:
            used.append((config, times))
            for i, copies in config.items():
                left[i] -= copies * times
    while left.any():
        config = fullest(lengths, left, capacity)
        times = min(int(left[i]) // copies for i, copies in config.items())
        used.append((config, times))
        for i, copies in config.items():
            left[i] -= copies * times
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(copies by length, number of sequences) of every configuration used; together they hold each length exactly as often as the histogram.

    The program is solved with prices by tokens, and again with prices that learn from the waste of
    the solution before, until the least number possible is met, PATIENCE times nothing was gained or
    EPOCHS are over; the best rounded solution counts.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], np.int64)
    best, idle, least, base = [], 0, least_sequences(histogram, capacity), lengths.astype(float) ** BASE
    for _ in range(EPOCHS if len(lengths) else 0):
        shares = fractional(lengths, demand, base, capacity)
        used = rounded(lengths, demand, shares, capacity)
        better = not best or sum(t for _, t in used) < sum(t for _, t in best)
        best, idle = (used, 0) if better else (best, idle + 1)
        if sum(t for _, t in best) == least or idle == PATIENCE:
            break
        base = repriced(lengths, base, shares, capacity)
    return [({int(lengths[i]): copies for i, copies in config.items()}, times) for config, times in best]


def least_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """A number of sequences that no packing can go below: by tokens, or by pieces longer than half the capacity."""
    tokens = sum(n * c for n, c in histogram.items())
    return max(-(-tokens // capacity), sum(c for n, c in histogram.items() if 2 * n > capacity))


# --------------------------------------------------------------------------- places


def _slots(used: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and configuration: the rank at which it begins, its first sequence, copies and offset."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for config, times in used:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, copies, offset))
            next_rank[length] = rank + copies * times
            offset += length * copies
        sequence += times
    rows.sort()
    names = ("length", "rank", "sequence", "copies", "offset")
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(names)}


def _placer(broadcast, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = broadcast.value
        keys = (slots["length"] << 44) + slots["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            within = rank - slots["rank"][at]
            sequence = slots["sequence"][at] + within // slots["copies"][at]
            offset = slots["offset"][at] + within % slots["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(sequence), pa.array(offset)], [*extra, "sequence_id", "offset"])

    return run


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `cut` (length from 1 to the capacity, doc_id, piece, start, ids_crc32) with sequence_id and offset.

    `cut` is read several times and must be a written table. Empty input gives an empty result.
    """
    spark = cut.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * parts, cut.count() // BUCKET_ROWS)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    histogram = {r["length"]: r["rows"] for r in counts.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}  # one row for each length
    used = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    upto = F.sum("rows").over(Window.partitionBy("length").orderBy("bucket"))
    starts = counts.select(F.col("length").alias("l"), F.col("bucket").alias("b"), (upto - F.col("rows")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(order)).join(starts, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") - 1).select(*cut.columns, "rank")
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_placer(used, cut.columns), schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset.

    Null and empty texts are one end token; repeated rows and null ids are pieces like any others;
    of pieces that tie it is not told which takes which place. No piece is cut, dropped or doubled,
    and a sequence's pieces leave no gap from offset 0 on. Empty input gives an empty result;
    extra columns are ignored.
    """
    return place(materialise(pieces(docs, tokenizer_path, capacity, end_id, with_ids), "packing-pieces"), capacity)
