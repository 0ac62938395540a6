"""N-gram Jaccard join by token-combination prefixes.

A document is its set of distinct WORDS-word shingles ("tokens", as 64-bit hashes). Tokens are
put in one global order, rare ones first. If two sets x and y link, |x| no more than |y|, x lacks
few tokens of y and y few of x, and bounds on both follow from the sizes. A prefix of one token
more than the bound must share a token with the other's prefix. Single frequent tokens are poor
keys; so the prefix is extended and frequent tokens are indexed in combinations: tokens fall
into groups by class and hash, a group of a class indexed by k-combinations absorbs n - (k - 1)
missing tokens, and the prefix grows until its groups absorb the bound and one more. Then one
whole combination survives in both prefixes. Rare tokens have k = 1, frequent ones k = 2, very
frequent ones k = 3. Combinations are kept by size bucket: a set is indexed in its own bucket
with the short prefix that suffices against larger sets, and probes each bucket of smaller ones
with a prefix whose length follows from that bucket's sizes.

Sets equal to each other are one class from the start. Lists of equal members count once.
Lists of up to LONG members give all their pairs. A member of longer lists is first compared with
one representative, the smallest first member among its lists. Links are contracted to components
before any further pair of a long list is made: in lists that still hold several components,
growing samples of pivots, the same documents in every list, meet the members of other components,
until all have met. Parity bitmaps, whose Hamming distance never exceeds the sets' difference, are
compared inside each list before any pair is made. Copies share many lists of nearly the same
members, so the pivots that a class may link with are brought together over all its lists: a pair is
made once, not once for each list. The same test discards most other false candidates before sets
are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapframe.llm.common import blocks, materialise, mix64, release, shingle_sets, tidy
from snapframe.llm.components import components

WORDS = 4
PERCENT = 85
LEAST_FREQUENT = 8
VERY_FREQUENT = 32  # times the frequency of a frequent token
SEGMENTS = 1 << 10
SEGMENT_BITS = 1 << 16
MAPS = ("again", "two", "three")
COUNTED_BELOW = int(0.4 * 2**64)  # hashes below it are counted exactly
BITMAP_BITS = 2048
FILTER_BITS = (16, 28)  # least and most, as powers of two; 16 bits a key between them
LONG = 32  # members of a list from which on its pairs are not all made
PIVOTS = 64
PIVOT_GROWTH = 64
PART = 64  # members and pivots of a list that meet at once
NO_ID = -(1 << 63)  # stands for a null doc_id in the filter


def _tokens(batch: pa.RecordBatch, words: int):
    for first, data, offsets in blocks(batch.column("text")):
        for r, tokens in enumerate(shingle_sets(data, offsets, words)):
            yield first + r, tokens


def set_key(tokens: np.ndarray) -> int:
    """64-bit name of a token set, equal for equal sets."""
    total = mix64(tokens ^ np.uint64(0xA0761D6478BD642F)).sum() + np.uint64(len(tokens))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def _token_slots(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment and the 32 bits that tell a token from others of its segment."""
    segment = (tokens >> np.uint64(22)) & np.uint64(SEGMENTS - 1)
    return segment.astype(np.int64), (tokens >> np.uint64(32)).astype(np.uint32)


def _bit_at(rest: np.ndarray) -> np.ndarray:
    return (mix64(rest.astype(np.uint64)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


def _spell(words: int):
    """Tokens of a batch's different sets, packed by segment.

    Prefixes are made of low hashes, so low tokens are all handed on. Of the others only those
    met repeatedly in a batch are, as often as they were met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            sets = []
            for _, tokens in _tokens(batch, words):
                if len(tokens) and (key := set_key(tokens)) not in seen:
                    seen.add(key)
                    sets.append(tokens)
            if not sets:
                continue
            every = np.sort(np.concatenate(sets))
            again = np.zeros(len(every), bool)
            again[1:] = every[1:] == every[:-1]
            again[:-1] |= again[1:]
            every = every[again | (every < np.uint64(COUNTED_BELOW))]
            if not len(every):
                continue
            segment, rest = _token_slots(every)
            order = np.argsort(segment, kind="stable")
            segment, rest = segment[order], rest[order]
            edge = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
            packed = [rest[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(segment[edge[:-1]], pa.int64()), pa.array(packed, pa.binary())], ["segment", "tokens"])

    return run


def _mark_frequent(limits: tuple[int, int, int]):
    """A segment's tokens counted, and those met as often as each limit marked in bits."""

    def close(segment: int, parts: list[bytes]):
        rest, n = np.unique(np.frombuffer(b"".join(parts), np.uint32), return_counts=True)
        maps = []
        for limit in limits:
            bits = np.zeros(SEGMENT_BITS, bool)
            bits[_bit_at(rest[n >= limit])] = True
            maps.append(pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), *maps], ["segment", *MAPS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            for segment, packed in zip(batch.column("segment").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if segment != current and parts:
                    yield close(current, parts)
                    parts = []
                current = segment
                parts.append(packed)
        if parts:
            yield close(current, parts)

    return run


class TokenClasses:
    """Which tokens are frequent (class 2) and very frequent (3), and which were met more than once, as bitmaps of fixed size.

    A rare token may be taken for a frequent one, but always and in every set alike, so linked
    sets still agree on their signatures. A token met once may be taken for one met again, which
    costs a key that nothing shares.
    """

    def __init__(self, again: np.ndarray, two: np.ndarray, three: np.ndarray):
        self.again, self.two, self.three = again, two, three

    @staticmethod
    def _place(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        segment, rest = _token_slots(tokens)
        at = segment * SEGMENT_BITS + _bit_at(rest)
        return at >> 3, (at & 7).astype(np.uint8)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        byte, bit = self._place(tokens)
        return (1 + (self.two[byte] >> bit & 1) + (self.three[byte] >> bit & 1)).astype(np.uint8)

    def met(self, tokens: np.ndarray) -> np.ndarray:
        """Whether more than one set may hold each token; only low hashes are counted whole."""
        byte, bit = self._place(tokens)
        return (tokens >= np.uint64(COUNTED_BELOW)) | (self.again[byte] >> bit & 1).astype(bool)


def token_classes(texts: DataFrame, words: int, least: int | None = None) -> TokenClasses:
    """Count the tokens of all texts and mark the frequent and the repeated ones; SEGMENTS x SEGMENT_BITS bits a map."""
    spark = texts.sparkSession
    least = least or LEAST_FREQUENT
    parts = min(SEGMENTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spelled = texts.mapInArrow(_spell(words), "segment long, tokens binary").repartition(parts, "segment").sortWithinPartitions("segment")
    maps = [np.zeros(SEGMENTS * SEGMENT_BITS // 8, np.uint8) for _ in MAPS]
    size = SEGMENT_BITS // 8
    for row in spelled.mapInArrow(_mark_frequent((2, least, least * VERY_FREQUENT)), f"segment long, {', '.join(f'{m} binary' for m in MAPS)}").collect():
        for held, name in zip(maps, MAPS, strict=True):
            held[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row[name], np.uint8)
    tidy(spark)
    return TokenClasses(*maps)


def missing(n: int, percent: int, other: int | None = None) -> int:
    """Most tokens of a set of n that a linked set of `other` or more tokens can lack.

    Without `other`, of any size.
    """
    return n + (-percent * n // 100 if other is None else -percent * (n + other) // (100 + percent))


def size_bucket(n: int) -> int:
    """Smallest size of the bucket of sets as large as n; buckets are a few percent wide at most."""
    shift = max(0, n.bit_length() - (7 if n < 256 else 6))
    return n >> shift << shift


def _buckets(n: int, percent: int) -> list[int]:
    """Buckets of the sets that may link with a larger one of n."""
    out, size = [], max(1, -(-percent * n // 100))
    while size <= n:
        out.append(size_bucket(size))
        size = out[-1] + (1 << max(0, size.bit_length() - (7 if size < 256 else 6)))
    return out


def _combined(rare: np.ndarray, rest: np.ndarray, mixed: np.ndarray, kinds: list[int], bucket: int, need: int, percent: int) -> list[np.ndarray]:
    """Combination keys of the prefix that absorbs `need` tokens, for one bucket."""
    n_groups = max(1, missing(bucket, percent, bucket) // 2)
    groups: dict[tuple[int, int], list[int]] = {}
    absorbed = len(rare)
    for i, kind in enumerate(kinds):
        if absorbed >= need:
            break
        group = groups.setdefault((kind, int(mixed[i]) % n_groups), [])
        group.append(i)
        absorbed += len(group) >= kind
    keys: dict[int, list[tuple]] = {}
    for (kind, _), group in groups.items():
        keys.setdefault(kind, []).extend(combinations(group, kind))
    salt = mix64(np.array([bucket], np.uint64))
    out = [mix64(mixed[np.array(found, np.int64)].sum(axis=1, dtype=np.uint64) * np.uint64(2 * kind + 1) + salt) for kind, found in keys.items() if found]
    if absorbed < need:  # sets too small to absorb all: among themselves they meet on single tokens
        out.append(mix64(np.concatenate([rare, rest])[:need] ^ (salt + np.uint64(1))))
    return out


def signatures(tokens: np.ndarray, classes: np.ndarray, percent: int = PERCENT, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a sorted token set: rare tokens, combinations it is indexed by, and ones it probes with.

    `classes` gives how many tokens of its kind a combination needs. Of two sets linked at
    `percent`, either both have a rare key, or the larger probes with a key of the smaller. Rare
    tokens that no other set holds (not `met`) fill the prefix like others, but are no keys.
    """
    n, none = len(tokens), np.zeros(0, np.uint64)
    most, short = missing(n, percent) + 1, missing(n, percent, n) + 1
    common = classes > 1
    rare = tokens[~common]
    shared = rare if met is None else rare[met[~common]]
    if len(rare) >= most:
        return mix64(shared[shared <= rare[most - 1]]), none, none
    rest, kinds = tokens[common], classes[common]
    order = np.lexsort((rest, kinds))
    rest, kinds = rest[order], kinds[order].tolist()
    mixed = mix64(rest ^ np.uint64(0x5851F42D4C957F2D))
    index = _combined(rare, rest, mixed, kinds, size_bucket(n), short, percent) if len(rare) < short else []
    probe: list[np.ndarray] = []
    for bucket in _buckets(n, percent):
        need = missing(n, percent, bucket) + 1
        if len(rare) < need:
            probe += _combined(rare, rest, mixed, kinds, bucket, need, percent)
    join = lambda x: np.unique(np.concatenate(x)) if x else none
    return mix64(shared), join(index), join(probe)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens by hash slot, as 64-bit words."""
    parity = np.bincount((tokens & np.uint64(BITMAP_BITS - 1)).astype(np.int64), minlength=BITMAP_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _index(words: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        seen: set[int] = set()
        for batch in batches:
            keys, counts, maps, sigs = [], [], [], ([], [], [])
            for _, tokens in _tokens(batch, words):
                counts.append(len(tokens))
                key = set_key(tokens) if len(tokens) else None
                keys.append(key)
                new = key is not None and key not in seen
                seen.add(key)
                maps.append(bitmap(tokens) if new else None)
                rare, leading, probing = signatures(tokens, classes.of(tokens), percent, classes.met(tokens)) if new else (None, None, None)
                if new and len(leading):  # a set probes with the keys it is indexed by as well: they are handed on once
                    probing = np.setdiff1d(probing, leading, assume_unique=True)
                for held, found in zip(sigs, (rare, leading, probing), strict=True):
                    held.append(found.view(np.int64) if new else None)
            longs = pa.list_(pa.int64())
            columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), *(pa.array(x, longs) for x in (maps, *sigs))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n", "k", "map", "rare", "leading", "probing"])

    return run


def _slots(keys: np.ndarray, doc_ids: np.ndarray, bits: int) -> np.ndarray:
    mixed = mix64(keys.view(np.uint64) ^ mix64(doc_ids.view(np.uint64)))
    return (mixed & np.uint64(bits - 1)).astype(np.int64)


def _held(packed: np.ndarray, keys: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    at = _slots(keys, doc_ids, 8 * len(packed))
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _key_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter over `count` (k, doc_id), built by the tasks and OR-ed together; 32 MB at most.

    Where it is too full it lets more keys by, which costs time and changes no result.
    """
    bits = 1 << min(max(FILTER_BITS[0], (16 * count).bit_length()), FILTER_BITS[1])
    step = min(bits // 8, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _slots(batch.column("k").to_numpy(), batch.column("doc_id").to_numpy(), bits)
            np.bitwise_or.at(packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = [i for i in range(0, len(packed), step) if packed[i : i + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([packed[i : i + step].tobytes() for i in parts], pa.binary())], ["at", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in keys.select("k", "doc_id").coalesce(8).mapInArrow(run, "at long, bits binary").toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        out[row["at"] : row["at"] + len(part)] |= part
    return out


def _sets(words: int, shared):
    """Token sets of the classes' chosen documents, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        seen: set[int] = set()
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy()
            keys, chosen, sets = [], [], []
            for row, tokens in _tokens(batch, words):
                if len(tokens) and (key := set_key(tokens)) not in seen and _held(packed, np.array([key]), doc_ids[row : row + 1])[0]:
                    seen.add(key)
                    keys.append(key)
                    chosen.append(doc_ids[row])
                    sets.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(chosen, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["k", "doc_id", "tokens"])

    return run


def _passing(shared):
    """Rows whose (k, doc_id) the filter lets by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_held(shared.value, batch.column("k").to_numpy(), batch.column("doc_id").to_numpy())))

    return run


def _of_keys(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(k, n, map) of the classes of `rows` (k) and of few others: bitmaps are long, and a join would shuffle all of them."""
    wanted = rows.select("k", F.lit(NO_ID).alias("doc_id")).distinct()
    shared = classes.sparkSession.sparkContext.broadcast(_key_filter(wanted, wanted.count()))
    every = classes.select("k", F.lit(NO_ID).alias("doc_id"), "n", "map")
    return every.mapInArrow(_passing(shared), "k long, doc_id long, n long, map array<long>").select("k", "n", "map")


def _may_link(na: str, nb: str, mapa: str, mapb: str, percent: int) -> Column:
    """Whether sizes and bitmaps of two sets allow a link."""
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.get(mapa, F.lit(i)).bitwiseXOR(F.get(mapb, F.lit(i)))) for i in range(BITMAP_BITS // 64)))
    return _alike(na, nb, percent) & (apart * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent))


def _alike(na: str, nb: str, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _near(percent: int):
    """Of each row's two groups of classes, those of the second that each of the first may link with; see _may_link."""

    def columns(groups: pa.Array):
        keys, n, labels, maps = groups.values.flatten()
        maps = maps.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITMAP_BITS // 64)
        return groups.offsets.to_numpy(), *(x.to_numpy(zero_copy_only=False) for x in (keys, n, labels)), maps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, k, n, label, bits), (pat, p, pn, plabel, pbits) = (columns(batch.column(c)) for c in ("members", "pivots"))
            rows, parts, found = [], [], []
            for r, part in enumerate(batch.column("part").to_pylist()):
                own, other = slice(at[r], at[r + 1]), slice(pat[r], pat[r + 1])
                size, psize = n[own, None], pn[None, other]
                may = (label[own, None] != plabel[None, other]) & (np.minimum(size, psize) * 100 >= np.maximum(size, psize) * percent)
                apart = np.bitwise_count(bits[own, None] ^ pbits[None, other]).sum(axis=2, dtype=np.int64)
                may &= apart * (100 + percent) <= (size + psize) * (100 - percent)
                some = np.flatnonzero(may.any(axis=1))
                rows += (some + at[r]).tolist()
                parts += [part] * len(some)
                found += [np.flatnonzero(may[i]) + pat[r] for i in some]
            others = np.concatenate(found) if found else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(p[others], pa.int64()), pa.array(pn[others], pa.int64())], ["p", "pn"]))
            rows = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k[rows], pa.int64()), pa.array(n[rows], pa.int64()), pa.array(parts, pa.int64()), lists], ["k", "n", "part", "others"])

    return run


class Verifier:
    """Tests candidate pairs of classes; reads the token sets of classes as they come up."""

    def __init__(self, texts: DataFrame, classes: DataFrame, words: int, percent: int):
        self.texts, self.classes, self.words, self.percent = texts, classes, words, percent
        self.scratch: list[DataFrame] = []
        self.sets: DataFrame | None = None
        self.known: DataFrame | None = None

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb) of the pairs whose sizes and bitmaps allow a link."""
        side = lambda x: self.classes.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"map{x}"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        return joined.filter(_may_link("na", "nb", "mapa", "mapb", self.percent)).select("a", "b", "na", "nb")

    def _sets_of(self, pairs: DataFrame, soon: DataFrame | None) -> DataFrame:
        """Token sets of the pairs' classes and of few others; texts are read for new classes only.

        Where they must be read, the sets of `soon` (k), which later pairs may be of, are read as well.
        """
        spark, schema = self.texts.sparkSession, "k long, doc_id long, tokens array<long>"
        wanted = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
        wanted = materialise(wanted.join(self.classes.select("k", "doc_id"), "k"), "wanted")
        new = wanted if self.known is None else materialise(wanted.join(self.known, "k", "left_anti"), "wanted-new")
        if fresh := new.count():
            if soon is not None:
                new = new.union(soon.join(self.classes.select("k", "doc_id"), "k")).distinct()
                new = materialise(new if self.known is None else new.join(self.known, "k", "left_anti"), "wanted-new")
                fresh = new.count()
            shared = spark.sparkContext.broadcast(_key_filter(new, fresh))
            found = materialise(self.texts.mapInArrow(_sets(self.words, shared), schema), "token-sets")
            self.scratch.append(found)
            if self.sets is None:
                self.sets, self.known = found, new.select("k")
                return found
            self.sets, self.known = self.sets.unionByName(found), self.known.union(new.select("k"))
        shared = spark.sparkContext.broadcast(_key_filter(wanted, wanted.count()))
        return self.sets.mapInArrow(_passing(shared), schema)

    def links(self, pairs: DataFrame, soon: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) that link; pairs with na and nb have passed the test of sizes and bitmaps."""
        pairs = materialise(pairs if "na" in pairs.columns else self.plausible(pairs), "pairs")
        if pairs.isEmpty():
            return pairs.select("a", "b")
        sets = self._sets_of(pairs, soon)
        side = lambda x: sets.select(F.col("k").alias(x), F.col("tokens").alias(f"t{x}"))
        both = F.size(F.array_intersect("ta", "tb"))
        tested = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
        linked = tested.filter(100 * F.col("both") >= self.percent * (F.col("na") + F.col("nb") - F.col("both")))
        found = materialise(linked.select("a", "b").distinct(), "links")
        release(pairs)
        tidy(pairs.sparkSession)
        return found


def _signature_lists(indexed: DataFrame) -> DataFrame:
    """(sig, k, n, lead, size, least) of the lists that hold different classes, one of each membership.

    least is the list's smallest class that leads, and size its number of classes.
    """
    # A sorted task of one shuffle counts and marks each list; a list's rows spill where they are many.
    own, lead = Window.partitionBy("sig"), F.when(F.col("lead"), F.col("k"))
    keys = [indexed.select(F.explode(c).alias("sig"), "k", "n", F.lit(c != "probing").alias("lead")) for c in ("rare", "leading", "probing")]
    useful = reduce(DataFrame.union, keys).select("*", F.min("k").over(own).alias("low"), F.max("k").over(own).alias("high"), F.min(lead).over(own).alias("least"))
    useful = useful.filter("low <> high AND least IS NOT NULL").groupBy("sig", "k", "n").agg(F.bool_or("lead").alias("lead"), F.first("low").alias("low"), F.first("least").alias("least"))
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "k", "lead")).over(own)
    every = materialise(useful.select("*", F.count(F.lit(1)).over(own).alias("size"), mark(1).alias("x"), mark(2).alias("y")), "postings")
    # Of lists with the same members one is enough.
    chosen = every.filter("k = low").groupBy("size", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    members = materialise(every.join(chosen, "sig", "left_semi").select("sig", "k", "n", "lead", "size", "least"), "lists")
    release(every)
    return members


def _first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of the short lists; of the long ones, each member with one representative."""
    short = members.filter(F.col("size") <= LONG)
    other = short.select("sig", F.col("k").alias("p"), F.col("n").alias("pn"), F.col("lead").alias("plead"))
    paired = short.join(other, "sig").filter((F.col("k") < F.col("p")) & (F.col("lead") | F.col("plead")) & _alike("n", "pn", percent)).select(F.col("k").alias("a"), F.col("p").alias("b"))
    hooked = members.filter((F.col("size") > LONG) & (F.col("k") != F.col("least"))).groupBy("k").agg(F.min("least").alias("p"))
    return paired.union(hooked.select(F.least("k", "p"), F.greatest("k", "p"))).distinct()


def _pivot_pairs(left: DataFrame, pivots: int, percent: int) -> DataFrame:
    """(a, b, na, nb), each once, of members of `left` (sig, k, n, map, lead, size, label) and those of about `pivots` pivots of each of their lists that they may link with.

    Pivots are the same classes in every list. A list tests its members with its pivots of other
    components, and what a class may link with is brought together over all its lists before any
    pair is made. Members and pivots of a list meet in parts of about PART, told by hashes, so that
    no row grows with a list.
    """
    held = F.collect_list(F.struct("k", "n", "label", "map"))
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "k"), F.ceil(n / PART))
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 40)) / float(1 << 40)
    members = left.groupBy("sig", deal(1, F.col("size")).alias("block")).agg(held.alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi")).drop("block")
    chosen = left.filter(F.col("lead") & (draw * F.col("size") < pivots)).groupBy("sig", deal(2, F.lit(pivots)).alias("part"))
    chosen = chosen.agg(held.alias("pivots"), F.min("label").alias("plo"), F.max("label").alias("phi"))
    met = members.join(chosen, "sig").filter((F.least("lo", "plo") < F.greatest("hi", "phi"))).select("part", "members", "pivots")
    near = met.mapInArrow(_near(percent), "k long, n long, part long, others array<struct<p: long, pn: long>>")
    once = near.groupBy("k", "n", "part").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    pairs = once.select("k", "n", F.inline("others"))
    first = F.col("k") < F.col("p")
    sides = (F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b"), F.when(first, F.col("n")).otherwise(F.col("pn")).alias("na"), F.when(first, F.col("pn")).otherwise(F.col("n")).alias("nb"))
    return pairs.select(*sides).distinct()


def link_classes(indexed: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(k, label) of the classes that link with another class."""
    classes = indexed.filter("map IS NOT NULL").select("k", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "n", "map").dropDuplicates(["k"])
    members = _signature_lists(indexed)
    classes = materialise(classes.join(members.select("k").distinct(), "k", "left_semi"), "classes")
    release(indexed)
    tidy(texts.sparkSession)
    verifier = Verifier(texts, classes, words, percent)
    labels = components(verifier.links(_first_pairs(members, percent)))
    # Long lists that still hold several components: pivots, more each round, against other components.
    every = members.filter(F.col("size") > LONG).select("sig", "k", "lead", "size")
    pivots = PIVOTS
    while True:
        named = every.join(labels, "k", "left").select("sig", "k", "lead", "size", F.coalesce("label", "k").alias("label"))
        every = materialise(named, "long-lists")
        open_lists = every.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("sig")
        left = materialise(every.join(open_lists, "sig", "left_semi"), "open-lists")
        release(every)
        if left.isEmpty():
            for table in (members, classes, *verifier.scratch):
                release(table)
            return labels
        found = verifier.links(_pivot_pairs(left.join(_of_keys(classes, left), "k"), pivots, percent), left.select("k").distinct())
        if not found.isEmpty():
            # What was linked before is told by the labels: one edge a class.
            labels = components(labels.select(F.col("k").alias("a"), F.col("label").alias("b")).union(found))
            tidy(texts.sparkSession)
        every = left.filter(F.col("size") > pivots).select("sig", "k", "lead", "size")
        pivots *= PIVOT_GROWTH


def _clustered(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, row_key, n, label and component of every row of `texts` (doc_id, text, row_key)."""
    shared = texts.sparkSession.sparkContext.broadcast(token_classes(texts.select("text"), words))
    schema = "doc_id long, row_key long, n long, k long, map array<long>, rare array<long>, leading array<long>, probing array<long>"
    indexed = materialise(texts.mapInArrow(_index(words, percent, shared), schema), "signatures")
    members = materialise(indexed.select("doc_id", "row_key", "n", "k"), "members")
    labels = link_classes(indexed, texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), words, percent)
    named = materialise(members.join(labels, "k", "left").select("doc_id", "row_key", "n", F.coalesce("label", "k").alias("label")), "labelled")
    release(members)
    release(labels)
    return named


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key"))


def cluster(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A-Z are lower-cased; a text of fewer than `words` words is one shingle; null and wordless
    texts have no shingles and are alone. component_id is the smallest doc_id reachable by links
    (null ids are left out, so it may be null); rows of equal text, repeated rows included, are
    linked. Empty input gives an empty result; extra columns are ignored. Sets are named by
    64-bit hashes.
    """
    named = _clustered(_texts(docs), words, percent)
    least = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component"))
    return named.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The input's rows and columns with one row, that of the smallest doc_id, of each component.

    Null ids come last; rows of one doc_id are told apart by their text, and rows equal in both
    stay or go together. Rows without shingles all stay. Empty input gives an empty result; extra
    columns, of any name, are carried along.
    """
    named = _clustered(_texts(docs), words, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    least = named.filter("label IS NOT NULL").groupBy("label").agg(F.min(rank).alias("first"))
    gone = named.join(least, "label").filter(~rank.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"))
    return packed.join(gone, (F.col("row_key") == F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")
