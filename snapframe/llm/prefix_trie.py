"""Prefix trie of conversations from the Cartesian tree over their LCP array.

A conversation is the byte string of its turns' codes (16 bytes of SHA-256 of role and text, and
the text's UTF-8 length), so sorting the strings sorts the conversations by turns. Equal
conversations become one row with a count. Rows are range-sorted into blocks; the LCP (common
turns with the row before) of each row is known within a block, and that of a block's first row
comes from the last row of the block before.

Nearest smaller values give each LCP value its interval of rows, a branching node of the trie.
Blocks are scanned in parallel with a stack. An interval that leaves its block finds the next
block with a smaller value from the blocks' minima, one number for each block, and there the
row from that block's staircase of smallest values, by a join. Boundaries of equal value in
one interval are one node. Every node's sums over its interval are differences of running sums.
A branching node or a row stands for the chain of nodes down to it from its parent, whose
depths are filled in at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapframe.llm.common import materialise

DIGEST_BYTES = 16
CODE_BYTES = DIGEST_BYTES + 8
SHARE_EVERY = 5
SHARE_MOST = 9
TURN_SPAN = 1024
ID_SPAN = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

# --------------------------------------------------------------------------- conversations


def turn_code(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 of (role, text), null being empty, and 8 of the text's length in bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return F.concat(F.substring(digest, 1, DIGEST_BYTES), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def positioned(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0, by turn with null first, then by code) and code of every turn.

    Places are counted in spans of turns, so that a long conversation is ordered by many tasks.
    """
    span = F.coalesce(F.floor(F.col("turn") / TURN_SPAN), F.lit(-(1 << 53))).alias("span")
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_code(F.col("role"), F.col("text")).alias("code"))
    turns = turns.select("*", span)
    sizes = turns.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("span")) - F.col("size")
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), before.alias("start"))
    own = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "code")) - 1
    placed = turns.withColumn("own", own).join(starts, (F.col("conv_id") == F.col("c")) & (F.col("span") == F.col("s")))
    return placed.select("conv_id", (F.col("start") + F.col("own")).alias("at"), "code")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Of positioned turns, conv_id and key (its turns' codes, joined) of every rebuilt conversation.

    Conversation c takes the first h turns of conversation c - c % 5, h = crc32(c) % 9, then its own
    after its first h. One without turns has an empty key.
    """
    taken = lambda c: F.crc32(c.cast("string").cast("binary")) % SHARE_MOST
    base = lambda c: c - c % SHARE_EVERY
    c = F.col("conv_id")
    own = turns.select("conv_id", "at", F.when((F.col("at") >= taken(c)) | (c == base(c)), F.col("code")).alias("code"))
    heads = turns.filter((F.col("at") < SHARE_MOST - 1) & (c == base(c))).select(c.alias("head"), F.col("at").alias("place"), F.col("code").alias("shared"))
    borrowers = turns.filter((F.col("at") == 0) & (c != base(c))).select("conv_id", base(c).alias("base"))
    lent = borrowers.join(heads, (F.col("base") == F.col("head")) & (F.col("place") < taken(c))).select("conv_id", F.col("place").alias("at"), F.col("shared").alias("code"))
    # A conversation's own first turns are null codes, which keep it in the result when nothing else does.
    pieces = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("at", F.hex("code").alias("code")))))
    joined = own.unionByName(lent).groupBy("conv_id").agg(pieces.alias("pieces"))
    return joined.select("conv_id", F.unhex(F.array_join(F.transform("pieces", lambda x: x["code"]), "")).alias("key"))


# --------------------------------------------------------------------------- sorted blocks


def _common(a: bytes, b: bytes) -> int:
    """Leading turns that two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // CODE_BYTES
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // CODE_BYTES


def _sizes(key: bytes) -> np.ndarray:
    """UTF-8 lengths of a key's turns."""
    return np.frombuffer(key, np.uint8).reshape(-1, CODE_BYTES)[:, DIGEST_BYTES:].copy().view(">i8").ravel().astype(np.int64)


_ROWS = "block long, at long, key binary, count long, least long, lcp long"


def _number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition becomes a block: its rows are numbered and meet the row before."""
    block, at, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        keys = batch.column("key").to_pylist()
        lcp = [-1 if before is None else _common(before, key) for before, key in zip([last, *keys[:-1]], keys, strict=True)]
        n = len(keys)
        columns = [pa.array([block] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), batch.column("key"), batch.column("count"), batch.column("least"), pa.array(lcp, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "at", "key", "count", "least", "lcp"])
        if n:
            at, last = at + n, keys[-1]


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block; rows come sorted by block and place."""
    out, current = [], None
    for batch in batches:
        for block, key, count, least, lcp in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "count", "least", "lcp")), strict=True):
            sizes = _sizes(key)
            if current is None or current["block"] != block:
                current = {"block": block, "rows": 0, "lowest": None, "convs": 0, "weight": 0, "fresh": 0, "leaves": 0, "least": least, "first": key}
                out.append(current)
            else:
                current["lowest"] = lcp if current["lowest"] is None else min(current["lowest"], lcp)
                current["leaves"] += len(current["last"]) // CODE_BYTES > lcp
            current["rows"] += 1
            current["convs"] += count
            current["weight"] += count * int(sizes.sum())
            current["fresh"] += int(sizes[max(lcp, 0) :].sum())
            current["least"] = min(current["least"], least)
            current["last"] = key
    kinds = {"block": pa.int64(), "rows": pa.int64(), "lowest": pa.int64(), "convs": pa.int64(), "weight": pa.int64(), "fresh": pa.int64(), "leaves": pa.int64(), "least": pa.int64(), "first": pa.binary(), "last": pa.binary()}
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in kinds.items()], list(kinds))


_SUMMARY = "block long, rows long, lowest long, convs long, weight long, fresh long, leaves long, least long, first binary, last binary"


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block's first row shares with the last row of the block before: turns and their bytes."""
    for batch in batches:
        pairs = list(zip(batch.column("first").to_pylist(), batch.column("before").to_pylist(), strict=True))
        shared = [-1 if before is None else _common(before, first) for first, before in pairs]
        sizes = [int(_sizes(first)[: max(n, 0)].sum()) for (first, _), n in zip(pairs, shared, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64()), pa.array([len(f) // CODE_BYTES for f, _ in pairs], pa.int64())], ["block", "seam", "seam_bytes", "depth"])


class Blocks(NamedTuple):
    """Arrays with one entry for each block, in order: all that a block must know of the others."""

    ids: list[int]
    start: np.ndarray  # its first row's place in the whole order
    seam: np.ndarray  # LCP of its first row
    lowest: np.ndarray  # least LCP, that of its first row included
    least: np.ndarray  # least conv_id
    sums: np.ndarray  # running sums before it: convs, weight, fresh, leaves
    total: np.ndarray
    first_depth: int  # turns of the first row of all


def _blocks(rows: DataFrame) -> Blocks:
    """From the written sorted rows; only numbers of each block reach the driver, keys meet in a join."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summary = materialise(rows.repartition(parts, "block").sortWithinPartitions("block", "at").mapInArrow(_summarise, _SUMMARY), "trie-blocks")
    found = {r["block"]: r for r in summary.drop("first", "last").collect()}
    order = sorted(found)
    after = rows.sparkSession.createDataFrame(list(zip(order[:-1], order[1:])), "earlier long, later long")
    ends = summary.select(F.col("block").alias("earlier"), F.col("last").alias("before")).join(after, "earlier").select("later", "before")
    seams = {r["block"]: r for r in summary.join(ends, F.col("block") == F.col("later"), "left").select("block", "first", "before").mapInArrow(_seams, "block long, seam long, seam_bytes long, depth long").collect()}
    lasts = {r["block"]: r["depth"] for r in summary.select("block", (F.octet_length("last") / CODE_BYTES).cast("long").alias("depth")).collect()}
    seam = [seams[b]["seam"] for b in order]
    sums = np.zeros((len(order) + 1, 4), np.int64)
    for i, b in enumerate(order):
        following = seam[i + 1] if i + 1 < len(order) else -1
        r = found[b]
        sums[i + 1] = sums[i] + [r["convs"], r["weight"], r["fresh"] - seams[b]["seam_bytes"], r["leaves"] + (lasts[b] > following)]
    start = np.concatenate([[0], np.cumsum([found[b]["rows"] for b in order])[:-1]])
    lowest = [s if found[b]["lowest"] is None else min(s, found[b]["lowest"]) for s, b in zip(seam, order, strict=True)]
    return Blocks(order, start, np.array(seam), np.array(lowest), np.array([found[b]["least"] for b in order]), sums[:-1], sums[-1], seams[order[0]]["depth"] if order else 0)


# --------------------------------------------------------------------------- nearest smaller values

# What a block finds, by kind:
# CHAIN: nodes from depth top + 1 to value, whole but for a parent whose interval leaves the block.
# CROSSING: an interval with an end in another block: there the first smaller value is looked up.
# LEFT and RIGHT: stairs, where other blocks find the block's last or first value below theirs.
CHAIN, CROSSING, LEFT, RIGHT = range(4)
_KINDS = {
    "kind": pa.int32(), "block": pa.int64(), "entry": pa.int64(), "value": pa.int64(), "top": pa.int64(), "boundaries": pa.int64(), "least": pa.int64(), "digest": pa.binary(), "depth": pa.int64(),
    "base": pa.int64(), "before": pa.list_(pa.int64()), "left": pa.struct([]), "right": pa.struct([]), "sums": pa.list_(pa.int64()), "row": pa.int64(),
    "parent_block": pa.int64(), "parent_entry": pa.int64(), "parent_least": pa.int64(), "left_block": pa.int64(), "right_block": pa.int64(),
}
_END = "struct<row long, value long, block long, entry long, sums array<long>, depth long, digest binary>"
_END_KIND = pa.struct([("row", pa.int64()), ("value", pa.int64()), ("block", pa.int64()), ("entry", pa.int64()), ("sums", pa.list_(pa.int64())), ("depth", pa.int64()), ("digest", pa.binary())])
_KINDS["left"] = _KINDS["right"] = _END_KIND
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", _END_KIND: _END}
_FOUND = ", ".join(f"{name} {_SQL[kind]}" for name, kind in _KINDS.items())


class Interval:
    """An interval being scanned: its value, first row (None: in an earlier block), boundaries of that value, least conv_id."""

    __slots__ = ("value", "left", "first", "last", "boundaries", "least", "children")

    def __init__(self, value: int, left: int | None, first: int, least: int):
        self.value, self.left, self.first, self.last = value, left, first, first
        self.boundaries, self.least, self.children = 1, least, []


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:DIGEST_BYTES]


class Scan:
    """One block's rows (key, count, least conv_id, LCP), from its first to its last."""

    def __init__(self, blocks: Blocks, b: int, rows: list[tuple[bytes, int, int, int]]):
        self.blocks, self.b, self.id, self.rows, self.found = blocks, b, blocks.ids[b], rows, []
        self.start = int(blocks.start[b])
        self.bytes = [np.concatenate([[0], np.cumsum(_sizes(key))]) for key, *_ in rows]  # of a row's first turns
        self.depth = [len(t) - 1 for t in self.bytes]
        self.lcp = [int(blocks.seam[b]), *(r[3] for r in rows[1:]), int(blocks.seam[b + 1]) if b + 1 < len(blocks.ids) else -1]
        own = [[c, c * int(t[-1]), int(t[-1] - t[max(v, 0)]), d > after] for (_, c, _, _), t, d, v, after in zip(rows, self.bytes, self.depth, self.lcp[:-1], self.lcp[1:], strict=True)]
        self.sums = blocks.sums[b] + np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(np.array(own, np.int64).reshape(-1, 4), axis=0)])

    def run(self) -> list[dict]:
        stack = [Interval(self.lcp[0], 0 if self.b == 0 else None, 0, self.rows[0][2])]
        n = len(self.rows)
        for i in range(n):
            v, low = self.lcp[i + 1], self.rows[i][2]
            stack[-1].least = min(stack[-1].least, low)
            leaf = self.leaf(i) if self.depth[i] > max(self.lcp[i], v) else None
            if leaf and self.lcp[i] >= v:
                stack[-1].children.append(leaf)
                leaf = None
            if i + 1 == n:
                if leaf:  # below the next block's first boundary
                    self.settle([leaf], self.blocks.ids[self.b + 1], 0)
                break
            left, waiting, cut = i, [leaf] if leaf else [], []
            while stack and stack[-1].value > v:
                closed = stack.pop()
                left, low = closed.left, min(low, closed.least)
                inside = bool(stack) and stack[-1].value >= v
                if inside:
                    stack[-1].least = min(stack[-1].least, closed.least)
                if closed.left is None:
                    cut.append(closed)
                else:
                    self.settle(closed.children, least=closed.least)
                    node = self.node(closed, i + 1)
                    (stack[-1].children if inside else waiting).append(node)
            if stack and stack[-1].value == v:
                stack[-1].boundaries += 1
                stack[-1].last = i + 1
                stack[-1].children += waiting
            else:
                stack.append(Interval(v, left, i + 1, low))
                stack[-1].children += waiting
            for closed in cut:
                self.crossing(closed, right=self.end(i + 1, stack[-1].first))
        self.stairs(stack)
        while stack:
            opened = stack.pop()
            if stack:
                stack[-1].least = min(stack[-1].least, opened.least)
            below = stack[-1].first if stack else -1
            self.crossing(opened, left=None if opened.left is None else self.end(opened.left, below))
        return self.found

    def end(self, row: int, entry: int) -> dict:
        """What a neighbouring interval needs to know of the boundary before `row`."""
        own = {"depth": self.depth[row], "digest": _digest(self.rows[row][0])} if row < len(self.rows) else {}
        return {"row": self.start + row, "value": self.lcp[row], "block": self.id, "entry": entry, "sums": self.sums[row].tolist(), **own}

    def settle(self, children: list[dict], block: int | None = None, entry: int | None = None, least: int | None = None) -> None:
        """Chains learn the least conv_id of the node above, or where it will be known."""
        self.found += [c | {"parent_block": block, "parent_entry": entry, "parent_least": least} for c in children]

    def leaf(self, i: int) -> dict:
        key, count, least, _ = self.rows[i]
        return self.chain(i, self.depth[i], i, i + 1) | {"boundaries": 0, "least": least, "digest": _digest(key)}

    def node(self, closed: Interval, right: int) -> dict:
        own = self.depth[closed.left] == closed.value
        chain = self.chain(closed.left, closed.value, closed.left, right)
        return chain | {"boundaries": closed.boundaries, "least": closed.least, "digest": _digest(self.rows[closed.left][0]) if own else None}

    def chain(self, row: int, value: int, left: int, right: int) -> dict:
        top = max(self.lcp[left], self.lcp[right])
        return {
            "kind": CHAIN, "value": value, "top": top, "base": int(self.bytes[row][max(self.lcp[left], 0)]), "before": self.before(row, top, value), "sums": (self.sums[right] - self.sums[left]).tolist(),
        }

    def before(self, row: int, top: int, value: int) -> list[int]:
        """Bytes of the turns above the last one of each node from depth top + 1 to `value`."""
        return self.bytes[row][np.maximum(np.arange(top, value), 0)].tolist()

    def crossing(self, interval: Interval, left: dict | None = None, right: dict | None = None) -> None:
        v, lowest, least = interval.value, self.blocks.lowest, self.blocks.least
        self.settle(interval.children, self.id, interval.first)
        if v < 0:
            return
        low, left_block, right_block = interval.least, None, None
        if left is None:
            at = 0 if v == 0 else int(np.flatnonzero(lowest[: self.b] < v)[-1])
            low = min([low, *least[at + (v > 0) : self.b].tolist()])
            if v == 0:  # the root begins with the first row
                left = {"row": 0, "value": -1, "block": self.blocks.ids[0], "entry": -1, "sums": [0] * 4, "depth": self.blocks.first_depth, "digest": _digest(b"")}
            else:
                left_block = self.blocks.ids[at]
        if right is None:
            later = np.flatnonzero(lowest[self.b + 1 :] < v)
            at = self.b + 1 + int(later[0]) if len(later) else len(lowest)
            low = min([low, *least[self.b + 1 : at].tolist()])
            if len(later):
                right_block = self.blocks.ids[at]
            else:
                right = {"row": -1, "value": -1, "block": -1, "entry": -1, "sums": self.blocks.total.tolist()}
        self.found.append({
            "kind": CROSSING, "block": self.id, "entry": interval.first, "value": v, "boundaries": interval.boundaries, "least": low, "before": self.before(interval.first, -1, v),
            "left": left, "right": right, "left_block": left_block, "right_block": right_block,
        })

    def stairs(self, stack: list[Interval]) -> None:
        least = np.array([r[2] for r in self.rows])
        upto, after = np.minimum.accumulate(least), np.minimum.accumulate(least[::-1])[::-1]
        for x in stack:
            self.found.append({"kind": LEFT, "block": self.id, "value": x.value, "row": self.start + x.last, "least": int(after[x.last]), "left": self.end(x.last, x.first)})
        low = None
        for i, v in enumerate(self.lcp[:-1]):
            if low is None or v < low:
                low = v
                self.found.append({"kind": RIGHT, "block": self.id, "value": v, "row": self.start + i, "least": int(upto[i - 1]) if i else None, "right": self.end(i, i)})


def _scan(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = broadcast.value
        number = {b: i for i, b in enumerate(blocks.ids)}
        current, held = None, []
        for batch in batches:
            for block, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "count", "least", "lcp")), strict=True):
                if block != current and held:
                    yield from _as_batches(Scan(blocks, number[current], held).run())
                    held = []
                current = block
                held.append(tuple(row))
        if held:
            yield from _as_batches(Scan(blocks, number[current], held).run())

    return run


def _as_batches(found: list[dict], step: int = 10_000) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(found), step):
        part = found[first : first + step]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in part], kind) for k, kind in _KINDS.items()], list(_KINDS))


# --------------------------------------------------------------------------- nodes


def _resolved(found: DataFrame) -> DataFrame:
    """Crossing intervals with both ends, by the stairs of the blocks that the minima named."""
    crossing = found.filter(F.col("kind") == CROSSING).select("block", "entry", "value", "boundaries", "least", "before", "left", "right", "left_block", "right_block")
    for side, kind, nearest in (("left", LEFT, F.max_by), ("right", RIGHT, F.min_by)):
        stairs = found.filter(F.col("kind") == kind).select(F.col("block").alias("at"), F.col("value").alias("step"), "row", F.struct(side, "least").alias("stair"))
        asked = crossing.filter(F.col(f"{side}_block").isNotNull()).select("block", "entry", "value", f"{side}_block")
        met = asked.join(stairs, (F.col(f"{side}_block") == F.col("at")) & (F.col("step") < F.col("value")))
        ends = met.groupBy("block", "entry").agg(nearest("stair", "row").alias("stair"))
        crossing = crossing.join(ends, ["block", "entry"], "left").withColumns({side: F.coalesce(side, f"stair.{side}"), "least": F.least("least", "stair.least")}).drop("stair")
    top = F.greatest("left.value", "right.value")
    own = F.col("left.depth") == F.col("value")
    above = F.when(F.col("left.value") >= F.col("right.value"), F.struct("left.block", "left.entry")).otherwise(F.struct("right.block", "right.entry"))
    return crossing.select(
        "block", "entry", "value", top.alias("top"), "boundaries", "least", F.when(own, F.col("left.digest")).alias("digest"), F.col("left.row").alias("row"), above.alias("above"),
        F.when(F.col("left.value") < 0, F.lit(0)).otherwise(F.get("before", F.col("left.value").cast("int") + 1)).cast("long").alias("base"),
        F.expr("slice(before, CAST(greatest(left.value, right.value) + 2 AS INT), CAST(value - greatest(left.value, right.value) AS INT))").alias("before"),
        F.zip_with("right.sums", "left.sums", lambda a, b: a - b).alias("sums"),
    )


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each digest's ids; the pieces of a list come in order, however many there are."""
    current, running, out = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if digest != current:
                if current is not None:
                    out.append((current, running.hexdigest()))
                current, running = digest, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield _ends(out)
            out = []
    if current is not None:
        out.append((current, running.hexdigest()))
    yield _ends(out)


def _ends(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["end", "ends_sha256"])


def id_hashes(keyed: DataFrame) -> DataFrame:
    """end (a key's digest) and the SHA-256 of the ids of its conversations; long lists are joined in spans of ids and hashed as a stream."""
    digest = F.substring(F.unhex(F.sha2("key", 256)), 1, DIGEST_BYTES)
    spans = keyed.select(digest.alias("digest"), F.floor(F.col("conv_id") / ID_SPAN).alias("span"), "conv_id").groupBy("digest", "span")
    pieces = spans.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "digest").sortWithinPartitions("digest", "span").mapInArrow(_hash_ids, "end binary, ends_sha256 string")


def build_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `conversations` has conv_id, turn, role and text. Null roles and texts count as empty, a null turn
    comes first, and turns of one number are ordered by the digest of role and text; rows repeated
    whole are turns like any others. Rows without conv_id belong to no conversation. A
    conversation of which nothing is left ends at the root. Empty input gives an empty result;
    extra columns are ignored. A conversation's codes (24 bytes a turn) must fit in a row.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = materialise(rebuilt(positioned(conversations)), "trie-keys")
    distinct = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("conv_id").alias("least"))
    rows = materialise(distinct.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(_number_rows, _ROWS), "trie-rows")
    blocks = spark.sparkContext.broadcast(_blocks(rows))
    found = materialise(rows.repartition(parts, "block").sortWithinPartitions("block", "at").mapInArrow(_scan(blocks), _FOUND), "trie-found")
    resolved = materialise(_resolved(found), "trie-crossing")
    above = resolved.select(F.col("block").alias("parent_block"), F.col("entry").alias("parent_entry"), F.col("least").alias("least_above"))
    # Boundaries of one value in one interval, from however many blocks, are one node.
    merged = resolved.groupBy("row", "value").agg(F.sum("boundaries").alias("boundaries"), *(F.first(c).alias(c) for c in ("top", "least", "digest", "base", "before", "sums", "above")))
    columns = ["value", "top", "boundaries", "least", "digest", "base", "before", "sums", "parent_block", "parent_entry", "parent_least"]
    crossing = merged.select("*", F.col("above.block").alias("parent_block"), F.col("above.entry").alias("parent_entry"), F.lit(None).cast("long").alias("parent_least"))
    chains = found.filter(F.col("kind") == CHAIN).select(*columns).unionByName(crossing.select(*columns))
    chains = chains.join(above, ["parent_block", "parent_entry"], "left").withColumn("parent", F.coalesce("parent_least", "least_above"))
    chains = chains.join(id_hashes(keyed), F.col("digest") == F.col("end"), "left")
    nodes = chains.select("*", F.posexplode("before").alias("step", "bytes")).withColumn("depth", F.col("top") + 1 + F.col("step"))
    last = F.col("depth") == F.col("value")
    sums = lambda i: F.get("sums", F.lit(i))  # noqa: E731  conversations, their bytes, bytes of new turns, leaves
    return nodes.select(
        F.col("least").alias("conv_id"),
        F.col("depth").cast("long"),
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("step") == 0, F.col("parent")).otherwise(F.col("least")).cast("long").alias("parent_conv_id"),
        sums(0).alias("n_convs"),
        F.when(last, F.col("boundaries") + F.when(F.col("digest").isNull(), 1).otherwise(0)).otherwise(1).cast("long").alias("n_children"),
        sums(3).alias("n_leaves"),
        (sums(1) - sums(2) - F.col("base") - (sums(0) - 1) * F.col("bytes")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
