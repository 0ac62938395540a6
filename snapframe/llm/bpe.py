"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text picks cut points that depend on nearby content only, so
texts that share passages share chunks. A chunk is encoded by itself once per task, as long as a
bounded store holds it; later documents reuse its ids. A cut may fall anywhere, so the ids around
it are repaired: the last pre-tokens of the left chunk and the first of the right one are encoded
again as one span, which grows until its first pre-token is exactly that of the left chunk and its
last one exactly that of the right chunk, in ids and place. Pre-tokens are found by scanning
forward and are encoded one by one, so where two scans stand at one place they go on alike; the
ids before and after the span are therefore those of the whole text. Added tokens are matched in
the raw text before that, so no cut is made inside one. Chunks whose spans do not agree within
REACH pre-tokens, or overlap, are joined and encoded as one.

This holds for any tokenizer whose pre-tokenizer scans forward, with white space in its tokens or
without. Where the pre-tokenizer drops white space, and the normalizer does not look across it, a
cut is moved on to the next white space of its text and needs no repair: a new chunk's ids are
those of its words, of which each that a bounded store does not hold is encoded by the library,
all of a block in one call. Whole texts are encoded, and each document's ids are exactly those of the library.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapframe.llm.common import _IS_BREAK, _byte_values, _power_tables, blocks, mix64

WINDOW_BYTES = 16
CHUNK_BITS = 10
LEAST_CHUNK = 128
STORE_BYTES = 24 << 20
TOKENIZER_BYTES = 32 << 20
FIRST_REACH = 2
REACH = 4
WORDS_HELD = 200_000
LONGEST_HELD = 64  # bytes of a word that is held
# The pattern by which the word tokenizer cuts texts, a fixed value of its format: no match holds white space.
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Chunk(NamedTuple):
    """A chunk's text and ids; ends of its first pre-tokens and starts of its last ones, nearest to the cut first.

    Both hold (token, character) places: tokens before an end, tokens before a start.
    """

    text: str
    ids: array
    ends: list[tuple[int, int]]
    starts: list[tuple[int, int]]


class ChunkStore:
    """Chunk bytes to encoded chunks, least recently used first out, within a byte budget."""

    def __init__(self, budget: int = STORE_BYTES):
        self.chunks: OrderedDict[bytes, Chunk] = OrderedDict()
        self.budget, self.held, self.hits, self.misses = budget, 0, 0, 0

    def get(self, raw: bytes) -> Chunk | None:
        found = self.chunks.get(raw)
        if found is None:
            self.misses += 1
        else:
            self.hits += 1
            self.chunks.move_to_end(raw)
        return found

    def rest(self) -> None:
        """Idle workers hold no chunks: a worker may wait long for its next task, beside others."""
        self.chunks.clear()
        self.held = 0

    @staticmethod
    def _size(raw: bytes, chunk: Chunk) -> int:
        return 6 * len(raw) + 4 * len(chunk.ids) + 130 * (len(chunk.ends) + len(chunk.starts)) + 600

    def put(self, raw: bytes, chunk: Chunk) -> None:
        if raw in self.chunks:
            return
        self.chunks[raw] = chunk
        self.held += self._size(raw, chunk)
        while self.held > self.budget:
            self.held -= self._size(*self.chunks.popitem(last=False))


def encode_chunk(text: str, encoding) -> Chunk:
    """A chunk from what the library made of its text."""
    ids, word = array("I", encoding.ids), encoding.token_to_word
    n, ends, starts = len(ids), [], []
    at = 0
    while at < n and len(ends) < REACH:
        at += 1
        if at == n or word(at) != word(at - 1):
            ends.append((at, encoding.token_to_chars(at - 1)[1]))
    at = n
    while at > 0 and len(starts) < REACH:
        at -= 1
        if at == 0 or word(at) != word(at - 1):
            starts.append((at, encoding.token_to_chars(at)[0]))
    return Chunk(text, ids, ends, starts)


def cut_points(data: np.ndarray, offsets: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Positions of a block after which a chunk ends: after windows of bytes whose hash ends in zeros, between characters."""
    n = len(data)
    if n < WINDOW_BYTES:
        return np.zeros(0, np.int64)
    power, inverse = _power_tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_values[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[WINDOW_BYTES:] - sums[:-WINDOW_BYTES]) * inverse[: n - WINDOW_BYTES + 1])
    cuts = np.flatnonzero(hashes & np.uint64((1 << bits) - 1) == 0) + WINDOW_BYTES
    row = np.searchsorted(offsets, cuts, "left") - 1
    cuts = cuts[cuts - WINDOW_BYTES >= offsets[row]]
    return cuts[(cuts == n) | ((data[np.minimum(cuts, n - 1)] & 0xC0) != 0x80)]


def _spread(start: int, end: int, cuts: np.ndarray) -> list[int]:
    """Chunk bounds of the text at [start, end): chunks hold LEAST_CHUNK bytes or more, but for the last."""
    bounds = [start]
    for cut in cuts.tolist():
        if cut - bounds[-1] >= LEAST_CHUNK and cut < end:
            bounds.append(cut)
    return [*bounds, end]


def _outside(cuts: np.ndarray, raw: bytes, tokens: list[bytes]) -> np.ndarray:
    """The cuts that fall into no added token's text: such a text is one token wherever it stands."""
    for token in tokens:
        at, places = raw.find(token), []
        while at >= 0:
            places.append(at)
            at = raw.find(token, at + 1)
        if places:
            before = np.array([-len(raw), *places])
            inside = cuts - before[np.searchsorted(before, cuts, "left") - 1]
            cuts = cuts[inside >= len(token)]
    return cuts


class Join:
    """The span about the cut between two neighbouring chunks, being repaired."""

    def __init__(self, left: Chunk, right: Chunk):
        self.left, self.right, self.reach, self.ids = left, right, 0, None  # without ids in the end: the chunks must be joined

    def widen(self) -> str | None:
        """Text of the next span to try, or None if there is none."""
        longest = max(len(self.left.starts), len(self.right.ends))
        if self.reach >= min(REACH, longest) or not self.left.starts or not self.right.ends:
            return None
        self.reach = min(REACH, 2 * self.reach or FIRST_REACH)
        (self.first, a), (self.last, b) = self.left.starts[: self.reach][-1], self.right.ends[: self.reach][-1]
        return self.left.text[a:] + self.right.text[:b]

    def agrees(self, encoding) -> bool:
        """Whether the span's first pre-token is the left chunk's and its last one the right chunk's."""
        words, ids = encoding.word_ids, encoding.ids
        n = len(ids)
        if not n or words[0] == words[-1]:
            return False
        one = next(i for i in range(n) if words[i] != words[0])
        two = next(i for i in range(n - 1, -1, -1) if words[i] != words[-1]) + 1
        (_, a), (_, b) = self.left.starts[: self.reach][-1], self.right.ends[: self.reach][-1]
        shift = len(self.left.text) - a  # where the right chunk begins in the span
        ends, starts = self.left.starts[: self.reach], self.right.ends[: self.reach]
        if len(ends) < 2 or len(starts) < 2:
            return False
        own, other = ends[-2], starts[-2]  # the next pre-token of the left chunk, the one before of the right chunk
        left_ids, right_ids = self.left.ids[self.first : own[0]].tolist(), self.right.ids[other[0] : self.last].tolist()
        same_left = ids[:one] == left_ids and encoding.token_to_chars(one - 1)[1] + a <= own[1]
        same_right = ids[two:] == right_ids and encoding.token_to_chars(two)[0] - shift >= other[1] and encoding.token_to_chars(n - 1)[1] - shift == b
        return same_left and same_right


def _encode(tokenizer, texts: list[str]) -> list:
    return tokenizer.encode_batch(texts, add_special_tokens=False) if texts else []


def _repair(tokenizer, joins: list[Join]) -> None:
    waiting = joins
    while waiting:
        spans = [(j, text) for j in waiting if (text := j.widen()) is not None]
        waiting = []
        for (join, _), encoding in zip(spans, _encode(tokenizer, [t for _, t in spans]), strict=True):
            if join.agrees(encoding):
                join.ids = array("I", encoding.ids)
            else:
                waiting.append(join)


def encode_block(data: np.ndarray, offsets: np.ndarray, tokenizer, store: ChunkStore) -> list[list[int]]:
    """Token ids of each text of a block."""
    raw = data.tobytes()
    cuts = _outside(cut_points(data, offsets), raw, [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()])
    texts: list[list[bytes]] = []
    known: dict[bytes, Chunk] = {}
    fresh: dict[bytes, str] = {}
    for r in range(len(offsets) - 1):
        start, end = int(offsets[r]), int(offsets[r + 1])
        bounds = _spread(start, end, cuts[np.searchsorted(cuts, start, "right") : np.searchsorted(cuts, end, "left")])
        parts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
        for part in parts:
            if part not in known and part not in fresh:
                if (held := store.get(part)) is not None:
                    known[part] = held
                else:
                    fresh[part] = part.decode()
            else:
                store.hits += 1
        texts.append(parts)
    for (part, text), encoding in zip(fresh.items(), _encode(tokenizer, list(fresh.values())), strict=True):
        known[part] = encode_chunk(text, encoding)
        if len(part) >= LEAST_CHUNK:
            store.put(part, known[part])
    pairs = {(a, b) for parts in texts for a, b in zip(parts[:-1], parts[1:], strict=True)}
    joins = {(a, b): Join(known[a], known[b]) for a, b in pairs}
    _repair(tokenizer, list(joins.values()))
    return [_assemble(parts, known, joins, tokenizer) for parts in texts]


def _assemble(parts: list[bytes], known: dict[bytes, Chunk], joins: dict[tuple[bytes, bytes], Join], tokenizer) -> list[int]:
    """One text's ids: runs of chunks that could not be told apart are encoded whole, joins between others are put in."""
    groups: list[list[bytes]] = []
    for i, part in enumerate(parts):
        if i and (joins[parts[i - 1], part].ids is None or _overlap(parts, i, joins)):
            groups[-1].append(part)
        else:
            groups.append([part])
    if len(groups) == len(parts):
        return _linked(parts, known, joins)
    # Chunks joined to larger ones meet their neighbours anew.
    whole = [b"".join(g) for g in groups]
    larger = {w: known[w] if w in known else encode_chunk(w.decode(), _encode(tokenizer, [w.decode()])[0]) for w in whole}
    again = {(a, b): Join(larger[a], larger[b]) for a, b in zip(whole[:-1], whole[1:], strict=True)}
    _repair(tokenizer, list(again.values()))
    if len(whole) == 1:
        return larger[whole[0]].ids.tolist()
    return _assemble(whole, larger, again, tokenizer)


def _overlap(parts: list[bytes], i: int, joins: dict[tuple[bytes, bytes], Join]) -> bool:
    """Whether the spans at both ends of chunk i - 1 meet."""
    if i < 2 or (before := joins[parts[i - 2], parts[i - 1]]).ids is None:
        return False
    return before.last > joins[parts[i - 1], parts[i]].first


def _linked(parts: list[bytes], known: dict[bytes, Chunk], joins: dict[tuple[bytes, bytes], Join]) -> list[int]:
    ids, begin = array("I"), 0
    for i, part in enumerate(parts):
        join = joins[part, parts[i + 1]] if i + 1 < len(parts) else None
        ids.extend(known[part].ids[begin : join.first if join else None])
        if join:
            ids.extend(join.ids)
            begin = join.last
    return ids.tolist()


def drops_space(spec: str) -> bool:
    """Whether the file's tokenizer encodes a text's words between ASCII white space each by itself."""
    held = json.loads(spec)
    flat = lambda part, inner: part[inner] if part and part["type"] == "Sequence" else [part] if part else []
    plain = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
    split = {"type": "Split", "pattern": {"Regex": WORD_LEVEL}, "behavior": "Removed", "invert": True}
    first, *later = flat(held.get("pre_tokenizer"), "pretokenizers") or [None]
    steps = all(x["type"] == "ByteLevel" and not x.get("add_prefix_space", True) and not x.get("use_regex", True) for x in later)
    added = all(not any(t.get(k) for k in ("normalized", "lstrip", "rstrip", "single_word")) and not any(c.isspace() for c in t["content"]) for t in held.get("added_tokens", []))
    return held["model"].get("type") == "BPE" and not held["model"].get("dropout") and first == split and steps and added and all(x in plain for x in flat(held.get("normalizer"), "normalizers"))


class WordStore:
    """Ids, as native unsigned ints in bytes, of words; two generations bound what is held."""

    def __init__(self, tokenizer, held: int = WORDS_HELD):
        self.tokenizer, self.held = tokenizer, held
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, chunks: list[bytes]) -> list[array]:
        """Ids of each chunk; chunks begin and end at white space."""
        words = [chunk.split() for chunk in chunks]  # bytes are split at ASCII white space only
        if len(self.ids) >= self.held:
            self.old, self.ids = self.ids, {}
        unknown = []
        for word in set().union(*words) - self.ids.keys():
            if (ids := self.old.get(word)) is None:
                unknown.append(word)
            else:
                self.ids[word] = ids
        if unknown:
            found = self.tokenizer.encode([w.decode() for w in unknown], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "I")
            ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(unknown)), "right").tolist()
            for word, start, end in zip(unknown, [0, *ends[:-1]], ends, strict=True):
                self.ids[word] = ids[start:end].tobytes()
        out = [array("I", b"".join(map(self.ids.__getitem__, own))) for own in words]
        for word in unknown:
            if len(word) > LONGEST_HELD:
                del self.ids[word]
        return out


def _to_space(cuts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each cut moved to the next white space of its row; cuts that no white space follows are left out."""
    spaces = np.append(np.flatnonzero(_IS_BREAK[data]), len(data))
    moved = spaces[np.searchsorted(spaces, cuts, "left")]
    end = offsets[np.searchsorted(offsets, cuts, "left")]
    return np.unique(moved[moved < end])


def encode_spaced(data: np.ndarray, offsets: np.ndarray, words: WordStore, store: ChunkStore) -> list[list[int]]:
    """As encode_block(), for tokenizers that drop white space (`drops_space`)."""
    raw = data.tobytes()
    cuts = _to_space(cut_points(data, offsets), data, offsets)
    texts: list[list[bytes]] = []
    known: dict[bytes, array] = {}
    fresh: dict[bytes, None] = {}
    for r in range(len(offsets) - 1):
        start, end = int(offsets[r]), int(offsets[r + 1])
        bounds = _spread(start, end, cuts[np.searchsorted(cuts, start, "right") : np.searchsorted(cuts, end, "left")])
        parts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
        for part in parts:
            if part in known or part in fresh:
                store.hits += 1
            elif (held := store.get(part)) is not None:
                known[part] = held.ids
            else:
                fresh[part] = None
        texts.append(parts)
    for part, ids in zip(fresh, words.encode(list(fresh)), strict=True):
        known[part] = ids
        if len(part) >= LEAST_CHUNK:
            store.put(part, Chunk("", ids, [], []))
    return [[i for part in parts for i in known[part]] for parts in texts]


_loaded: dict[str, tuple] = {}


def _worker(spec: str):
    """This worker's encoder of blocks, decoder of ids, decimal names of the ids and chunk store."""
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(without_trimming(spec))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        size, store = tokenizer.get_vocab_size(), ChunkStore()
        words = WordStore(tokenizer) if drops_space(spec) else None
        encode = lambda data, offsets: encode_spaced(data, offsets, words, store) if words else encode_block(data, offsets, tokenizer, store)
        # Without a decoder the library joins the tokens by spaces.
        tokens = [tokenizer.id_to_token(i) for i in range(size)] if tokenizer.decoder is None else []
        plain = bool(tokens) and None not in tokens
        decode = lambda ids: " ".join([tokens[i] for i in ids]) if plain else tokenizer.decode(ids, skip_special_tokens=False)
        _loaded[name] = encode, decode, [str(i) for i in range(size)], store
    return _loaded[name]


def without_trimming(spec: str) -> str:
    """The tokenizer without post-processor, which adds no ids here but may move the places of tokens."""
    return json.dumps(json.loads(spec) | {"post_processor": None})


def read_tokenizer(path: str) -> str:
    """A tokenizer file's text, which is broadcast; its size is checked."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > TOKENIZER_BYTES:
        raise ValueError(f"{path}: a tokenizer of {len(spec)} characters is too large to broadcast")
    return spec


def _coder(broadcast, digests: bool, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode, names, store = _worker(broadcast.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for first, data, offsets in blocks(batch.column(at)):
                ids = encode(data, offsets)
                kept = [c.slice(first, len(ids)) for i, c in enumerate(batch.columns) if i != at]
                counts = pa.array([len(x) for x in ids], pa.int64())
                texts = [decode(x) for x in ids]
                more = {}
                if digests:
                    more["ids_sha256"] = pa.array([hashlib.sha256(" ".join([names[i] for i in x]).encode()).hexdigest() for x in ids], pa.string())
                    more["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
                else:
                    more["decoded"] = pa.array(texts, pa.string())
                if with_ids:
                    more["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept, counts, *more.values()], [*(f.name for i, f in enumerate(batch.schema) if i != at), "n_tokens", *more])
        store.rest()

    return run


def _coded(docs: DataFrame, tokenizer_path: str, digests: bool, carry: tuple[str, ...], with_ids: bool, added: str) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    schema = T.StructType([*(f for f in read.schema.fields if f.name != "text"), *T._parse_datatype_string(added).fields])
    return read.mapInArrow(_coder(spec, digests, with_ids), schema)


def encode(docs: DataFrame, tokenizer_path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the columns of `carry`, n_tokens, decoded, ids.

    Null and empty texts have no tokens and decode to ''. Rows are coded one by one, so repeated
    rows give equal results and empty input gives an empty result; other columns are ignored.
    """
    return _coded(docs, tokenizer_path, False, carry, True, "n_tokens long, decoded string, ids array<int>")


def encode_digests(docs: DataFrame, tokenizer_path: str, carry: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """As encode(), with SHA-256 digests of ids and decoded text: doc_id, ..., n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""
    return _coded(docs, tokenizer_path, True, carry, with_ids, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
