"""Packing against the library's ids, plain cutting and a plain best fit."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from snapframe.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_word_encoder_equals_the_library(library, documents):
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", " ", "　", "漢", "1", "٣", "<|endoftext|>", "<", "--", "_", " a", "the", "THE", "\r\n", "́", "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += [ch * k for ch in "ab -=*.0é_\n\t" for k in range(1, 60)]
    texts += [r.text or "" for r in documents.limit(60).collect()]
    encode = packing.WordEncoder(open(PATH).read())
    assert encode.by_rank is not None
    encode.later.held = 100  # generations change often
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_go_whole_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, other = packing.WordEncoder(open(path).read()), Tokenizer.from_file(path)
    assert encode.by_rank is None
    for text in ("", "Hello  world", "a\nb"):
        assert np.frombuffer(encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def best_fit(histogram, capacity):
    """Sequences of a best-fit-decreasing packing."""
    bins = []
    for size in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] + size <= capacity]
        if fits:
            bins[max(fits, key=lambda b: bins[b])] += size
        else:
            bins.append(size)
    return len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_and_is_near_the_least(seed):
    rng = random.Random(seed)
    low, high = ((1, 1024), (100, 700), (1, 60), (600, 1024))[seed]
    histogram = {rng.randint(low, high): rng.randint(1, 9) for _ in range(80)}
    used = packing.plan(histogram)
    held = {}
    for config, times in used:
        assert times > 0 and sum(n * c for n, c in config.items()) <= 1024
        for n, c in config.items():
            held[n] = held.get(n, 0) + c * times
    assert held == histogram
    total = sum(times for _, times in used)
    assert packing.least_sequences(histogram) <= total <= best_fit(histogram, 1024) * 1.01 + 1  # mostly fewer


def test_plan_does_not_grow_with_the_counts():
    histogram = {n: 10**9 + n for n in range(1, 1025, 7)}
    used = packing.plan(histogram)
    total = sum(t for _, t in used)
    assert len(used) < 3000 and total <= packing.least_sequences(histogram) * 1.0001


def check(found, docs, library, capacity=1024, end_id=2):
    """Every document's pieces are its tokens, and sequences are gapless."""
    want = []
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        head = (len(ids) - 1) % capacity + 1
        bounds = [0, *range(head, len(ids) + 1, capacity)]
        want += [(doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=key) == sorted(want, key=key)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query_packs_the_whole_table(spark, sf_dir, documents, library):
    found = queries.op12_best_fit_packing(spark, sf_dir)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    found = found.collect()
    used = check(found, [(r.doc_id, r.text) for r in documents.collect()], library)
    histogram = {}
    for r in found:
        histogram[r.length] = histogram.get(r.length, 0) + 1
    assert used <= max(packing.least_sequences(histogram) * 1.01, packing.least_sequences(histogram) + 1)


def test_odd_rows_and_ids(make_docs, library):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (None, "a b"), (None, "a b"), (4, "x <|endoftext|> y")] + [(100 + i, "same text here") for i in range(50)]
    found = packing.pack(make_docs(*rows), PATH, capacity=64, with_ids=True).collect()
    check(found, rows, library, capacity=64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found)
    assert packing.pack(make_docs((1, "a")).limit(0), PATH).count() == 0
