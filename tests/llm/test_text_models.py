import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from snapframe.llm import bpe, language_id, toxicity
from snapframe.llm.common import blocks

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGE = [
    None,
    "",
    " ",
    "a",
    "Ends in space ",
    "no_white_space_" * 3000,
    "é café ́x    y",
    "<|startoftext|>glued<|endoftext|> and <|endoftext|> apart",
    "it's we'll 123 45,6 漢字かな 🙂🙂 ΑΣ ΑΣ. İI",
    "tabs\tand\nlines\r\n\x0b\x0c end",
    "word " * 20_000,
    "xy" * 50_000,
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(make_docs, documents, name):
    path = public_tokenizers.path(name)
    rows = [(i, t) for i, t in enumerate(EDGE)] + [(None, "x y"), (3, "a")]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    texts = [t for _, t in rows] + [r.text for r in documents.collect()]
    docs = make_docs(*rows).select("doc_id", "text").union(documents.select("doc_id", "text"))
    want = []
    for t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = bpe.encode_digests(docs, path, with_ids=True).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(want)
    assert all(r.n_tokens == len(r.ids) for r in found)
    assert bpe.encode_digests(docs.limit(0), path).count() == 0
    whole = bpe.encode(make_docs((1, "A b")), path, carry=("lang",)).first()
    assert whole.ids == tokenizer.encode("A b", add_special_tokens=False).ids and whole.lang == "en"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_joins_are_exact_wherever_cuts_fall(monkeypatch, name):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "LEAST_CHUNK", 1)
    monkeypatch.setattr(bpe, "CHUNK_BITS", 4)
    monkeypatch.setattr(bpe.cut_points, "__defaults__", (3,))
    spec = bpe.read_tokenizer(public_tokenizers.path(name))
    plain, tokenizer = Tokenizer.from_str(spec), Tokenizer.from_str(bpe.without_trimming(spec))
    plain.no_truncation()
    tokenizer.no_truncation()
    rng = np.random.default_rng(4)
    bits = ["<|endoftext|>", "<|startoftext|>", "it's", "'", "  ", "\n\n ", "\t", "123", "abc", "É", "e\u0301", "\u0301", "漢字", "🙂", "!!<|", "|>", ".", "don't", " the", "ing", " x", "ΑΣ", "_-_", "\u00a0", "\r\n"]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 60)))) for _ in range(600)]
    store = bpe.ChunkStore()
    for _, data, offsets in blocks(pa.array(texts), 4000):
        raw = data.tobytes()
        own = [raw[a:b].decode() for a, b in itertools.pairwise(offsets.tolist())]
        for text, ids in zip(own, bpe.encode_block(data, offsets, tokenizer, store), strict=True):
            assert ids == plain.encode(text, add_special_tokens=False).ids, text


def test_chunks_are_reused_and_bounded():
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, 6, dtype=np.uint8)).decode() for _ in range(3000)]
    base = " ".join(words)
    column = pa.array(["intro " + base, base + " outro", "some other start " + base])
    store = bpe.ChunkStore()
    for _, data, offsets in blocks(column, 1):
        for ids, text in zip(bpe.encode_block(data, offsets, tokenizer, store), [data.tobytes().decode()], strict=True):
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert store.hits > store.misses
    small = bpe.ChunkStore(budget=2000)
    for i in range(50):
        small.put(b"%d" % i, bpe.encode_chunk("abcd", tokenizer.encode("abcd")))
    assert small.held <= 2000


def test_words_are_encoded_once_and_chunks_end_at_white_space(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "LEAST_CHUNK", 1)
    monkeypatch.setattr(bpe.cut_points, "__defaults__", (4,))
    spec = bpe.read_tokenizer(PATH)
    assert bpe.drops_space(spec) and not bpe.drops_space(bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    rng = np.random.default_rng(4)
    bits = ["<|endoftext|>", "<|startoftext|>", "it's", "'", "s", "  ", "\n\n ", "\t", "\x0b", "\x0c", "\x1c", "\x85", "123", "abc", "É", "e\u0301", "\u0301", "漢字", "🙂", "!!<|", "|>", "don't", " the", " x", "ΑΣ", "İ", "\u00a0", "\u3000", "\r\n", "\ufb01", "long" * 40]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 60)))) for _ in range(600)]

    class Counting:
        met: list[str] = []

        def encode(self, words, **options):
            self.met += words
            return tokenizer.encode(words, **options)

    for held in (10_000, 5):
        words, store = bpe.WordStore(Counting(), held), bpe.ChunkStore()
        Counting.met = []
        for _, data, offsets in blocks(pa.array(texts), 4000):
            raw = data.tobytes()
            own = [raw[a:b].decode() for a, b in itertools.pairwise(offsets.tolist())]
            for text, ids in zip(own, bpe.encode_spaced(data, offsets, words, store), strict=True):
                assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text
        short = [w for w in Counting.met if len(w.encode()) <= bpe.LONGEST_HELD]
        assert held == 5 or len(short) == len(set(short))
        assert store.hits and all(len(w) <= bpe.LONGEST_HELD for w in words.ids)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_edges(make_docs, documents):
    learned = documents.select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [(10_000, None), (10_001, ""), (10_002, "123 !?"), (10_003, "漢字"), (None, "the"), (10_004, "é"), (10_004, "é"), (10_005, "the and of " * 30_000, None)]
    docs = make_docs(*[(r.doc_id, r.text, r.lang, r.source) for r in learned], *rows)
    found = {(r.doc_id, r.lang_pred) for r in language_id.identify_documents(docs).collect()}
    assert {(10_000, "und"), (10_001, "und"), (10_002, "und"), (10_005, "en")} <= found
    assert not {(10_003, "und"), (10_004, "und")} & found
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert not {10_000, 10_001, 10_002} & {r.doc_id for r in kept.collect()}
    assert language_id.identify_documents(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify_documents(make_docs((1, "abc", None))).collect()} == {"und"}


def test_language_model_does_not_follow_partitions(documents):
    docs = documents.select("doc_id", "text", "lang").filter("lang IS NOT NULL")
    scores = []
    for parts in (1, 60):
        model = language_id.learn(docs.repartition(parts, "doc_id"))
        scores.append(sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()))
    assert scores[0] == scores[1]


def test_texts_without_hits_go_whatever_the_languages(make_docs, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    for n in (2, 3, 4):
        langs = sorted({r[2] for r in rows})[:n]
        few = [r for r in rows if r[2] in langs]
        kept = {r.doc_id for r in language_id.keep_identified(make_docs(*few, (10_003, "漢字", None))).collect()}
        assert 10_003 not in kept and len(kept) > 0.9 * len(few)


def test_training_windows_are_a_parameter():
    docs = [(50, np.arange(40), np.zeros(40, np.int64), 1)]
    assert [len(toxicity._windows(docs, n)[2]) for n in (10, 100)] == [10, 40]


def test_filters_return_all_languages_and_correct_false_hits():
    grams = {f"l{i:03d}": np.arange(i * 50, i * 50 + 100, dtype=np.uint32) for i in range(70)}
    model = language_id.LanguageFilter.build(grams, dict.fromkeys(grams, 1), bits=14)
    assert len(model.planes) == 2
    where = language_id.slots(np.array([60], np.uint32), 14)
    mask = int(model.planes[0][where[0]][0] & model.planes[0][where[1]][0])
    assert mask & 0b11 == 0b11  # in both l000 and l001
    assert (model.false_rates() < 0.01).all()


def brute_marginals(chain, n, emissions):
    """Marginals by summing over all labellings."""
    total, ones = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(emissions[i] for i in range(n) if y[i]) + sum(chain.transitions[y[i], y[i + 1]] for i in range(n - 1))
        total += np.exp(s)
        ones += np.exp(s) * np.array(y)
    return ones / total


def test_marginals_equal_enumeration():
    chain = toxicity.Chain(np.zeros(1), -1.2, np.array([[0.1, -0.7], [0.3, 0.9]]))
    at, extra = np.array([1, 2, 7]), np.array([2.0, -0.5, 3.0])
    emissions = np.full(9, -1.2)
    emissions[at] += extra
    assert chain.marginals(9, at, extra) == pytest.approx(brute_marginals(chain, 9, emissions)[at])


def test_training_follows_the_gradient():
    """The trained chain explains its labels better than the start."""
    rng = np.random.default_rng(3)
    docs = []
    for d in range(60):
        tokens = np.sort(rng.choice(40, 4, replace=False))
        docs.append((40, tokens, rng.integers(0, 3, 4) if d % 2 else rng.integers(3, 6, 4), d % 2))
    chain = toxicity.train_chain(*toxicity._windows(docs), 6)
    assert chain.weights[:3].min() > chain.weights[3:].max()
    assert chain.marginals(40, np.array([5]), chain.weights[[0]])[0] > 0.5 > chain.marginals(40, np.array([5]), chain.weights[[4]])[0]


def test_toxicity_held_out_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.9
    assert sum(r.predicted for r in clean) / len(clean) < 0.02
    assert all(r.score >= 0.5 if r.predicted else r.score < 0.5 for r in rows)
    spans = [r.text[s.start : s.end] for r in toxic for s in r.spans]
    assert spans and all(re.fullmatch(r"[^\W_]+", s) for s in spans)


def test_toxicity_edges(make_docs, spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs((1, None), (2, ""), (None, "x"), (3, "y " * 100_000), (3, "y"))
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs, labels).count() == 5
