"""Toxicity scores from a linear-chain conditional random field over tokens.

A token is a run of ASCII letters and digits or non-ASCII bytes, lower-cased; its features are
itself and its byte prefixes, by hash. Features that occur in toxic documents much more often
than in others form a bounded lexicon, and mark the labelled tokens: a token with a lexicon
feature is toxic in a toxic document and not toxic in another; all other tokens are background.
A two-state chain is trained on windows around such tokens by maximum likelihood.

Scoring is exact forward-backward over whole texts. Background tokens all have the same
potentials, so a stretch of them is a power of one 2 x 2 matrix, and the chain is walked from
one lexicon token to the next, however long the text. The marginals give the toxic spans with
their offsets, and their maximum, sum and density give the document's score through a logistic
curve fitted to the document labels.
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

SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 6000  # labelled documents that are fitted, about
LEXICON = 2000
LEAST_ODDS = 2.5
LEAST_TOXIC_DOCS = 4
PREFIXES = (4, 5, 6, 7, 8)
WINDOW = 8
MAX_WINDOWS = 6000
STEPS = 150

_between = np.ones(256, bool)
_between[128:] = False
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _between[_c] = False


def token_features(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, rows of a block's tokens and, by kind, the tokens that have it and its hashes."""
    starts, ends, rows = word_spans(data, offsets, _between)
    kinds = [(np.arange(len(starts)), span_hashes(data, starts, ends, lower=True))]
    for length in PREFIXES:
        at = np.flatnonzero(ends - starts > length)
        hashes = mix64(span_hashes(data, starts[at], starts[at] + length, lower=True) + np.uint64(length))
        kinds.append((at, hashes))
    return starts, ends, rows, kinds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, toxic ones and others."""
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
        keys, marks = [], []
        for first, data, offsets in blocks(batch.column("text")):
            _, _, rows, kinds = token_features(data, offsets)
            row = np.concatenate([rows[at] for at, _ in kinds])
            key = np.concatenate([h for _, h in kinds])
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            keys.append(key[new])
            marks.append(toxic[first + row[new]])
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, int))
        t = np.bincount(inverse, np.concatenate(marks) if marks else None, minlength=len(found)).astype(np.int64)
        n = np.bincount(inverse, minlength=len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(t), pa.array(n - t)], ["feature", "t", "n"])


@dataclass
class Lexicon:
    """Sorted feature hashes; position i + 1 is the number of feature i, 0 means background."""

    hashes: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, kinds) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature) pairs in token order."""
        tokens, features = [], []
        for at, hashes in kinds:
            some = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
            where = np.searchsorted(self.hashes, hashes[some])
            good = where < len(self.hashes)
            good[good] = self.hashes[where[good]] == hashes[some][good]
            tokens.append(at[some][good])
            features.append(where[good])
        tokens, features = np.concatenate(tokens), np.concatenate(features)
        order = np.lexsort((features, tokens))
        return tokens[order], features[order]


@dataclass
class Chain:
    """Two-state chain: emission of state 1 is bias + sum of feature weights, of state 0 zero."""

    weights: np.ndarray
    bias: float
    transitions: np.ndarray

    def __post_init__(self):
        step = np.exp(self.transitions) * np.array([1.0, np.exp(self.bias)])
        values, left = np.linalg.eig(step)
        order = np.argsort(-values.real)
        self.top, self.ratio = values.real[order[0]], values.real[order[1]] / values.real[order[0]]
        self.left, self.right = left.real[:, order], np.linalg.inv(left.real[:, order])

    def power(self, n: int) -> np.ndarray:
        """The background step n times, scaled to a leading factor of one."""
        return (self.left * np.array([1.0, self.ratio**n])) @ self.right

    def marginals(self, n: int, at: np.ndarray, emissions: np.ndarray) -> np.ndarray:
        """P(state 1) at the positions `at` of a text of n tokens, all others being background."""
        scale = np.exp(np.clip(emissions, -30, 30))  # over background
        forward = np.empty((len(at), 2))
        message, last = np.array([1.0, np.exp(self.bias)]), 0
        for i, p in enumerate(at.tolist()):
            if p > last:
                message = message @ self.power(p - last)
            message = message * np.array([1.0, scale[i]])
            message = np.maximum(message / message.sum(), 1e-300)
            forward[i], last = message, p
        out = np.empty(len(at))
        back, last = np.ones(2), n - 1
        for i in range(len(at) - 1, -1, -1):
            p = int(at[i])
            if last > p:
                back = self.power(last - p) @ back
            back = np.maximum(back / back.sum(), 1e-300)
            both = forward[i] * back
            out[i] = both[1] / both.sum()
            back, last = back * np.array([1.0, scale[i]]), p
        return out


def train_chain(features: list[np.ndarray], labels: np.ndarray, lengths: np.ndarray, n_features: int) -> Chain:
    """Fit by full-batch Adam. features[t] is (window, feature) pairs at step t; labels is windows x steps."""
    n, steps = labels.shape
    weights, bias, trans = np.zeros(n_features), -3.0, np.zeros((2, 2))
    alive = np.arange(steps)[None, :] < lengths[:, None]
    params = np.concatenate([weights, [bias], trans.ravel()])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        weights, bias, trans = params[:n_features], params[n_features], params[n_features + 1 :].reshape(2, 2)
        emission = np.full((n, steps), bias)
        for t, (w, f) in enumerate(features):
            np.add.at(emission[:, t], w, weights[f])
        emit = np.stack([np.ones((n, steps)), np.exp(np.clip(emission, -30, 30))], 2)
        move = np.exp(trans)
        alpha = np.empty((n, steps, 2))
        alpha[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
        for t in range(1, steps):
            nxt = (alpha[:, t - 1] @ move) * emit[:, t]
            nxt = np.where(alive[:, t, None], nxt, alpha[:, t - 1])
            alpha[:, t] = nxt / nxt.sum(1, keepdims=True)
        gradient = np.zeros_like(params)
        beta = np.ones((n, 2))
        pairs = np.zeros((2, 2))
        for t in range(steps - 1, -1, -1):
            both = alpha[:, t] * beta
            p = both[:, 1] / both.sum(1)
            miss = np.where(alive[:, t], labels[:, t] - p, 0.0)
            gradient[n_features] += miss.sum()
            w, f = features[t]
            np.add.at(gradient[:n_features], f, miss[w])
            if t:
                joint = alpha[:, t - 1, :, None] * move * (emit[:, t] * beta)[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                pairs -= (joint * alive[:, t, None, None]).sum(0)
                seen = np.zeros((2, 2))
                np.add.at(seen, (labels[:, t - 1][alive[:, t]], labels[:, t][alive[:, t]]), 1.0)
                pairs += seen
                back = (emit[:, t] * beta) @ move.T
                beta = np.where(alive[:, t, None], back / back.sum(1, keepdims=True), beta)
        gradient[n_features + 1 :] = pairs.ravel()
        gradient = gradient / n - 1e-4 * params
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        params = params + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Chain(params[:n_features].copy(), float(params[n_features]), params[n_features + 1 :].reshape(2, 2).copy())


def _windows(docs: list[tuple[int, np.ndarray, np.ndarray, int]], max_windows: int = MAX_WINDOWS):
    """Training windows: each around one lexicon token, holding its neighbours' features and labels.

    Of more than `max_windows` tokens that many are drawn by a hash of their place.
    """
    steps = 2 * WINDOW + 1
    spans = [(d, p) for d, (_, tokens, _, _) in enumerate(docs) for p in np.unique(tokens).tolist()]
    if len(spans) > max_windows:
        keep = np.argsort(mix64(np.arange(len(spans), dtype=np.uint64)))[:max_windows]
        spans = [spans[i] for i in keep]
    labels, lengths = np.zeros((len(spans), steps), np.int64), np.zeros(len(spans), np.int64)
    cells: list[list[tuple[int, int]]] = [[] for _ in range(steps)]
    for w, (d, p) in enumerate(spans):
        n, tokens, features, toxic = docs[d]
        low = max(0, p - WINDOW)
        lengths[w] = min(n, p + WINDOW + 1) - low
        for i in range(int(np.searchsorted(tokens, low)), int(np.searchsorted(tokens, p + WINDOW, "right"))):
            cells[int(tokens[i]) - low].append((w, int(features[i])))
            labels[w, int(tokens[i]) - low] = toxic
    pairs = [tuple(np.array(c, np.int64).reshape(-1, 2).T) for c in cells]
    return pairs, labels, lengths


def summary(n: int, at: np.ndarray, marginals: np.ndarray) -> list[float]:
    """What the document curve sees: greatest marginal, expected toxic tokens, and their density."""
    total = float(marginals.sum())
    return [1.0, float(marginals.max()) if len(at) else 0.0, float(np.log1p(total)), float(np.log1p(100 * total / max(n, 1)))]


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by damped Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = 1e-2 * np.eye(len(beta))
        gradient = x.T @ (weight * (y - p)) - ridge @ beta
        beta = beta + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        beta = np.clip(beta, -20, 20)
    return beta


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    chain: Chain | None
    curve: np.ndarray

    def score_block(self, data: np.ndarray, offsets: np.ndarray):
        """Per text: score, expected toxic tokens and toxic spans as (start, end) code points."""
        starts, ends, rows, kinds = token_features(data, offsets)
        size = len(offsets) - 1
        base = float(1 / (1 + np.exp(-self.curve[0]))) if len(self.curve) else 0.0
        scores, totals, spans = [base] * size, [0.0] * size, [[] for _ in range(size)]
        if self.chain is None or not len(starts):
            return scores, totals, spans
        tokens, features = self.lexicon.hits(kinds)
        counts = np.bincount(rows, minlength=size)
        begin = np.concatenate([[0], np.cumsum(counts)])
        where = rows[tokens]
        for r in np.unique(where).tolist():
            a, b = np.searchsorted(where, r), np.searchsorted(where, r, "right")
            at, first = np.unique(tokens[a:b], return_index=True)
            emissions = np.add.reduceat(self.chain.weights[features[a:b]], first)
            m = self.chain.marginals(int(counts[r]), at - begin[r], emissions)
            scores[r] = float(1 / (1 + np.exp(-np.clip(np.dot(self.curve, summary(int(counts[r]), at, m)), -30, 30))))
            totals[r] = float(m.sum())
            if len(bad := at[m >= 0.5]):
                chars = np.concatenate([[0], np.cumsum((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)])
                spans[r] = [{"start": int(chars[starts[t] - offsets[r]]), "end": int(chars[ends[t] - offsets[r]])} for t in bad.tolist()]
        return scores, totals, spans


def _training_hits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tokens, features = [], [], []
            for _, data, offsets in blocks(batch.column("text")):
                _, _, rows, kinds = token_features(data, offsets)
                hit, feature = shared.value.hits(kinds)
                counts = np.bincount(rows, minlength=len(offsets) - 1)
                begin = np.concatenate([[0], np.cumsum(counts)])
                for r in range(len(offsets) - 1):
                    a, b = np.searchsorted(hit, begin[r]), np.searchsorted(hit, begin[r + 1])
                    n.append(int(counts[r]))
                    tokens.append(hit[a:b] - begin[r])
                    features.append(feature[a:b])
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n, pa.int64()), pa.array(tokens, ints), pa.array(features, ints)], ["toxic", "n", "tokens", "features"])

    return run


def learn(docs: DataFrame, labels: DataFrame, max_windows: int = MAX_WINDOWS) -> ToxicityModel:
    """Fit on the documents that `labels` (doc_id, toxic) covers.

    About SAMPLE_TOXIC toxic and SAMPLE_CLEAN other documents are used, chosen by a hash of
    doc_id; that bounds the broadcast of labels and everything that reaches the driver.
    The chain is trained on at most `max_windows` windows around their lexicon tokens.
    """
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = ToxicityModel(Lexicon(np.zeros(0, np.uint64)), None, np.zeros(0))
    if not sizes.get(1) or not sizes.get(0):
        return empty
    share = F.when(F.col("toxic") == 1, SAMPLE_TOXIC / sizes[1]).otherwise(SAMPLE_CLEAN / sizes[0])
    sample = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    texts = materialise(texts, "toxicity-sample")
    fitted = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = fitted.get(1, 0), fitted.get(0, 0)
    if not n_toxic or not n_clean:
        return empty
    counts = texts.mapInArrow(_count, "feature long, t long, n long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("n") + 0.5) / (n_clean + 1))
    best = counts.filter(F.col("t") >= LEAST_TOXIC_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    chosen = best.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "feature").limit(LEXICON).select("feature").collect()
    lexicon = Lexicon(np.sort(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64)))
    if not chosen:
        return empty
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = texts.mapInArrow(_training_hits(shared), "toxic int, n long, tokens array<long>, features array<long>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["n"], r["tokens"], r["features"]))
    hits = [(r["n"], np.array(r["tokens"], np.int64), np.array(r["features"], np.int64), r["toxic"]) for r in rows]
    chain = train_chain(*_windows(hits, max_windows), len(lexicon.hashes))
    x = []
    for n, tokens, features, _ in hits:
        at, first = np.unique(tokens, return_index=True)
        m = chain.marginals(n, at, np.add.reduceat(chain.weights[features], first)) if len(at) else np.zeros(0)
        x.append(summary(n, at, m))
    y = np.array([h[3] for h in hits], float)
    weight = np.where(y == 1, sizes[1] / n_toxic, sizes[0] / n_clean)
    return ToxicityModel(lexicon, chain, fit_curve(np.array(x), y, weight / weight.mean()))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per input row: doc_id, score, predicted, toxic_tokens, spans (code point offsets).

    Texts without lexicon tokens, null and empty ones included, have the curve's base score;
    without labels to learn from every score is 0. Rows are scored one by one, whole texts at any
    length; empty input gives an empty result and extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, totals, spans = [], [], []
            for _, data, offsets in blocks(batch.column("text")):
                for whole, part in zip((scores, totals, spans), shared.value.score_block(data, offsets), strict=True):
                    whole.extend(part)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            predicted = [int(s >= 0.5) for s in scores]
            columns = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(totals, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "toxic_tokens", "spans"])

    schema = "doc_id long, score double, predicted int, toxic_tokens double, spans array<struct<start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans; learned from the labels outside fold 0 of 5."""
    model = learn(docs, labels.filter(fold(5) != 0))
    return score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted", "spans")
