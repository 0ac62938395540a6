import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from snapframe.llm import ngram_join
from snapframe.llm.components import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    """(doc_id, n_shingles, component_id) by testing every pair that shares a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def texts(seed, n):
    """Families of edited copies around the threshold, on few words so that tokens are frequent."""
    rng = np.random.default_rng(seed)
    out = []
    for family in range(n):
        base = [f"v{x}" for x in rng.integers(0, 9 if family % 2 else 400, int(rng.integers(1, 120)))]
        for _ in range(int(rng.integers(1, 14))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = f"e{int(rng.integers(0, 50))}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("words,percent,least", [(4, 85, 8), (4, 85, 2), (5, 80, 3)])
def test_components_match_brute_force(make_docs, monkeypatch, words, percent, least):
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", least)
    monkeypatch.setattr(ngram_join, "LONG", least)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "PIVOT_GROWTH", 3)
    rows = [(i, t) for i, t in enumerate(texts(words + least, 40))]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "a b c"), (None, rows[3][1]), (None, "lonely words here now"), (3, rows[3][1]), (906, "z " * 50_000)]
    found = ngram_join.cluster(make_docs(*rows).repartition(5), words, percent).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, words, percent)


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in ngram_join.cluster(docs).collect()), key=str) == brute(rows, 4, 85)


def test_large_family_near_the_threshold(make_docs):
    """Edited copies of one text, most of whose pairs are just below the threshold."""
    rng = np.random.default_rng(11)
    base = [f"v{x}" for x in rng.integers(0, 60, 150)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(int(rng.integers(0, 4))):
            copy[int(rng.integers(0, len(copy)))] = f"v{int(rng.integers(0, 60))}"
        rows.append((i, " ".join(copy)))
    found = ngram_join.cluster(make_docs(*rows).repartition(5)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, 4, 85)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    frequent = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    kinds = dict(zip(frequent.tolist(), rng.choice([2, 3], len(frequent)).tolist(), strict=True))
    classes = lambda tokens: np.array([kinds.get(t, 1) for t in tokens.tolist()], np.uint8)
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        common = rng.choice(frequent, int(rng.integers(0, n + 1)), replace=False) if n <= 3000 else frequent
        x = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - len(common)).astype(np.uint64)]))
        lost = int(rng.integers(0, ngram_join.missing(len(x), 85) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[lost:], rng.choice(frequent, int(rng.integers(0, 5)))]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            small, large = sorted((x, y), key=len)
            (rare, index, _), (other, _, probe) = (ngram_join.signatures(s, classes(s)) for s in (small, large))
            assert len(np.intersect1d(rare, other)) or len(np.intersect1d(index, probe))
            apart = np.bitwise_count((ngram_join.bitmap(x) ^ ngram_join.bitmap(y)).view(np.uint64)).sum()
            assert apart <= len(x) + len(y) - 2 * both


def test_token_classes_follow_counts(make_docs):
    rows = [(i, f"a b c d u{i} v{i} w{i} x{i}" + (" e f g h" if i < 300 else "")) for i in range(320)]
    from snapframe.llm.common import shingle_sets, utf8

    found = ngram_join.token_classes(make_docs(*rows).repartition(7).select("text"), 4)
    import pyarrow as pa

    for text, least in (("a b c d", 3), ("e f g h", 3), ("u1 v1 w1 x1", 1)):
        tokens = next(iter(shingle_sets(*utf8(pa.array([text])), 4)))
        if least == 1 or tokens[0] < ngram_join.COUNTED_BELOW:
            assert found.of(tokens)[0] == least


def test_tokens_met_once_are_no_keys(make_docs):
    """Lists of one member are not shuffled: of texts that share nothing, no key is left that was counted."""
    from snapframe.llm.common import shingle_sets, utf8

    rows = [(i, " ".join(f"u{i}x{j}" for j in range(90)) + (" a b c d e f g h" if i < 2 else "")) for i in range(60)]
    docs = make_docs(*rows).repartition(7)
    found = ngram_join.token_classes(docs.select("text"), 4)
    import pyarrow as pa

    sets = list(shingle_sets(*utf8(pa.array([t for _, t in rows])), 4))
    both = np.intersect1d(sets[0], sets[1])
    assert len(both) == 5 and found.met(both).all()
    for tokens in sets[2:]:
        rare, _, _ = ngram_join.signatures(tokens, found.of(tokens), 85, found.met(tokens))
        assert len(rare) <= 1  # a bit that another token has set lets one by now and then
        every, _, _ = ngram_join.signatures(tokens, found.of(tokens), 85)
        assert len(every) == ngram_join.missing(len(tokens), 85) + 1


def test_keep_first_and_empty(make_docs):
    docs = make_docs((2, "a b c d e f"), (1, "A b c d e f"), (3, None), (4, None), (5, "other words stand here now"))
    kept = ngram_join.keep_first(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    twins = make_docs((2, "a b c d e f"), (1, "A b c d e f"), (2, "other words stand here now"), (None, "a b c d e f"), (None, "p q r s t u"), (7, "a b c d e f"), (1, "A b c d e f"))
    assert sorted((r.doc_id or 0, r.text) for r in ngram_join.keep_first(twins, 5, 80).collect()) == [(0, "p q r s t u"), (1, "A b c d e f"), (1, "A b c d e f"), (2, "other words stand here now")]
    assert ngram_join.cluster(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    found = {r.k: r.label for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 160))
    assert len(list(combinations(range(3), 2))) == 3


@pytest.mark.parametrize("percent", [85, 80])
def test_pairs_of_many_lists_are_made_once(spark, percent):
    """Lists of the same members: what the joins hand on grows neither with pairs nor with lists' pairs."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64)) for _ in range(2)]
    sets = [np.unique(np.concatenate([rng.permutation(sets[i % 2])[:95], rng.integers(0, 1 << 63, 2).astype(np.uint64)])) for i in range(80)]
    maps = [ngram_join.bitmap(s) for s in sets]
    rows = [(sig, k, len(s), m.tolist(), k % 3 != 0, 80, k // 4) for sig in range(6) for k, (s, m) in enumerate(zip(sets, maps, strict=True))]
    left = spark.createDataFrame(rows, "sig long, k long, n long, map array<long>, lead boolean, size long, label long")

    def near(a, b):
        apart = int(np.bitwise_count((maps[a] ^ maps[b]).view(np.uint64)).sum())
        return apart * (100 + percent) <= (len(sets[a]) + len(sets[b])) * (100 - percent)

    wanted = sorted((a, b, len(sets[a]), len(sets[b])) for a, b in combinations(range(80), 2) if a // 4 != b // 4 and (a % 3 or b % 3) and near(a, b))
    pairs = ngram_join._pivot_pairs(left, 80, percent)
    assert wanted and sorted(tuple(r) for r in pairs.collect()) == wanted
    made = []

    def walk(node):
        if any(x in node.nodeName() for x in ("Join", "Generate", "Arrow")) and node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
        parts = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        children = node.children()
        for x in [*parts, *(children.apply(i) for i in range(children.size()))]:
            walk(x)

    plan = pairs._jdf.queryExecution().executedPlan()
    pairs._jdf.queryExecution().toRdd().count()
    walk(plan)
    assert made and max(made) <= 2 * len(wanted)
