import hashlib

import pytest

from pyspark.sql import functions as F

from snapframe.llm import grace_dedup, source_mix
from snapframe.llm.grace_dedup import ContentTable

LONG = "word " * 60_000


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected_groups(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lowered(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("table_bytes", [grace_dedup.TABLE_BYTES, 2000])
def test_exact_groups(make_docs, table_bytes):
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "abc"), (None, "alone"), (7, LONG), (8, LONG.upper()), (9, "x"), (9, "x")]
    rows += [(100 + i, f"text {i % 40}") for i in range(200)]
    found = grace_dedup.exact_groups(make_docs(*rows), table_bytes).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected_groups(rows)


def test_keep_distinct_leaves_one_whole_row(make_docs):
    docs = make_docs((1, "A b"), (2, "a B"), (3, None), (3, None), (4, "c", None, None))
    kept = grace_dedup.keep_distinct(docs)
    assert kept.columns == docs.columns and kept.schema["size"] == docs.schema["size"]
    assert sorted((r.doc_id, r.text, r.lang, r["size"]) for r in kept.collect()) == [(2, "a B", "en", 7), (3, None, "en", 7), (4, "c", None, 7)]


def test_empty_input(make_docs):
    docs = make_docs((1, "a")).limit(0)
    assert grace_dedup.exact_groups(docs).count() == 0
    assert grace_dedup.keep_distinct(docs).count() == 0
    assert source_mix.mix(docs).count() == 0
    assert source_mix.mixed_documents(docs).count() == 0


def test_table_compares_contents_of_equal_digests():
    table = ContentTable(2)
    for i, text in enumerate(["a", "b", "A", "c", "b"]):
        table.add(b"same digest", text, i, 1, i)
    assert [(r[1], r[2], r[3]) for r in table.rows] == [("A", 2, 2), ("b", 4, 2), ("c", 3, 1)]


def by_rounds(sizes, weights, share=1.5, cap=2):
    """Targets by repeated resharing, source by source."""
    budget = share * sum(sizes.values())
    target, fixed = dict.fromkeys(sizes, 0.0), set()
    while True:
        rest = budget - sum(target[s] for s in fixed)
        free = [s for s in sizes if s not in fixed]
        total = sum(weights[s] for s in free)
        for s in free:
            target[s] = rest * weights[s] / total
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
            fixed.add(s)


def test_mix_targets_and_takes(make_docs):
    rows = [(i, "w " * (i % 37), "en", ["a", "b", "é", "z", None][i * i % 5 if i % 3 else 0]) for i in range(300)]
    rows += [(None, "one two", "en", "b"), (5, "w w", "en", "b"), (5, "w w", "en", "b"), (999, None, "en", "b"), (1000, LONG, "en", "q")]
    found = source_mix.mix(make_docs(*rows)).collect()
    assert len(found) == len(rows)
    sizes = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] = r.source_size
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = by_rounds(sizes, weights)
    for s in order:
        own = [r for r in found if r.source == s]
        assert sum(r["size"] for r in own) == sizes[s]
        assert own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
    again = source_mix.mix(make_docs(*rows).repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_positions_invert_the_schedule(make_docs):
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(400)]
    found = source_mix.mix(make_docs(*rows)).collect()
    times = {s: [t for r in found if r.source == s for t in (r.first_time, r.second_time) if t is not None] for s in "ab"}
    early = {s: sum(t < 0.25 for t in v) / len(v) for s, v in times.items()}
    assert abs(early["a"] - (0.5 * 0.25 + 0.5 * 0.25**2)) < 0.01  # a's weight rises
    assert abs(early["b"] - 0.25) < 0.01  # b's stays
    assert all(0 <= t <= 1 for v in times.values() for t in v)


def test_mixed_documents_repeat_rows(make_docs):
    docs = make_docs(*[(i, f"w{i} " * 10, "en", "ab"[i % 2]) for i in range(100)])
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert abs(mixed.count() - 150) <= 3


def test_twins_and_null_ids_are_drawn_one_by_one(make_docs):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "e f g h"), (None, "i j k l"), (None, "m n o p"), (2, None)]
    docs = make_docs(*rows).drop("size").withColumn("position", F.lit("own"))
    taken = source_mix.mix(docs).collect()
    want = sum((r.taken * 2 >= r.size) + (r.taken * 2 >= 3 * r.size) for r in taken if r.size)
    found = source_mix.mixed_documents(docs, position="position")
    assert found.columns == [*docs.columns, "position_"]
    rows = found.collect()
    assert len(rows) == want and all(r.text and 0 <= r.position_ <= 1 for r in rows)
    assert source_mix.mixed_documents(docs.limit(0)).count() == 0
