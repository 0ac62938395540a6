"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from snapframe.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def code(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16] + len(text.encode()).to_bytes(8, "big")


def expected(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, code(role, text), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        whole = tuple(turns.get(base, [])[:h] + own[h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
    nodes = {p: {"children": 0, "leaves": 0, "saved": 0} for p in members}
    for p in sorted(nodes, key=len, reverse=True):
        if not nodes[p]["children"]:
            nodes[p]["leaves"] = 1
        if p:
            nodes[p]["saved"] += (len(members[p]) - 1) * len(p[-1][1].encode())
            up = nodes[p[:-1]]
            up["children"] += 1
            up["leaves"] += nodes[p]["leaves"]
            up["saved"] += nodes[p]["saved"]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), nodes[p]["children"], nodes[p]["leaves"], nodes[p]["saved"], sha(ends.get(p, []))) for p, m in members.items()
    )


def order(rows):
    return sorted(tuple(r) for r in rows)


def trie(spark, rows, parts=None):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts or before)
        return order(prefix_trie.build_trie(frame(spark, rows)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5), (3, 13), (4, 29)])
def test_random_conversations(spark, seed, parts):
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        kinds = rng.choice((1, 2, 3))
        for t in range(rng.choice((1, 2, 3, 6, 12, 20))):
            rows.append((c * rng.choice((1, 1, 3)), t, rng.choice(("u", "a")) if kinds == 3 else "u", rng.choice(("é", "bb", "")[:kinds])))
    assert trie(spark, rows, parts) == expected(rows)


def test_nulls_repeats_gaps_and_copies(spark):
    long = "word " * 50_000
    rows = [(1, None, None, None), (1, 5, "u", "x"), (1, 5, "u", "x"), (1, 5, "a", "y"), (None, 0, "u", "z"), (-7, 0, "u", "x"), (-10, 0, "a", "x"), (23, 3, "u", long), (23, 2000, "u", "far"), (23, -3000, "u", "first")]
    rows += [(1000 + i, t, "u", f"same {t}") for i in range(300) for t in range(9)]
    rows += [(40_000 + 5 * i, 0, "u", "short") for i in range(40)]
    assert trie(spark, rows, 6) == expected(rows)


def test_single_turnless_and_empty(spark):
    alone = [(3, 0, "u", "only")]  # without conversation 0 its first turns have no source
    assert trie(spark, alone) == expected(alone)
    assert prefix_trie.build_trie(frame(spark, alone).limit(0)).count() == 0
    gone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:2]
    rows = [(c, 0, "u", "t") for c in gone]
    assert [r[1] for r in expected(rows)] == [0] and trie(spark, rows) == expected(rows)


def test_long_chains_of_prefixes(spark):
    rows = [(5 * c, t, "u", "t") for c in range(40) for t in range(c)]
    assert trie(spark, rows, 11) == expected(rows)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_prefix_trie(spark, sf_dir)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert order(found.collect()) == expected(rows)


def test_sql_equals_brute_force(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert sorted(con.execute(queries.ORACLES["op13_prefix_trie"]).fetchall()) == expected(rows)
