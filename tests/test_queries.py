"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

from snapframe.plans import ORACLES, QUERIES, table_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    rows = sorted((str([plain(r[c]) for c in sorted(columns)]) for r in found.collect()))
    assert rows == sorted(str([plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_table_changes_take_every_row(spark, sf_dir):
    keys = lambda t, c: {r[0] for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c).collect()}
    got = lambda name, c: {r[0] for r in QUERIES[name](spark, sf_dir).select(c).collect()}
    orders, customers = keys("orders", "o_orderkey"), keys("customer", "c_custkey")
    assert orders <= got("whole_upserted_orders", "o_orderkey") and orders == got("whole_replaced_ranges", "o_orderkey")
    assert customers <= got("whole_queue_integrity", "k")
    jobs = QUERIES["whole_inserted_jobs"](spark, sf_dir)
    assert jobs.filter("o_orderstatus <> 'new'").count() == len(orders)


def free_pairs(pairs):
    """Of (key, left, right) best first, those whose sides are both still free."""
    taken, out = set(), []
    for key, a, b in pairs:
        if not {(key, "a", a), (key, "b", b)} & taken:
            taken |= {(key, "a", a), (key, "b", b)}
            out.append((key, a, b))
    return sorted(out)


def test_matched_boxes_equal_a_loop(spark, sf_dir):
    rows = [(r.frame, r.track_id, r.bbox) for r in table_queries.boxes(spark, sf_dir).collect()]
    pairs = []
    for f, i, p in rows:
        p = [p[0] + 2, p[1] + 1, p[2] + 2, p[3] + 1]
        for g, j, q in rows:
            w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
            if f == g and w > 0 and h > 0:
                both = w * h
                share = both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both)
                if share > 0.3:
                    pairs.append((-share, i, j, f))
    want = free_pairs((f, i, j) for _, i, j, f in sorted(pairs))
    assert sorted((r.frame, r.pose_id, r.track_id) for r in QUERIES["matched_boxes"](spark, sf_dir).collect()) == want


def test_matched_boundaries_equal_a_loop(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type").collect()
    side = lambda kind: [(e.user_id, float(e.event_id)) for e in events if e.event_type == kind]
    pairs = sorted((c, abs(c - t), t, u) for u, c in side("error") for v, t in side("signup") if u == v and abs(c - t) <= 50)
    want = free_pairs((u, c, t) for c, _, t, u in pairs)
    assert sorted((r.user_id, r.candidate, r.truth) for r in QUERIES["matched_boundaries"](spark, sf_dir).collect()) == want
