"""Whitening against numpy on the whole table at once."""

import math

import numpy as np
import pytest

from snapframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


def expected(rows):
    """n, sums, and by row: x, deviation and the whitened components, up to their sign."""
    fine = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, width = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(width)]
    centred = np.array([[v - s / n for v, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:4]
    out = {}
    for i, x in fine:
        white = (np.array([v - s / n for v, s in zip(x, sums, strict=True)]) @ vectors[:, order]) / np.sqrt(values[order])
        out.setdefault(i, []).append((sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), white))
    return n, values[order] / values.sum(), out


def check(found, rows):
    n, shares, want = expected(rows)
    by_row = {}
    for r in found:
        assert r.n == n and abs(r.explained - shares[r.component - 1]) <= 1e-9 and r.identity_error <= 1e-9
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, []).append((r.deviation, r.whitened))
    assert set(by_row) == set(want)
    signs = {}
    for i, parts in by_row.items():
        for k, got in parts.items():
            assert sorted(d for d, _ in got) == sorted(d for d, _ in want[i])
            if len(got) == 1:
                a, b = got[0][1], want[i][0][1][k - 1]
                assert abs(abs(a) - abs(b)) < 1e-9
                if abs(b) > 1e-6:
                    signs.setdefault(k, set()).add(a * b > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = queries.op11_embedding_whitening(spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    assert len(found) == 4 * len(rows)
    check(found, rows)


@pytest.mark.parametrize("width", [3, 70])
def test_odd_rows_copies_and_tiles(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, rng.normal(size=width).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(7, rows[3][1]), (None, rows[4][1])]
    odd = [(2000, None), (2001, []), (2002, [1.0] * (width - 1) + [None]), (2003, [float("nan")] * width), (2004, [float("inf")] + [0.0] * (width - 1)), (2005, [1.0] * (width + 1))]
    found = whitening.whiten(frame(spark, rows + odd).repartition(5)).collect()
    assert len(found) == min(4, width) * len(rows)
    check(found, rows)


def test_no_variance_empty_and_large(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whiten(frame(spark, [(1, [1.0, -0.5]), (2, [1.0, -0.5])])).collect()
    assert sorted(tuple(r)[:6] for r in same) == sorted((i, k, 1, 0, 0.0, 0.0) for i in (1, 2) for k in (1, 2))
    flat = whitening.whiten(frame(spark, [(i, [float(i), 2.0]) for i in range(5)])).collect()
    assert {r.component: r.explained for r in flat} == {1: 1.0, 2: 0.0} and all(r.whitened == 0 for r in flat if r.component == 2)
    huge = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0])])).collect()
    assert all(r.deviation is None for r in huge) and all(math.isfinite(r.whitened) for r in huge)


def test_whole_numbers_floor_towards_minus_infinity():
    got = whitening.whole(np.array([-0.001, 0.0, -0.0, 0.00390625, 1e300, -1e300]))
    assert got.tolist() == [-1, 0, 0, 1, 2**63 - 1, -(2**63)]
