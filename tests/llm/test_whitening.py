from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import whitening as w


def plain(rows):
    """Brute force with whole numbers: (n, S, covariance, {id: deviations}) of (id, vector) rows."""
    xs = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in rows
          if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[(n * sum(x[a] * x[b] for x in fit) - s[a] * s[b]) / n ** 2 for b in range(d)] for a in range(d)])
    return xs, n, s, cov


def check(df, rows):
    got = df.collect()
    xs, n, s, cov = plain(rows)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(16, len(s))
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in xs for c in range(1, k + 1))
    dev = Counter((i, sum((n * v - t) ** 2 for v, t in zip(x, s))) for i, x in xs)
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == dev
    assert {r.n for r in got} == {n}
    if len({i for i, _ in xs}) == len(xs):
        white = {(r.vec_id, r.component): r.whitened for r in got}
        for c in range(k):
            if e[c] > e[0] * 1e-12:
                want = np.array([(np.array(x) - np.array(s) / n) @ u[:, c] / np.sqrt(e[c]) for _, x in xs])
                have = np.array([white[i, c + 1] for i, _ in xs])
                assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-5
    for r in got:
        assert abs(r.explained - max(e[r.component - 1], 0) / np.trace(cov)) <= 1e-4 * r.explained + 1e-12
        assert r.identity_error < 1e-4
    return got


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = check(w.whiten(df), rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r.whitened
    distinct = {tuple(np.floor(64 * np.array(v)).tolist()): i for i, v in rows}
    m = np.array([[by[i][c] for c in range(1, 17)] for i in distinct.values()])
    assert np.abs(np.cov(m.T, bias=True) - np.eye(16)).max() < 1e-8      # the rows' own covariance


SCHEMA = "vec_id long, embedding array<double>, x string, k int, v int, n int, at int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "q", 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(3)


def test_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, [1.0, None, 2.0, 3.0, 4.0]), (104, [np.nan, 0.0, 0.0, 0.0, 0.0]),
             (105, [np.inf, 0.0, 0.0, 0.0, 0.0]), (106, [1e3, -1e3, 0.0, 5.0, -0.001])]
    check(w.whiten(frame(spark, rows)), rows)
    odd = rows + [(107, [1.0]), (108, []), (109, [1e300] * 5)]
    got = w.whiten(frame(spark, odd)).collect()
    assert not {r.vec_id for r in got} & {102, 103, 104, 105, 107, 108, 109}
    assert w.whiten(frame(spark, rows).filter("1 = 0")).collect() == []
    assert w.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    twice = w.whiten(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()      # one distinct vector
    assert len(twice) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 1 for r in twice)
    two = w.whiten(frame(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])])).collect()                     # rank one
    assert [(r.vec_id, r.component, abs(r.whitened) if r.whitened is not None else None) for r in sorted(two, key=lambda r: (r.vec_id, r.component))] == [
        (i, c, 1.0 if c == 1 else None) for i in (1, 2) for c in (1, 2, 3)]


def test_large_entries(spark):
    """Entries of very different size stay exact, deviations beyond 64 bits are null."""
    rows = [(i, [float(2 ** 40 * (i % 3)), float(i), 2.0 ** -6 * i]) for i in range(9)]
    got = {(r.vec_id, r.component): r for r in w.whiten(frame(spark, rows)).collect()}
    xs, n, s, _ = plain(rows)
    for i, x in xs:
        true = sum((n * v - t) ** 2 for v, t in zip(x, s))
        assert got[i, 1].deviation == (true if true < 2 ** 63 else None)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 4), st.sampled_from([1, 3, 17, 40, 63]), st.integers(0, 2 ** 32))
def test_plane_products(n, d, bits, seed):
    y = np.random.default_rng(seed).integers(0, 1 << bits, (n, d), dtype=np.uint64)
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(d)] for i in range(d)]
    assert w.plane_products(y).tolist() == want


@pytest.mark.parametrize("low", [-2 ** 40, 0, 999_950])
def test_sums_put_shifts_back(low):
    x = np.random.default_rng(1).integers(low, low + 90, (150, 3))
    sums = w.Sums(3)
    sums.add(x[:64])
    sums.add(x[64:])
    o = x.astype(object)
    assert sums.n == 150 and sums.s.tolist() == o.sum(axis=0).tolist() and sums.c.tolist() == (o.T @ o).tolist()
