import numpy as np

from cohortlab.llm import topk_search as t

from .conftest import same


def brute(rows, k=20):
    known = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = tuple(e)
        known[i] = min(known.get(i, v), v)
    known = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in known.items()}
    out = []
    for q, v in known.items():
        if q % 20 == 0:
            score = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(score, 1)]
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, e, "x", 0) for i, e in rows], "vec_id long, embedding array<float>, v string, rank int")
    same([tuple(r) for r in t.search_table(df).collect()], brute([(r.vec_id, r.embedding) for r in df.collect()]))


def test_random_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).round(2).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]                       # one vector very often
    rows += [(2000, None), (2001, [0.1, None]), (2020, [float("nan")] * 12), (2040, [float("inf")]), (2060, []), (2080, [1.0, -2.0]),
             (None, [1.0] * 12), (20, rows[20][1]), (40, [9.0] * 12), (-20, [0.0] * 12)]
    check(spark, rows)
    monkeypatch.setattr(t, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(t, "QUERY_BLOCK", 7)
    monkeypatch.setattr(t, "FEW", 1)
    check(spark, rows)


def test_large_components(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, (rng.normal(size=6) * 1e4).tolist()) for i in range(100)])


def test_few_rows(spark):
    check(spark, [(20, [1.0, 2.0])])
    check(spark, [(20, [1.0, 2.0]), (21, [1.0, 2.0])])
    assert t.search_table(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(5)
    rows = np.floor(64 * rng.normal(size=(3000, 6))).astype(np.int64)
    block = t.Block(np.arange(3000), rows, 20)
    left = block.candidates(rows[7], 20)
    assert len(left) <= t.FEW
    exact = np.sort(block.rows @ rows[7])[::-1][20]
    assert set(np.flatnonzero(block.rows @ rows[7] >= exact)) <= set(left.tolist())
