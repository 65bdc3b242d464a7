"""Nearest-neighbour mutual information against a plain all-pairs computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import neighbours, prep


def psi(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, int(n)))


def brute(x, y, k):
    x, y = np.asarray(x, float), np.asarray(y)
    sizes = {c: int((y == c).sum()) for c in set(y.tolist())}
    use = np.array([sizes[c] > 1 for c in y.tolist()], bool)
    x, y = x[use], y[use]
    total = 0.0
    for i in range(len(x)):
        d = np.abs(x - x[i])
        same = np.delete(d, i)[np.delete(y, i) == y[i]]
        r = np.sort(same)[min(k, len(same)) - 1]
        total += psi((same <= r).sum()) - psi(sizes[y[i]]) - psi((np.delete(d, i) <= r).sum())
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("block", [3, 7, 100_000])
def test_equals_all_pairs_across_block_borders(spark, block):
    rng = np.random.default_rng(3)
    n = 300
    y = rng.integers(0, 3, n)
    # whole multiples of 1/64: differences are exact in both computations
    smooth = np.round((rng.normal(size=n) + y) * 2 ** 20) / 2 ** 20
    coarse = np.round((rng.normal(size=n) + y) * 4) / 4
    hot = np.where(rng.random(n) < 0.4, 1.0, smooth)
    noise = np.round(rng.random(n) * 2 ** 20) / 2 ** 20
    y[0] = 9                                                  # a label with one row takes no part
    rows = [(int(a), float(b), float(c), float(d), float(e)) for a, b, c, d, e in zip(y, smooth, coarse, hot, noise)]
    df = spark.createDataFrame(rows, "y int, smooth double, coarse double, hot double, noise double")
    got = {r.feature: r for r in neighbours.neighbour_mi(df, "y", ["smooth", "coarse", "hot", "noise"], block=block).collect()}
    for name, x in (("smooth", smooth), ("coarse", coarse), ("hot", hot), ("noise", noise)):
        assert got[name].n == n - 1
        assert math.isclose(got[name].mi, brute(x, y, 3), abs_tol=1e-8), name
    assert got["smooth"].mi > 0.2 > got["noise"].mi and got["smooth"].selected


def test_missing_values_small_labels_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1.0, None, 5.0), (0, 2.0, None, nan), (0, None, None, 5.0), (1, 9.0, None, inf), (1, 9.5, None, 5.0),
            (None, 3.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "y int, a double, gone double, b double")
    got = {r.feature: r for r in neighbours.neighbour_mi(df, "y", ["a", "gone", "b"]).collect()}
    assert got["a"].n == 4 and math.isclose(got["a"].mi, brute([1, 2, 9, 9.5], [0, 0, 1, 1], 3), abs_tol=1e-8)
    assert "gone" not in got
    assert got["b"].n == 2 and got["b"].mi == 0.0 and not got["b"].selected     # one label is left
    filled = {r.feature: r.n for r in neighbours.neighbour_mi(df, "y", ["a", "gone"], fills={"a": 2.0, "gone": 1.0}).collect()}
    assert filled == {"a": 5, "gone": 5}
    assert neighbours.neighbour_mi(df.limit(0), "y", ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        neighbours.neighbour_mi(df, "y", ["a"], k=5, block=4)


def test_digamma(spark):
    got = spark.range(1, 40).select("id", neighbours.digamma(F.col("id")).alias("p")).collect()
    assert all(math.isclose(r.p, psi(r.id), abs_tol=1e-9) for r in got)


def test_selection_by_neighbours(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 400)
    rows = [(i, int(a), float(a + rng.normal() / 2), None if i % 7 == 0 else float(rng.random())) for i, a in enumerate(y)]
    df = spark.createDataFrame(rows, "patient_id long, y int, told double, noise double")
    state = prep.fit_prep(df, "y", key=["patient_id"], exact=True, threshold=0.1, estimator="neighbours")
    assert state.selected == ["told"] and dict(state.mi)["told"] > 0.2
    with pytest.raises(ValueError):
        prep.fit_prep(df, "y", key=["patient_id"], estimator="other")


def test_neighbours_are_plain_columns(spark, monkeypatch):
    """Distances and counts of a row are compared column by column; no lambda runs for every row."""
    plans = []
    written = neighbours.materialise

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)
    monkeypatch.setattr(neighbours, "materialise", noted)
    df = spark.createDataFrame([(i % 2, float(i * i % 17)) for i in range(40)], "y int, a double")
    got = neighbours.neighbour_mi(df, "y", ["a"]).collect()
    assert got[0].n == 40 and len(plans) == 2 and not any("lambda" in p for p in plans)
