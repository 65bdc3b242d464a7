"""Exact two-sample KS p-values against all arrangements and the closed form; bootstrap of exactly n draws."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import drift, split


def by_listing(d, m, n):
    """Share of all arrangements of m and n values whose largest gap is at least d."""
    hit = total = 0
    for chosen in itertools.combinations(range(m + n), m):
        own, gap, a, b = set(chosen), 0, 0, 0
        for k in range(m + n):
            a, b = a + (k in own), b + (k not in own)
            gap = max(gap, abs(a * n - b * m))
        total += 1
        hit += gap >= round(d * m * n)
    return hit / total


@pytest.mark.parametrize("m, n", [(1, 1), (2, 3), (4, 4), (3, 7), (5, 6), (6, 2)])
def test_against_all_arrangements(m, n):
    for h in range(0, m * n + 1):
        assert drift.exact_sf(h / (m * n), m, n) == pytest.approx(by_listing(h / (m * n), m, n), abs=1e-12)


@pytest.mark.parametrize("n, k", [(50, 5), (200, 30), (1000, 60), (1000, 1), (10_000, 300)])
def test_against_the_closed_form(n, k):
    terms = [(-1) ** (i + 1) * math.exp(2 * math.lgamma(n + 1) - math.lgamma(n - i * k + 1) - math.lgamma(n + i * k + 1))
             for i in range(1, n // k + 1)]
    assert drift.exact_sf(k / n, n, n) == pytest.approx(min(1.0, 2 * sum(terms)), rel=1e-6, abs=1e-9)


def test_flag_uses_the_exact_value(spark):
    rows = [("a", 1.0, 2, 2, 0.04, False), ("b", 0.9, 8, 8, 0.5, False), ("c", 0.05, 20_000, 30_000, 1e-9, True)]
    ks = spark.createDataFrame(rows, "feature string, d double, n_ref long, n_new long, p_value double, drifted boolean")
    got = {r.feature: r for r in drift.with_exact_p(ks).collect()}
    assert got["a"].p_value == pytest.approx(1 / 3) and not got["a"].drifted
    assert got["b"].drifted and got["b"].p_value == pytest.approx(drift.exact_sf(0.9, 8, 8))
    assert got["c"].p_value == 1e-9 and got["c"].drifted


def test_bootstrap_draws_exactly_n(spark):
    df = spark.range(700).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows = split.bootstrap(df, "k", "y", 5).collect()
    assert [r.n_draws for r in rows] == [700] * 5 and {r.replicate for r in rows} == set(range(5))
    assert all(r.abs_diff < 0.06 and 0.58 < r.n_distinct / 700 < 0.69 for r in rows)      # 1 - 1/e of the rows
    assert split.bootstrap(df.limit(0), "k", "y").collect() == []
