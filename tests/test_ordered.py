"""Bucketed running sums and exact quantiles against brute force."""

import random

import numpy as np

from cohortlab.operators.ordered import cumulative, exact_quantiles


def _data(n=500, groups=3, seed=7):
    rnd = random.Random(seed)
    rows = {}
    for _ in range(n):
        g = rnd.randrange(groups)
        v = float(rnd.randrange(60))          # many ties before collapsing
        rows[(g, v)] = rows.get((g, v), 0) + rnd.randrange(1, 4)
    return [(g, v, c) for (g, v), c in rows.items()]


def test_cumulative_matches_brute_force(spark):
    data = _data()
    df = spark.createDataFrame(data, "g int, v double, c long")
    for desc in (False, True):
        got = {(r.g, r.v): r.cum_c for r in cumulative(df, ["g"], "v", ["c"], descending=desc,
                                                       n_buckets=5).collect()}
        for g in {d[0] for d in data}:
            pts = sorted((d for d in data if d[0] == g), key=lambda d: d[1], reverse=desc)
            run = 0
            for _, v, c in pts:
                run += c
                assert got[(g, v)] == run


def test_cumulative_global_and_null_order(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (None, 5), (3.0, 3)], "v double, c long")
    got = {r.v: r.cum_c for r in cumulative(df, [], "v", ["c"], n_buckets=2).collect()}
    assert got == {1.0: 1, 2.0: 3, 3.0: 6, None: None}


def test_exact_quantiles(spark):
    rnd = np.random.default_rng(3)
    vals = rnd.normal(size=301).round(2)
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [("b", 1.0), ("b", 2.0)],
                               "feature string, value double")
    for q in (0.5, 0.7, 0.15):
        got = {r.feature: r.quantile for r in exact_quantiles(df, ["feature"], "value", q).collect()}
        assert abs(got["a"] - float(np.quantile(vals, q))) < 1e-12
        assert abs(got["b"] - float(np.quantile([1.0, 2.0], q))) < 1e-12


def test_no_single_partition_exchange_over_rows(spark):
    from cohortlab.operators import curves
    df = spark.range(2000).selectExpr("CAST(id % 2 AS INT) AS y", "rand(1) AS p")
    q = curves.roc_auc(curves.score_curve(df)).select("roc_auc")
    q.collect()
    lines = q._jdf.queryExecution().executedPlan().toString().splitlines()
    # running sums over rows are hash-partitioned by bucket ...
    assert any("Exchange hashpartitioning(_bucket" in ln for ln in lines)
    # ... and every single-partition exchange sits on a partial aggregate: the final
    # sum of the AUC terms, or the bucket totals feeding the offsets
    for i, ln in enumerate(lines):
        if "Exchange SinglePartition" in ln:
            assert "HashAggregate" in lines[i + 1]


def test_exact_medians(spark):
    from cohortlab.operators import profile
    rnd = np.random.default_rng(5)
    rows = [(float(a), float(b)) for a, b in zip(rnd.normal(size=501).round(3), rnd.integers(0, 9, 501))]
    df = spark.createDataFrame(rows + [(None, None), (float("nan"), float("nan"))], "a double, b double")
    got = {r.feature: r.median for r in profile.exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": float(np.median([r[0] for r in rows])), "b": float(np.median([r[1] for r in rows]))}


def test_nothing_depends_on_exchange_reuse(spark):
    from pyspark.sql import functions as F
    df = spark.range(5000).select((F.col("id") * 7 % 1000 / 8.0).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        out = cumulative(df, [], "v", ["c"], totals=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "aggregate(" not in plan          # no higher-order function, no cut array
        got = {r.v: (r.cum_c, r.tot_c) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {i / 8.0: (5 * (i + 1), 5000) for i in range(1000)}


def test_cumulative_tiebreak_gives_row_ranks(spark):
    from pyspark.sql import functions as F
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"),
                                 F.lit(1).alias("one"))
    got = {r.k: r.cum_one for r in cumulative(df, [], "v", ["one"], n_buckets=3,
                                              tiebreak=["k"], totals=True).collect()}
    expect = {k: i + 1 for i, k in enumerate(sorted(range(300), key=lambda k: (k % 7, k)))}
    assert got == expect


def test_null_order_rows_get_no_sum(spark):
    from pyspark.sql import functions as F
    df = spark.range(1000).select(F.col("id").alias("k"),
                                  F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") * 1.0)
                                  .alias("v"), F.lit(1).alias("one"))
    out = cumulative(df, [], "v", ["one"], n_buckets=4, keep_bucket=True)
    assert out.count() == 1000
    assert out.filter("v IS NULL AND cum_one IS NOT NULL").count() == 0
    assert out.agg(F.max("cum_one")).collect()[0][0] == 666        # non-null rows only
