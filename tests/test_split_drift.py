"""Splits, folds, samples, bootstrap and KS drift invariants."""

from pyspark.sql import functions as F

from cohortlab.operators import drift, split


def _keys(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))


def test_hash_split_deterministic_and_shares(spark):
    df = _keys(spark)
    a = {r.k: r.split for r in split.hash_split(df, "k").collect()}
    b = {r.k: r.split for r in split.hash_split(df, "k").collect()}
    assert a == b
    share = sum(v == "test" for v in a.values()) / len(a)
    assert 0.12 < share < 0.18


def test_exact_split_counts(spark):
    df = _keys(spark)
    out = split.exact_split(df, "k", "y").groupBy("y", "split").count().collect()
    n = {(r.y, r.split): r["count"] for r in out}
    for y, total in ((1, 1000), (0, 2000)):
        assert n[(y, "test")] == round(total * 0.15)
        assert n[(y, "validation")] == round(total * 0.15)


def test_fold_sizes_within_ten_percent(spark):
    df = _keys(spark)
    sizes = [r["count"] for r in split.hash_folds(df, "k", 5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and all(abs(s - 600) <= 60 for s in sizes)


def test_reference_sample_size(spark):
    assert split.reference_sample(_keys(spark), "k", 200).count() == 200


def test_bootstrap_prevalence_close(spark):
    rows = split.poisson_bootstrap(_keys(spark), "k", "y", 3).collect()
    assert len(rows) == 3 and max(r.abs_diff for r in rows) < 0.05


def test_ordered_split_train_before_test(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("v"))
    s = split.ordered_split(df, "v", 0.7)
    mx = s.filter("split = 'train'").agg(F.max("v")).collect()[0][0]
    mn = s.filter("split = 'test'").agg(F.min("v")).collect()[0][0]
    assert mx <= mn and s.filter("split = 'train'").count() == 700


def test_ks_identical_and_shifted(spark):
    ref = spark.range(500).select((F.col("id") / 10.0).alias("x"))
    same = drift.ks_drift(ref, ref, ["x"]).collect()[0]
    assert same.d == 0.0 and not same.drifted
    far = ref.select((F.col("x") + 1000.0).alias("x"))
    shifted = drift.ks_drift(ref, far, ["x"]).collect()[0]
    assert shifted.d == 1.0 and shifted.drifted


def test_ks_skips_absent_and_empty(spark):
    ref = spark.createDataFrame([(1.0, None)], "x double, z double")
    new = spark.createDataFrame([(2.0, None)], "x double, z double")
    feats = {r.feature for r in drift.ks_drift(ref, new, ["x", "z", "missing"]).collect()}
    assert feats == {"x"}


def test_alerts_empty_when_no_drift(spark):
    ref = spark.range(100).select((F.col("id") * 1.0).alias("x"))
    assert drift.drift_alerts(drift.ks_drift(ref, ref, ["x"])).count() == 0


def test_ks_counts_a_bounded_number_of_values_a_task(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.sqrt("id")).alias("b"))
    shifted = df.filter("a >= 500")
    want = sorted(map(tuple, drift.ks_drift(df, shifted, ["a", "b"]).collect()))
    monkeypatch.setattr(drift, "VALUES_PER_TASK", 500)
    parts = drift.dealt(df.coalesce(1), ["a", "b"])
    assert parts.rdd.getNumPartitions() == 12 and max(len(p) for p in parts.rdd.glom().collect()) <= 2 * 500
    assert sorted(map(tuple, drift.ks_drift(df, shifted, ["a", "b"]).collect())) == want
