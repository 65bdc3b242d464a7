"""Null / NaN / arithmetic rules (N1-N14) on tiny literal frames."""

import math

from pyspark.sql import functions as F

from cohortlab.functions.columns import clip, safe_div
from cohortlab.operators import clean, features, metrics, profile


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (0.5,), (5.0,)], "x double")
    got = [r[0] for r in df.select(clip("x", 1.0, 2.0)).collect()]
    assert got == [None, 1.0, 2.0]


def test_age_filter_keeps_null_age(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (40.0,), (151.0,)], "age double")
    got = sorted((r[0] is None, r[0]) for r in clean.age_range_filter(df).collect())
    assert got == [(False, 40.0), (True, None)]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert df.select(safe_div("a", "b")).collect()[0][0] is None


def test_quicki_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "fasting_glucose double, fasting_insulin double")
    assert features.engineer(df).collect()[0]["quicki"] is None


def test_zero_variance_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, ir_label int")
    rows = {r["feature"]: r["corr"] for r in profile.label_correlation(df, cols=["x"]).collect()}
    assert rows["x"] is None


def test_pairwise_deletion(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (None, 1), (3.0, 1)], "x double, ir_label int")
    r = profile.label_correlation(df, cols=["x"]).collect()[0]["corr"]
    # pandas corrwith on the three complete pairs
    xs, ys = [1.0, 2.0, 3.0], [0.0, 1.0, 1.0]
    mx, my = sum(xs) / 3, sum(ys) / 3
    cov = sum((a - mx) * (b - my) for a, b in zip(xs, ys))
    ref = cov / math.sqrt(sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
    assert abs(r - ref) < 1e-12


def test_exact_median_is_mean_of_middle_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    assert profile.column_medians(df, ["x"], exact=True) == {"x": 3.0}


def test_label_is_strict_and_before_clipping(spark):
    # 405 * 2.5 = 1012.5: glucose 1012.5, insulin 1 -> homa exactly 2.5 -> 0
    df = spark.createDataFrame([(1012.5, 1.0), (700.0, 2.0), (None, 3.0)],
                               "fasting_glucose double, fasting_insulin double")
    out = clean.prepare(df).collect()
    assert [r["ir_label"] for r in out] == [0, 1]
    # label used glucose 700 before the clip to 600
    assert out[1]["fasting_glucose"] == 600.0


def test_harmonise_only_when_target_absent(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "Glucose double, `Fasting-Glucose` double, Insulin double")
    out = clean.harmonise_names(df)
    assert out.columns == ["glucose", "fasting_glucose", "fasting_insulin"]


def test_canonicalise_collision_raises(spark):
    import pytest
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a-b` int")
    with pytest.raises(ValueError):
        clean.canonicalize(df)


def test_ece_zero_probability_in_no_bin(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (1, 0.3)], "y int, p double")
    rel = {r["bin"]: r for r in metrics.reliability_bins(df).collect()}
    assert sorted(rel) == [2, 9]          # 0.3 is in (0.2, 0.30000000000000004]
    assert abs(rel[9]["weight"] - 1 / 3) < 1e-12


def test_unknown_column_fill_defaults_to_zero(spark):
    from cohortlab.operators.prep import PrepState, apply_prep
    st = PrepState(["a", "b"], [], {"a": 5.0}, {}, {}, {}, ["a", "b"])
    df = spark.createDataFrame([(None, None)], "a double, b double")
    assert apply_prep(df, st).collect()[0].asDict() == {"a": 5.0, "b": 0.0}


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("12.5",), ("abc",)], "x string")
    assert [r[0] for r in clean.coerce_numeric(df, ["x"]).collect()] == [12.5, None]


def test_feature_hash_is_stable_and_null_aware(spark):
    from cohortlab.functions.columns import feature_hash
    df = spark.createDataFrame([(1.0, None), (1.0, None), (1.0, 0.0)], "a double, b double")
    h = [r[0] for r in df.select(feature_hash("a", "b")).collect()]
    assert h[0] == h[1] != h[2]


def test_missingness_reports_only_missing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    rows = [r.asDict() for r in profile.missingness(df).collect()]
    assert rows == [{"column_name": "b", "n_rows": 2, "n_missing": 2, "all_missing": True}]
    assert F is not None
