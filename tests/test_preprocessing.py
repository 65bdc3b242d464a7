"""Preprocessor on the reference's four-row sample, encoders and selection."""

from cohortlab.operators import features, prep
from cohortlab.operators.select import binned_mi

ROWS = [(100.0, 10.0, 25.0, 40, 150, 50, 90, 100, 0),
        (None, 20.0, 30.0, 50, 200, 40, 100, 105, 1),
        (120.0, None, 28.0, 60, 180, 45, 95, 102, 1),
        (90.0, 8.0, 22.0, 35, 120, 55, 85, 98, 0)]
SCHEMA = ("fasting_glucose double, fasting_insulin double, bmi double, age int, triglycerides int,"
          " hdl_cholesterol int, waist_circumference int, hip_circumference int, ir_label int")


def test_fill_and_selection(spark):
    df = features.engineer(spark.createDataFrame(ROWS, SCHEMA))
    for c in ("quicki", "tg_hdl_ratio", "waist_hip_ratio", "age_bmi", "fasting_glucose_log"):
        assert c in df.columns
    st = prep.fit_prep(df, "ir_label", exact=True, threshold=-1.0)
    out = prep.apply_prep(df, st)
    assert st.selected and out.count() == 4
    assert all(v is not None for r in out.collect() for v in r)
    # insulin filled with its mean (a one-column kNN imputer reduces to the mean)
    assert st.means["fasting_insulin"] == (10.0 + 20.0 + 8.0) / 3


def test_one_hot_and_ordinal(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "c string, d string")
    cats = prep.one_hot_categories(df, ["c"])
    assert cats == {"c": ["a", "b"]}
    oh = prep.one_hot(df, cats).collect()
    assert [(r.c_a, r.c_b) for r in oh] == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    dic = prep.ordinal_dictionary(df, "d", n_buckets=2)
    assert sorted((r.category, r.idx) for r in dic.collect()) == [("x", 0), ("y", 1), ("z", 2)]
    new = spark.createDataFrame([("y",), ("q",)], "d string")
    assert [r.d for r in prep.ordinal(new, "d", dic).collect()] == [1.0, -1.0]


def test_ordinal_dictionary_many_values(spark):
    df = spark.range(5000).selectExpr("concat('v', lpad(CAST(id * 7919 % 5000 AS STRING), 5, '0')) AS s")
    got = {r.category: r.idx for r in prep.ordinal_dictionary(df, "s", n_buckets=8).collect()}
    assert [got[k] for k in sorted(got)] == list(range(5000))


def test_mi_informative_feature_ranks_first(spark):
    from pyspark.sql import functions as F
    df = spark.range(4000).select((F.col("id") % 2).cast("int").alias("y"),
                                  (F.col("id") % 2 * 10 + F.rand(5)).alias("good"),
                                  F.rand(6).alias("noise"))
    mi = {r.feature: r for r in binned_mi(df, "y", ["good", "noise"]).collect()}
    assert mi["good"].selected and mi["good"].mi > 0.5
    assert abs(mi["noise"].mi) < 0.01
