"""Registered queries: cleaning, features and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_out
from ..operators import clean, features, profile
from ..sources.cohort import cohort
from . import frames
from .registry import query
from .sql_text import MEDIANS, PREPARED, engineered_cte, with_ctes

ENG_COLS = features.ENGINEERED
NUMERIC_PREPARED = ("age", "fasting_glucose", "fasting_insulin", "bmi", "triglycerides",
                    "hdl_cholesterol", "waist_circumference", "hip_circumference", "ir_label")


def _corr_sql(cols, src):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, round(covar_pop(x, y) / NULLIF(stddev_pop(x) * stddev_pop(y), 0), 6)"
        f" AS corr FROM (SELECT CASE WHEN ir_label IS NOT NULL THEN CAST({c} AS DOUBLE) END AS x,"
        f" CASE WHEN {c} IS NOT NULL THEN CAST(ir_label AS DOUBLE) END AS y FROM {src})"
        for c in cols)


CORR_COLS = ("age", "fasting_glucose", "fasting_insulin", "bmi", "triglycerides",
             "hdl_cholesterol", "waist_circumference", "hip_circumference", "ir_label", *ENG_COLS)


def _label_correlation_df(spark, sf_dir):
    df = features.engineer(frames.prepared(spark, sf_dir))
    corr = profile.label_correlation(df, "ir_label", key=["patient_id"])
    return corr.select("feature", round_out("corr").alias("corr"))


@query("label_correlation", with_ctes(PREPARED, engineered_cte(),
                                      body=_corr_sql(CORR_COLS, "engineered")))
def label_correlation(spark, sf_dir):
    """Flagship: which measures move with the label (pairwise Pearson, one pass)."""
    return _label_correlation_df(spark, sf_dir)


@query("leakage_report", with_ctes(PREPARED, engineered_cte(), body=(
    "SELECT feature, corr, CAST(count(*) OVER () > 1 AS BOOLEAN) AS beyond_label FROM ("
    + _corr_sql(CORR_COLS, "engineered") + ") WHERE abs(corr) > 0.95")))
def leakage_report(spark, sf_dir):
    corr = _label_correlation_df(spark, sf_dir)
    rep = profile.leakage_report(corr, profile.AUDIT_LEAKAGE_CORR)
    from pyspark.sql import Window
    # window over the filtered report (a handful of rows), flags more than the label itself
    return rep.withColumn("beyond_label", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > 1)


@query("harmonise_names", with_ctes(body=(
    "SELECT patient_id, age, fasting_glucose, fasting_insulin, bmi, triglycerides, hdl_cholesterol,"
    " waist_circumference, hip_circumference, sex, segment, site FROM cohort")))
def harmonise_names(spark, sf_dir):
    df = clean.harmonise_names(frames.raw_cohort(spark, sf_dir))
    return df.drop("ts")


@query("derive_label", with_ctes(body=(
    "SELECT patient_id, fasting_glucose, fasting_insulin,"
    " CAST(fasting_glucose * fasting_insulin / 405.0 > 2.5 AS INTEGER) AS ir_label,"
    " false AS has_construction_column FROM cohort"
    " WHERE fasting_glucose IS NOT NULL AND fasting_insulin IS NOT NULL")))
def derive_label(spark, sf_dir):
    """The label from a table that holds the column it is made of; that column must be gone."""
    df = clean.derive_label(cohort(spark, sf_dir).withColumn("homa_ir", F.lit(1.0)))
    return df.select("patient_id", "fasting_glucose", "fasting_insulin", "ir_label",
                     F.lit("homa_ir" in df.columns).alias("has_construction_column"))


@query("age_range_filter", with_ctes(body=(
    "SELECT patient_id, age FROM cohort WHERE NOT coalesce(age < 0 OR age > 150, false)")))
def age_range_filter(spark, sf_dir):
    return clean.age_range_filter(cohort(spark, sf_dir)).select("patient_id", "age")


@query("clip_labs", with_ctes(body=(
    "SELECT patient_id, CASE WHEN fasting_glucose < 40 THEN 40.0 WHEN fasting_glucose > 600"
    " THEN 600.0 ELSE fasting_glucose END AS fasting_glucose, CASE WHEN fasting_insulin < 0.1"
    " THEN 0.1 ELSE fasting_insulin END AS fasting_insulin FROM cohort")))
def clip_labs(spark, sf_dir):
    return clean.clip_labs(cohort(spark, sf_dir)).select(
        "patient_id", "fasting_glucose", "fasting_insulin")


@query("coerce_numeric", with_ctes(body=(
    "SELECT patient_id, TRY_CAST(CAST(CAST(age AS BIGINT) AS VARCHAR) AS DOUBLE) AS age_text,"
    " TRY_CAST(segment AS DOUBLE) AS segment FROM cohort")))
def coerce_numeric(spark, sf_dir):
    df = cohort(spark, sf_dir).select(
        "patient_id", F.col("age").cast("bigint").cast("string").alias("age_text"), "segment")
    return clean.coerce_numeric(df, ["age_text", "segment"])


@query("range_rule_violations", with_ctes(PREPARED, body=(
    "SELECT 'age' AS column_name, CAST(18.0 AS DOUBLE) AS rule_min, CAST(90.0 AS DOUBLE) AS rule_max,"
    " count(age) AS n_checked, count(CASE WHEN age < 18 THEN 1 END) AS n_below,"
    " count(CASE WHEN age > 90 THEN 1 END) AS n_above FROM prepared"
    " UNION ALL SELECT 'bmi', 15.0, 50.0, count(bmi), count(CASE WHEN bmi < 15 THEN 1 END),"
    " count(CASE WHEN bmi > 50 THEN 1 END) FROM prepared")))
def range_rule_violations(spark, sf_dir):
    return clean.range_rule_violations(frames.prepared(spark, sf_dir))


@query("align_schema", with_ctes(PREPARED, body=(
    "SELECT patient_id, bmi, age, CAST(NULL AS DOUBLE) AS hba1c, '__missing__' AS ethnicity, sex"
    " FROM prepared")))
def align_schema(spark, sf_dir):
    df = frames.prepared(spark, sf_dir)
    return features.align_schema(df, ["bmi", "age", "hba1c"], ["ethnicity", "sex"],
                                 selected=["bmi", "age", "hba1c", "ethnicity", "sex", "not_there"],
                                 keep=["patient_id"])


def _eng_select(rounded=("quicki", "fasting_glucose_log", "fasting_insulin_log",
                         "triglycerides_log")):
    return ", ".join(f"round({c}, 6) AS {c}" if c in rounded else c for c in ENG_COLS)


def _eng_out(df):
    rounded = {"quicki", "fasting_glucose_log", "fasting_insulin_log", "triglycerides_log"}
    return df.select("patient_id", *[round_out(c).alias(c) if c in rounded else F.col(c)
                                     for c in ENG_COLS])


@query("engineer_null_propagating", with_ctes(PREPARED, engineered_cte(), body=(
    f"SELECT patient_id, {_eng_select()} FROM engineered")))
def engineer_null_propagating(spark, sf_dir):
    return _eng_out(frames.engineered(spark, sf_dir, fill=False))


@query("engineer_median_fill", with_ctes(PREPARED, MEDIANS, engineered_cte(fill_from="medians"),
                                         body=f"SELECT patient_id, {_eng_select()} FROM engineered"))
def engineer_median_fill(spark, sf_dir):
    return _eng_out(frames.engineered(spark, sf_dir, fill=True))


@query("drop_leakage_inputs", with_ctes(PREPARED, engineered_cte(), body=(
    "SELECT patient_id, age, bmi, triglycerides, hdl_cholesterol, waist_circumference,"
    " hip_circumference, sex, segment, site, tg_hdl_ratio,"
    " waist_hip_ratio, age_bmi, round(triglycerides_log, 6)"
    " AS triglycerides_log FROM engineered")))
def drop_leakage_inputs(spark, sf_dir):
    df = features.drop_leakage_inputs(frames.engineered(spark, sf_dir)).drop("ts")
    # division is exact IEEE in both engines; only the log is rounded
    return df.select(*[round_out(c).alias(c) if c == "triglycerides_log" else F.col(c)
                       for c in df.columns])


_MISS_COLS = ("patient_id", "ts", "age", "fasting_glucose", "fasting_insulin", "bmi",
              "triglycerides", "hdl_cholesterol", "waist_circumference", "hip_circumference",
              "sex", "segment", "site")


@query("missingness", with_ctes(body=(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing,"
        f" count({c}) = 0 AS all_missing FROM cohort" for c in _MISS_COLS)
    + ") WHERE n_missing > 0")))
def missingness(spark, sf_dir):
    return profile.missingness(cohort(spark, sf_dir))


@query("cardinality_routing", with_ctes(PREPARED, body=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) <= 50 THEN count(DISTINCT {c}) END AS n_distinct,"
    f" CASE WHEN count(DISTINCT {c}) <= 50 THEN 'one_hot' ELSE 'ordinal' END AS encoding FROM prepared"
    for c in ("sex", "segment", "site"))))
def cardinality_routing(spark, sf_dir):
    return profile.cardinality_routing(frames.prepared(spark, sf_dir), ["sex", "segment", "site"])


@query("all_null_columns", with_ctes(body=(
    "SELECT 'empty_lab' AS column_name, count(*) AS n_rows, count(*) AS n_missing, true AS all_missing FROM cohort")))
def all_null_columns(spark, sf_dir):
    """The columns a fit has to prune: an added column that never has a value."""
    df = cohort(spark, sf_dir).withColumn("empty_lab", F.lit(None).cast("double"))
    return profile.missingness(df).filter("all_missing")


@query("label_distribution", with_ctes(PREPARED, body=(
    "SELECT ir_label AS label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share"
    " FROM prepared GROUP BY ir_label")))
def label_distribution(spark, sf_dir):
    return profile.label_distribution(frames.prepared(spark, sf_dir))


@query("column_medians", with_ctes(PREPARED, body=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(median({c}), 6) AS median FROM prepared"
    for c in NUMERIC_PREPARED)))
def column_medians(spark, sf_dir):
    med = profile.exact_medians(frames.prepared(spark, sf_dir), list(NUMERIC_PREPARED))
    return med.select("feature", round_out("median").alias("median"))


_MEAN_COLS = ("age", "fasting_insulin", "bmi", "triglycerides")


@query("mean_fill", with_ctes(body=(
    "SELECT patient_id, " + ", ".join(
        f"round(coalesce({c}, avg({c}) OVER ()), 6) AS {c}" for c in _MEAN_COLS)
    + " FROM cohort")))
def mean_fill(spark, sf_dir):
    df = cohort(spark, sf_dir).select("patient_id", *_MEAN_COLS)
    filled, _ = profile.mean_fill(df, list(_MEAN_COLS))
    return filled.select("patient_id", *[round_out(c).alias(c) for c in _MEAN_COLS])


@query("shape_report", with_ctes(PREPARED, body=(
    "SELECT count(*) AS n_rows, CAST(14 AS BIGINT) AS n_columns FROM prepared")))
def shape_report(spark, sf_dir):
    return profile.shape_report(frames.prepared(spark, sf_dir))
