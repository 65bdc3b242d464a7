"""Shared DataFrame stages built from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, features, profile
from ..sources.cohort import cohort

# Source-style column names (mixed case, spaces, dashes, short lab names)
RAW_NAMES = {
    "patient_id": "Patient ID", "ts": "TS", "age": "Age", "fasting_glucose": "Glucose",
    "fasting_insulin": "Insulin", "bmi": "BMI", "triglycerides": "Triglycerides",
    "hdl_cholesterol": "HDL-Cholesterol", "waist_circumference": "Waist Circumference",
    "hip_circumference": "Hip-Circumference", "sex": "Sex", "segment": "Segment", "site": "Site",
}


def raw_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort(spark, sf_dir)
    return c.select(*[F.col(n).alias(RAW_NAMES.get(n, n)) for n in c.columns])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort with the derived label, before the age filter and clipping."""
    return clean.derive_label(clean.harmonise_names(cohort(spark, sf_dir)))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.prepare(cohort(spark, sf_dir))


def engineered(spark: SparkSession, sf_dir: str, fill: bool = False,
               exact: bool = True) -> DataFrame:
    df = prepared(spark, sf_dir)
    meds = None
    if fill:
        meds = profile.column_medians(df, [c for c in features.FILL_INPUTS if c in df.columns],
                                      exact=exact)
    return features.engineer(df, meds)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient_id, ts, y, bmi, p): a fixed logistic score of bmi on the labelled cohort."""
    df = labelled(spark, sf_dir).filter(F.col("bmi").isNotNull())
    p = 1.0 / (1.0 + F.exp(-0.25 * (F.col("bmi") - 26.0)))
    return df.select("patient_id", "ts", F.col("ir_label").alias("y"), "bmi", p.alias("p"))


def prediction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log fixture from ``events``: trace_id, ts (timestamp), probability, latency_ms."""
    from ..sources.tables import read_table
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("trace_id"), F.col("ts").cast("timestamp").alias("ts"),
                    (F.col("value") / 500).alias("probability"),
                    (F.col("event_id") % 200).alias("latency_ms"), "event_type", "user_id")
