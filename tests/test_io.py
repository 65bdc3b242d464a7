"""Sources and sinks: CSV scan, quarantine of malformed lines, metric appends, alerts."""

import pytest
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cohortlab.sources import io


def test_missing_csv_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.read_cohort_csv(spark, str(tmp_path / "nope.csv"))


def test_csv_header_names_canonicalised_and_bad_lines_kept(spark, tmp_path):
    p = tmp_path / "batch.csv"
    p.write_text("Patient ID,Age,Fasting Glucose\n1,45,110\n2,-5,105\n3,abc,\n")
    df = io.read_cohort_csv(spark, str(p))
    assert df.columns == ["patient_id", "age", "fasting_glucose"]
    schema = StructType([StructField("patient_id", LongType()), StructField("age", DoubleType()),
                         StructField("fasting_glucose", DoubleType())])
    typed = io.read_cohort_csv(spark, str(p), schema, quarantine_column="_bad").cache()
    rows = {r.patient_id: r for r in typed.collect()}
    assert rows[1].age == 45.0 and rows[1]._bad is None
    assert rows[3].age is None and rows[3]._bad == "3,abc,"


def test_csv_columns_are_found_by_name_and_nan_is_missing(spark, tmp_path):
    p = tmp_path / "batch.csv"
    p.write_text("BMI,Age\n30,55\nNaN,40\n")
    schema = StructType([StructField("age", DoubleType()), StructField("bmi", DoubleType()), StructField("ts", LongType())])
    assert [tuple(r) for r in io.read_cohort_csv(spark, str(p), schema).collect()] == [(55.0, 30.0, None), (40.0, None, None)]


def test_metric_appends_stay_apart(spark, tmp_path):
    m = spark.createDataFrame([("auc", 0.8)], "metric string, value double")
    for run in ("r1", "r2"):
        io.append_metrics(m, str(tmp_path / "m"), run, model="x")
    back = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(r.run_id for r in back.collect()) == ["r1", "r2"]


def test_empty_alerts_write_no_rows(spark, tmp_path):
    a = spark.createDataFrame([], "drift_features array<string>, n_drifted long")
    io.append_alerts(a, str(tmp_path / "alerts"))
    assert spark.read.schema("drift_features array<string>, n_drifted long") \
        .json(str(tmp_path / "alerts")).count() == 0
