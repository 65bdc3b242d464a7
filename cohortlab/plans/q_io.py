"""Registered queries: request metrics, metric tables, external guard, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.columns import round_out
from ..operators import metrics, split
from ..session import scratch_path
from ..sources import io
from ..sources.cohort import cohort
from . import frames
from .q_eval import _REL_SQL
from .registry import query
from .sql_text import LABELLED, SCORES, split_hash, with_ctes

R = round_out

PE = """
pe AS (SELECT event_id AS trace_id, ts, value / 500 AS probability, event_id % 200 AS latency_ms,
         event_type FROM events)"""


@query("request_metrics", with_ctes(PE, body=(
    "SELECT count(*) AS requests_total, round(coalesce(avg(coalesce(probability, 0.0)), 0.0), 6)"
    " AS avg_prob, round(coalesce(avg(coalesce(CAST(latency_ms AS DOUBLE), 0.0)), 0.0), 6)"
    " AS avg_latency_ms FROM pe")))
def request_metrics(spark, sf_dir):
    m = metrics.request_metrics(frames.prediction_events(spark, sf_dir))
    return m.select("requests_total", R("avg_prob").alias("avg_prob"),
                    R("avg_latency_ms").alias("avg_latency_ms"))


@query("last_n_metrics", with_ctes(PE, body=(
    "SELECT count(*) AS requests_total, round(avg(probability), 6) AS avg_prob,"
    " round(avg(CAST(latency_ms AS DOUBLE)), 6) AS avg_latency_ms FROM"
    " (SELECT * FROM pe ORDER BY ts DESC, trace_id DESC LIMIT 500)")))
def last_n_metrics(spark, sf_dir):
    recent = metrics.last_n(frames.prediction_events(spark, sf_dir), 500)
    m = metrics.request_metrics(recent)
    return m.select("requests_total", R("avg_prob").alias("avg_prob"),
                    R("avg_latency_ms").alias("avg_latency_ms"))


@query("event_type_metrics", with_ctes(PE, body=(
    "SELECT event_type, count(*) AS requests_total, round(avg(probability), 6) AS avg_prob,"
    " round(avg(CAST(latency_ms AS DOUBLE)), 6) AS avg_latency_ms FROM pe GROUP BY event_type")))
def event_type_metrics(spark, sf_dir):
    m = metrics.request_metrics(frames.prediction_events(spark, sf_dir), by=["event_type"])
    return m.select("event_type", "requests_total", R("avg_prob").alias("avg_prob"),
                    R("avg_latency_ms").alias("avg_latency_ms"))


# ---------------------------------------------------------------- metric tables

_CURVE_ALL = """
counts AS (SELECT p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
           FROM scores GROUP BY p),
curve AS (SELECT p, pos, neg,
            sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
            sum(neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp,
            sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM counts),
cm AS (SELECT count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS tp,
              count(CASE WHEN p >= 0.5 AND y = 0 THEN 1 END) AS fp,
              count(CASE WHEN p < 0.5 AND y = 1 THEN 1 END) AS fn,
              count(CASE WHEN p < 0.5 AND y = 0 THEN 1 END) AS tn FROM scores)"""

_EVAL_BODY = """
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'accuracy' AS metric, (tp + tn) / (tp + fp + fn + tn) AS value FROM cm
  UNION ALL SELECT 'precision', coalesce(tp / NULLIF(tp + fp, 0), 0.0) FROM cm
  UNION ALL SELECT 'recall', coalesce(tp / NULLIF(tp + fn, 0), 0.0) FROM cm
  UNION ALL SELECT 'f1', coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) FROM cm
  UNION ALL SELECT 'mcc', coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / NULLIF(sqrt((tp + fp)::DOUBLE
    * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0) FROM cm
  UNION ALL SELECT 'roc_auc', CAST(sum(CAST(neg AS HUGEINT) * (2 * (tp - pos) + pos)) AS DOUBLE)
    / (2.0 * max(n_pos) * max(n_neg)) FROM curve
  UNION ALL SELECT 'pr_auc', sum(CASE WHEN tp - pos < n_pos THEN pos / n_pos * (tp / (tp + fp)
    + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0 ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2.0
    ELSE 0.0 END) FROM curve
  UNION ALL SELECT 'average_precision', sum(pos / n_pos * (tp / (tp + fp))) FROM curve
  UNION ALL SELECT 'brier_score', avg(pow(p - y, 2)) FROM scores
  UNION ALL SELECT 'ece', sum(abs(bin_acc - bin_conf) * weight) FROM rel)"""


@query("evaluate_metrics", with_ctes(LABELLED, SCORES, _CURVE_ALL, _REL_SQL, body=_EVAL_BODY))
def evaluate_metrics(spark, sf_dir):
    e = metrics.evaluate(frames.scores(spark, sf_dir))
    return e.select("metric", R("value").alias("value"))


def _split_case():
    h = split_hash()
    return f"CASE WHEN {h} < 0.15 THEN 'test' WHEN {h} < 0.3 THEN 'validation' ELSE 'train' END"


@query("union_metrics", with_ctes(LABELLED, SCORES, f"""
sp AS (SELECT *, {_split_case()} AS split FROM scores),
cm2 AS (SELECT split, count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS tp,
          count(CASE WHEN p >= 0.5 AND y = 0 THEN 1 END) AS fp,
          count(CASE WHEN p < 0.5 AND y = 1 THEN 1 END) AS fn,
          count(CASE WHEN p < 0.5 AND y = 0 THEN 1 END) AS tn FROM sp GROUP BY split
        UNION ALL
        SELECT 'all', count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END),
          count(CASE WHEN p >= 0.5 AND y = 0 THEN 1 END), count(CASE WHEN p < 0.5 AND y = 1 THEN 1 END),
          count(CASE WHEN p < 0.5 AND y = 0 THEN 1 END) FROM sp)""", body=(
    "SELECT split, metric, round(value, 6) AS value FROM ("
    "SELECT split, 'accuracy' AS metric, (tp + tn) / (tp + fp + fn + tn) AS value FROM cm2"
    " UNION ALL SELECT split, 'precision', coalesce(tp / NULLIF(tp + fp, 0), 0.0) FROM cm2"
    " UNION ALL SELECT split, 'recall', coalesce(tp / NULLIF(tp + fn, 0), 0.0) FROM cm2"
    " UNION ALL SELECT split, 'f1', coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) FROM cm2)")))
def union_metrics(spark, sf_dir):
    s = split.hash_split(frames.scores(spark, sf_dir), "patient_id")

    def long(tm):
        keys = [c for c in tm.columns if c not in ("tp", "fp", "fn", "tn", "accuracy", "precision",
                                                   "recall", "f1", "mcc")]
        return tm.selectExpr(*keys, "stack(4, 'accuracy', accuracy, 'precision', precision,"
                                    " 'recall', recall, 'f1', f1) AS (metric, value)")
    per = long(metrics.threshold_metrics(s, by=["split"]))
    overall = long(metrics.threshold_metrics(s)).withColumn("split", F.lit("all"))
    u = per.unionByName(overall, allowMissingColumns=True)
    return u.select("split", "metric", R("value").alias("value"))


@query("external_guard", with_ctes(LABELLED, SCORES, f"""
sp0 AS (SELECT *, {_split_case()} AS split FROM scores),
sp AS (SELECT 'validation' AS split, y, p FROM sp0 WHERE split = 'validation'
       UNION ALL SELECT 'as_is', y, p FROM sp0 WHERE split = 'test'
       UNION ALL SELECT 'reversed', y, 1 - p FROM sp0 WHERE split = 'test'
       UNION ALL SELECT 'one_class', y, p FROM sp0 WHERE split = 'test' AND y = 1),
gcounts AS (SELECT split, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
            FROM sp GROUP BY split, p),
gcurve AS (SELECT split, pos, neg,
  sum(pos) OVER (PARTITION BY split ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(pos) OVER (PARTITION BY split) AS n_pos, sum(neg) OVER (PARTITION BY split) AS n_neg FROM gcounts),
gauc AS (SELECT split, CAST(sum(CAST(neg AS HUGEINT) * (2 * (tp - pos) + pos)) AS DOUBLE)
  / NULLIF(2.0 * max(n_pos) * max(n_neg), 0) AS roc_auc FROM gcurve GROUP BY split),
gsum AS (SELECT split, avg(pow(p - y, 2)) AS brier_score,
  avg(CASE WHEN y = CAST(p >= 0.5 AS INTEGER) THEN 1.0 ELSE 0.0 END) AS accuracy FROM sp GROUP BY split)""", body=(
    "SELECT t.split AS cohort_name, round(t.roc_auc, 6) AS roc_auc, round(b.brier_score, 6) AS brier_score,"
    " round(b.accuracy, 6) AS accuracy, round(v.roc_auc, 6) AS baseline_auc,"
    " round(v.roc_auc - t.roc_auc, 6) AS auc_drop, coalesce(v.roc_auc - t.roc_auc <= 0.1, false) AS passed,"
    " CASE WHEN t.roc_auc IS NULL THEN 'undefined' WHEN v.roc_auc - t.roc_auc <= 0.1 THEN 'pass' ELSE 'fail' END"
    " AS status FROM gauc t JOIN gsum b ON t.split = b.split, gauc v"
    " WHERE t.split <> 'validation' AND v.split = 'validation'")))
def external_guard(spark, sf_dir):
    """Three cohorts against the validation AUC: the test split, its scores turned round, its positives alone."""
    s = split.hash_split(frames.scores(spark, sf_dir), "patient_id")
    base = metrics.auc_by(s.filter("split = 'validation'"), []).scalar()
    test = s.filter("split = 'test'").select("y", "p", F.explode(F.array(
        F.lit("as_is"), F.lit("reversed"), F.lit("one_class"))).alias("cohort_name"))
    cases = test.filter("cohort_name <> 'one_class' OR y = 1").withColumn(
        "p", F.when(F.col("cohort_name") == "reversed", 1 - F.col("p")).otherwise(F.col("p")))
    out = metrics.validate_external(cases, base, by=["cohort_name"])
    return out.select("cohort_name", *[R(c).alias(c) for c in ("roc_auc", "brier_score", "accuracy",
                                                "baseline_auc", "auc_drop")], "passed", "status")


# ---------------------------------------------------------------- sources and sinks

CSV_SCHEMA = StructType([
    StructField("patient_id", LongType()), StructField("age", DoubleType()),
    StructField("fasting_glucose", DoubleType()), StructField("fasting_insulin", DoubleType()),
    StructField("bmi", DoubleType()), StructField("sex", StringType()),
    StructField("segment", StringType())])


@query("csv_scan", with_ctes(body=(
    "SELECT patient_id, age, fasting_glucose, fasting_insulin, bmi, sex, segment FROM cohort")))
def csv_scan(spark, sf_dir):
    """Cohort written as header CSV, columns in another order under source-style names; read back by schema."""
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    names = list(reversed(CSV_SCHEMA.fieldNames()))
    io.write_csv(cohort(spark, sf_dir).select(*[F.col(c).alias(c.replace("_", "-").title()) for c in names]), path)
    return io.read_cohort_csv(spark, path, CSV_SCHEMA)


@query("csv_quarantine", with_ctes(body=(
    "SELECT patient_id, CASE WHEN patient_id % 50 = 0 THEN NULL ELSE age END AS age, bmi,"
    " patient_id % 50 = 0 AS malformed FROM cohort")))
def csv_quarantine(spark, sf_dir):
    """Batch CSV in which every fiftieth line has an unreadable age: the line is kept and marked, the batch goes on."""
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    c = cohort(spark, sf_dir).select("bmi", F.when(F.col("patient_id") % 50 == 0, F.lit("n/a")).otherwise(
        F.col("age").cast("string")).alias("age"), "patient_id")
    io.write_csv(c, path)
    schema = StructType([f for f in CSV_SCHEMA if f.name in ("patient_id", "age", "bmi")])
    df = io.read_cohort_csv(spark, path, schema, quarantine_column="_line")
    return df.select("patient_id", "age", "bmi", F.col("_line").isNotNull().alias("malformed"))


@query("nan_is_missing", with_ctes(body=(
    "SELECT 'bmi' AS column_name, count(*) - count(x) AS n_missing, median(x) AS median, round(avg(x), 6) AS mean,"
    " round(corr(x, g), 6) AS corr FROM (SELECT CASE WHEN patient_id % 7 = 0 THEN NULL ELSE bmi END AS x,"
    " fasting_glucose AS g FROM cohort)")))
def nan_is_missing(spark, sf_dir):
    """bmi with NaN in place of every seventh value: counted, left out of median, mean and correlation."""
    from ..operators import profile
    c = cohort(spark, sf_dir).select("patient_id", "fasting_glucose", F.when(
        F.col("patient_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("bmi")).alias("bmi"))
    miss = profile.missingness(c, ["bmi"]).select("column_name", "n_missing")
    med = profile.exact_medians(c, ["bmi"]).select(F.col("feature").alias("column_name"), "median")
    corr = profile.label_correlation(c, "fasting_glucose", ["bmi"]).select(F.col("feature").alias("column_name"), "corr")
    mean = profile.column_means(c, ["bmi"])["bmi"]
    return miss.join(med, "column_name").join(corr, "column_name").select(
        "column_name", "n_missing", "median", R(F.lit(mean)).alias("mean"), R("corr").alias("corr"))


@query("metrics_append", with_ctes(LABELLED, SCORES, _CURVE_ALL, _REL_SQL, body=(
    "SELECT e.metric, e.value, r.run_id, 'bmi_logistic' AS model FROM (" + _EVAL_BODY + ") e"
    " CROSS JOIN (VALUES ('run-a'), ('run-b')) r(run_id)")))
def metrics_append(spark, sf_dir):
    """Two runs appended to one metric table stay apart by run_id."""
    path = scratch_path(spark, f"metrics-{uuid.uuid4().hex}")
    e = metrics.evaluate(frames.scores(spark, sf_dir)).select("metric", R("value").alias("value"))
    for run in ("run-a", "run-b"):
        io.append_metrics(e, path, run, model="bmi_logistic")
    return spark.read.parquet(path).select("metric", "value", "run_id", "model")


@query("event_log", with_ctes(PE, body=(
    "SELECT CAST(ts AS DATE) AS event_date, count(*) AS requests_total,"
    " round(avg(probability), 6) AS avg_prob, round(avg(CAST(latency_ms AS DOUBLE)), 6) AS avg_latency_ms"
    " FROM pe GROUP BY CAST(ts AS DATE)")))
def event_log(spark, sf_dir):
    """Prediction log appended partitioned by event date, read back whole: daily metrics.

    (A read of one date prunes to that partition; see tests.)"""
    path = scratch_path(spark, f"events-{uuid.uuid4().hex}")
    io.write_events(frames.prediction_events(spark, sf_dir), path)
    m = metrics.request_metrics(spark.read.parquet(path), by=["event_date"])
    return m.select("event_date", "requests_total", R("avg_prob").alias("avg_prob"),
                    R("avg_latency_ms").alias("avg_latency_ms"))
