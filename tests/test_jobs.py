"""Command-line jobs on the small fixture."""

from pyspark.sql import functions as F  # noqa: F401

from cohortlab import jobs

from conftest import SF_SMALL


def test_audit_and_drift_jobs(spark, tmp_path):
    out = str(tmp_path)
    assert jobs.main(["audit", "--input", f"tpch:{SF_SMALL}", "--out", out]) == 0
    corr = spark.read.parquet(f"{out}/audit/label_correlation")
    assert abs(corr.filter("feature = 'ir_label'").collect()[0]["corr"] - 1.0) < 1e-12
    assert jobs.main(["drift", "--reference", f"tpch:{SF_SMALL}", "--new", f"tpch:{SF_SMALL}",
                      "--features", "age,bmi", "--out", out]) == 0
    ks = spark.read.parquet(f"{out}/ks")
    assert ks.count() == 2 and ks.filter("drifted").count() == 0


def test_metrics_job_on_score_table(spark, tmp_path):
    from cohortlab.plans import frames
    src = str(tmp_path / "scores")
    frames.scores(spark, SF_SMALL).write.parquet(src)
    assert jobs.main(["metrics", "--input", src, "--out", str(tmp_path / "m")]) == 0
    m = {r.metric: r.value for r in spark.read.parquet(str(tmp_path / "m/metrics")).collect()}
    assert len(m) == 10 and 0.5 < m["roc_auc"] <= 1.0
    assert spark.read.parquet(str(tmp_path / "m/thresholds")).count() == 3
