"""Scoring routing, risk levels and request metrics (reference test cases)."""

from cohortlab.operators import metrics, score


def test_mixed_batch_one_ok_one_failed(spark):
    df = spark.createDataFrame([(1, 45.0, 110.0, 15.0, 27.0), (2, -5.0, 105.0, 20.0, 31.0)],
                               "id long, age double, fasting_glucose double, fasting_insulin double, bmi double")
    s = score.LinearScorer({"bmi": 0.25}, -6.5)
    allr = score.score_all(df, s, "id")
    out = score.batch_outcome(allr).collect()[0]
    assert (out.total_records, out.successful, out.failed) == (2, 1, 1)
    good, bad = score.score(df, s, "id")
    g = good.collect()[0]
    assert 0.0 <= g.probability <= 1.0 and g.risk_level in ("low", "medium", "high")
    assert bad.collect()[0].reason == "age_out_of_range"


def test_missing_required_column_is_quarantined_not_fatal(spark):
    df = spark.createDataFrame([(1, 45.0, 27.0)], "id long, age double, bmi double")
    r = score.score_all(df, score.LinearScorer({"bmi": 0.1}), "id").collect()[0]
    assert r.status == "quarantined" and r.reason == "missing_fasting_glucose"


def test_external_guard_on_one_class(spark):
    import pytest
    df = spark.createDataFrame([(1, 0.9), (1, 0.2)], "y int, p double")
    r = metrics.validate_external(df, 0.8).collect()[0]
    assert (r.passed, r.status, r.roc_auc) == (False, "undefined", None)
    with pytest.raises(RuntimeError):
        metrics.validate_external(df, 0.8, raise_on_fail=True)


def test_risk_levels(spark):
    from cohortlab.functions.columns import risk_level
    df = spark.createDataFrame([(0.1,), (0.33,), (0.66,), (0.67,)], "p double")
    assert [r[0] for r in df.select(risk_level("p")).collect()] == ["low", "medium", "medium", "high"]


def test_request_metrics(spark):
    df = spark.createDataFrame([(0.2, 50), (0.8, 150)], "probability double, latency_ms int")
    m = metrics.request_metrics(df).collect()[0]
    assert (m.requests_total, m.avg_prob, m.avg_latency_ms) == (2, 0.5, 100.0)
    empty = metrics.request_metrics(df.limit(0)).collect()[0]
    assert (empty.requests_total, empty.avg_prob, empty.avg_latency_ms) == (0, 0.0, 0.0)


def test_missing_key_counts_as_zero(spark):
    df = spark.createDataFrame([(0.2, None), (None, 100)], "probability double, latency_ms int")
    m = metrics.request_metrics(df).collect()[0]
    assert (m.avg_prob, m.avg_latency_ms) == (0.1, 50.0)
