"""Trained-stack invariants on the small cohort (few rounds, three folds)."""

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import isotonic
from cohortlab.plans import frames
from cohortlab.plans.training import TrainConfig, load_bundle, save_bundle, train

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def run(spark):
    cfg = TrainConfig(max_iter=3, oof_folds=3)
    return train(frames.prepared(spark, SF_SMALL), cfg)


def test_one_oof_score_per_key_and_model(run):
    bundle, _ = run
    oof = bundle.extras["oof"]
    p_cols = [c for c in oof.columns if c.startswith("p_")]
    assert len(p_cols) == 4
    assert oof.count() == oof.select("patient_id").distinct().count()
    assert oof.filter(" OR ".join(f"{c} IS NULL" for c in p_cols)).count() == 0


def test_probabilities_in_unit_interval(run, spark):
    bundle, val = run
    r = val.agg(F.min("p_cal"), F.max("p_cal"), F.count(F.lit(1))).collect()[0]
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] > 0
    scored = bundle.score(frames.prepared(spark, SF_SMALL).limit(50))
    assert scored.filter("probability IS NULL OR probability < 0 OR probability > 1").count() == 0


def test_isotonic_is_monotone(spark):
    df = spark.range(400).select((F.col("id") / 400.0).alias("p"),
                                 ((F.col("id") % 7) < (F.col("id") / 60)).cast("int").alias("y"))
    m = isotonic.fit_steps(df, "p", "y")
    out = [r.c for r in isotonic.apply_steps(df, m, "p", ["c"]).orderBy("p").collect()]
    assert all(a <= b for a, b in zip(out, out[1:]))


def test_bundle_round_trip(run, spark, tmp_path):
    bundle, _ = run
    save_bundle(bundle, spark, str(tmp_path / "bundle"))
    back = load_bundle(spark, str(tmp_path / "bundle"))
    x = frames.prepared(spark, SF_SMALL).limit(40)
    a = {r.patient_id: r.probability for r in bundle.score(x).collect()}
    b = {r.patient_id: r.probability for r in back.score(x).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert back.thresholds == bundle.thresholds
