"""Running metrics, scored and drift streams as jobs, and no table left in the shared folder by a batch."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from cohortlab import jobs
from cohortlab.operators import score
from cohortlab.operators.drift import value_counts
from cohortlab.session import materialise, scratch_path, temporary_tables
from cohortlab.streaming import events as ev
from cohortlab.streaming import recent

from conftest import SF_SMALL

EVENT = "trace_id long, ts timestamp, probability double, latency_ms double"


def event(i, minute, p, latency=10.0):
    at = None if minute is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    return (i, at, p, latency)


def metrics_of(spark, out):
    return {r.batch_id: (r.requests_total, r.avg_prob, r.avg_latency_ms) for r in spark.read.parquet(f"{out}/metrics").collect()}


def left(spark):
    folder = scratch_path(spark, "").rstrip("/").removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith(("ranges-", "neighbour-"))}


def test_newest_rows_by_time_whatever_arrives_first(spark, tmp_path):
    out = str(tmp_path / "out")
    sink = recent.recent_sink(out, keep=3)
    sink(spark.createDataFrame([event(1, 50, 0.1), event(2, 10, 0.9), event(3, None, 0.5), event(4, 40, 0.2)], EVENT), 0)
    sink(spark.createDataFrame([event(5, 20, 0.8), event(6, 60, None, None)], EVENT), 1)
    sink(spark.createDataFrame([], EVENT), 2)
    sink(spark.createDataFrame([event(7, 60, 1.0)], EVENT), 3)
    got = metrics_of(spark, out)
    assert got[0] == (3, pytest.approx(0.4), 10.0)                       # ids 1, 4, 2; the one without a time is oldest
    assert got[1] == got[2] == (3, pytest.approx(0.1), pytest.approx(20 / 3))      # ids 6, 1, 4
    assert got[3] == (3, pytest.approx(1.1 / 3), pytest.approx(20 / 3))            # ids 7, 6, 1
    sink(spark.createDataFrame([event(7, 60, 1.0)], EVENT), 3)            # the same batch again
    assert metrics_of(spark, out)[3] == got[3]
    assert sorted(os.listdir(f"{out}/recent")) == ["batch_id=2", "batch_id=3"]


def test_empty_first_batch_and_missing_predecessor(spark, tmp_path):
    out = str(tmp_path / "out")
    sink = recent.recent_sink(out)
    sink(spark.createDataFrame([], EVENT), 0)
    assert metrics_of(spark, out)[0] == (0, 0.0, 0.0)
    with pytest.raises(Exception):
        sink(spark.createDataFrame([event(1, 1, 0.5)], EVENT), 5)


def test_ten_drift_batches_leave_no_table(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    reference = spark.range(300).select((F.col("id") / 300.0).alias("v"))
    stored = str(tmp_path / "reference")
    value_counts(reference, ["v"]).write.parquet(stored)
    sink = ev.drift_sink(spark.read.parquet(stored), str(tmp_path / "out"), min_rows=5)
    before = left(spark)
    for b in range(10):
        rows = [(start + datetime.timedelta(days=b), "v", float(i), 1) for i in range(20)]
        rows.append((start + datetime.timedelta(days=b), ev.ALL_ROWS, 0.0, 20))
        sink(spark.createDataFrame(rows, "window_start timestamp, feature string, value double, n long"), b)
    assert left(spark) == before
    assert spark.read.parquet(str(tmp_path / "out/alerts")).count() == 10


def test_temporary_tables_nest_and_survive_errors(spark):
    before = left(spark)
    with pytest.raises(RuntimeError), temporary_tables(spark):
        materialise(spark.range(3).toDF("a"), "ranges")
        with temporary_tables(spark):
            materialise(spark.range(3).toDF("a"), "ranges")
            assert len(left(spark) - before) == 2
        assert len(left(spark) - before) == 1
        raise RuntimeError
    assert left(spark) == before


def test_scored_stream_equals_batch(spark, tmp_path):
    """Three files, a restart between them; scores, quarantine and running metrics as in one batch."""
    schema = "id long, ts timestamp, value double"
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), None if i % 10 == 0 else float(i)) for i in range(90)]
    scorer = score.LinearScorer({"value2": 0.05}, intercept=-2.0)
    kw = dict(threshold=0.4, model_version="v3", ts="ts", features=("value2",), required=("value2",))

    def prepare(df):
        return df.withColumn("value2", F.col("value") * 2)
    out, src = str(tmp_path / "out"), str(tmp_path / "src")
    sink = ev.scored_sink(prepare, scorer, f"{out}/scored", "id", then=[recent.recent_sink(out, keep=20)], **kw)
    for k in range(3):
        spark.createDataFrame(rows[30 * k:30 * k + 30], schema).coalesce(1).write.mode("append").parquet(src)
        ev.run_batches(spark.readStream.schema(schema).parquet(src), sink, str(tmp_path / "ck"))
    want = score.score_all(prepare(spark.createDataFrame(rows, schema)), scorer, "id", **kw).drop("ts")
    got = spark.read.parquet(f"{out}/scored").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    m = metrics_of(spark, out)
    assert sorted(m) == [0, 1, 2]
    newest = want.filter("status = 'scored'").orderBy(F.col("id").desc()).limit(20).agg(F.avg("probability")).first()[0]
    assert m[2][0] == 20 and m[2][1] == pytest.approx(newest)


def test_stream_score_job_with_a_trained_bundle(spark, tmp_path):
    from cohortlab.plans import frames
    from cohortlab.plans.training import TrainConfig, save_bundle, train
    from cohortlab.sources.cohort import cohort
    bundle, _ = train(frames.prepared(spark, SF_SMALL), TrainConfig(max_iter=2, oof_folds=2))
    save_bundle(bundle, spark, str(tmp_path / "bundle"))
    raw, src, out = cohort(spark, SF_SMALL), str(tmp_path / "src"), str(tmp_path / "out")
    for k in range(2):
        raw.filter(F.col("patient_id") % 2 == k).coalesce(1).write.mode("append").parquet(src)
        assert jobs.main(["stream-score", "--input", src, "--bundle", str(tmp_path / "bundle"), "--out", out]) == 0
    assert jobs.main(["score", "--input", src, "--bundle", str(tmp_path / "bundle"), "--out", str(tmp_path / "batch")]) == 0
    a = {r.patient_id: (r.status, r.probability) for r in spark.read.parquet(f"{out}/scored").collect()}
    b = {r.patient_id: (r.status, r.probability) for r in spark.read.parquet(str(tmp_path / "batch/scored")).collect()}
    assert a.keys() == b.keys() and len(a) == raw.count()
    assert all(a[i][0] == b[i][0] and a[i][1] == pytest.approx(b[i][1]) for i in a)
    assert metrics_of(spark, out)[1][0] == min(500, sum(s == "scored" for s, _ in a.values()))


def test_stream_drift_job_windows_and_ring(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    ref, src = str(tmp_path / "ref"), str(tmp_path / "src")
    spark.range(400).select(F.col("id").alias("patient_id"), (F.col("id") / 400.0).alias("v")).write.parquet(ref)
    rows = [(i, start + datetime.timedelta(minutes=10 * i), "s", (i * 61 % 144) / 144.0 + (2.0 if 144 <= i < 288 else 0.0)) for i in range(500)]
    spark.createDataFrame(rows, "patient_id long, ts timestamp, origin string, v double").write.parquet(src)
    common = ["stream-drift", "--input", src, "--reference", ref, "--features", "v"]
    before = left(spark)
    assert jobs.main([*common, "--out", str(tmp_path / "w")]) == 0
    alerts = spark.read.parquet(str(tmp_path / "w/alerts")).collect()
    assert [str(r.window_start) for r in alerts] == ["2024-01-02 00:00:00"] and alerts[0].drift_features == ["v"]
    assert jobs.main([*common, "--source", "origin", "--out", str(tmp_path / "r")]) == 0
    ring = [r.ts for r in spark.read.parquet(str(tmp_path / "r/ring_alerts")).collect()]
    assert ring and all(t >= rows[144][1] for t in ring)
    assert left(spark) == before
