"""Batch / stream parity and replay safety on the small event table."""

from pyspark.sql import functions as F

from cohortlab.operators import metrics
from cohortlab.operators.drift import value_counts
from cohortlab.plans import frames
from cohortlab.streaming import events as ev

from conftest import SF_SMALL

EVENTS = f"{SF_SMALL}/events.parquet"


def test_windowed_metrics_match_batch_for_closed_windows(spark, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    s = ev.windowed_metrics(ev.to_predictions(ev.read_event_stream(spark, EVENTS)))
    ev.run_to_table(s, out, ck)
    got = {r.window_start: r.requests_total for r in spark.read.parquet(out).collect()}
    pe = frames.prediction_events(spark, SF_SMALL)
    mx = pe.agg(F.max("ts")).collect()[0][0]
    batch = metrics.request_metrics(pe.withColumn("d", F.date_trunc("day", "ts")), by=["d"]).collect()
    import datetime
    exp = {r.d.replace(tzinfo=None): r.requests_total for r in batch
           if r.d + datetime.timedelta(days=1) <= mx - datetime.timedelta(hours=1)}
    assert got == exp and len(got) > 0


def test_rerun_with_same_checkpoint_adds_nothing(spark, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    p = ev.to_predictions(ev.read_event_stream(spark, EVENTS))
    ev.run_to_table(p, out, ck)
    n1 = spark.read.parquet(out).count()
    ev.run_to_table(ev.to_predictions(ev.read_event_stream(spark, EVENTS)), out, ck)
    assert spark.read.parquet(out).count() == n1 == frames.prediction_events(spark, SF_SMALL).count()


def test_replay_is_deduplicated(spark, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    a = ev.to_predictions(ev.read_event_stream(spark, EVENTS))
    b = ev.to_predictions(ev.read_event_stream(spark, EVENTS))
    ev.run_to_table(ev.dedup(a.unionByName(b)), out, ck)
    df = spark.read.parquet(out)
    assert df.count() == df.select("trace_id").distinct().count() == \
        frames.prediction_events(spark, SF_SMALL).count()


def _events(spark, rows):
    return spark.createDataFrame([(k, t, 1, "view", v, "{}") for k, t, v in rows], ev.EVENT_SCHEMA)


def test_drift_window_split_over_batches_and_runs(spark, tmp_path):
    """40 + 40 drifted rows of one window in two runs alert once; a window of 40 rows is never tested."""
    import datetime
    d = datetime.datetime
    ref = value_counts(ev.to_predictions(_events(spark, [(i, d(2024, 1, 1), float(i)) for i in range(100)])), ["probability"])
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    parts = [[(i, d(2024, 1, 2, 1), 400.0 + i) for i in range(40)],
             [(100 + i, d(2024, 1, 2, 2), 400.0 + i) for i in range(40)] + [(200 + i, d(2024, 1, 3, 1), 400.0 + i) for i in range(40)],
             [(300, d(2024, 1, 5), 1.0)], [(301, d(2024, 1, 6), 1.0)]]
    for rows in parts:
        _events(spark, rows).coalesce(1).write.mode("append").parquet(src)
        ev.run_drift(ev.window_counts(ev.to_predictions(ev.read_event_stream(spark, src)), ["probability"]),
                     ev.drift_sink(ref, out), ck)
    ks = spark.read.parquet(f"{out}/ks").collect()
    assert [(r.window_start, r.n_new, r.drifted) for r in ks] == [(d(2024, 1, 2), 80, True)]
    alerts = spark.read.parquet(f"{out}/alerts").collect()
    assert [(r.window_start, r.drift_features) for r in alerts] == [(d(2024, 1, 2), ["probability"])]


def test_drift_sink_is_idempotent(spark, tmp_path):
    ref = value_counts(frames.prediction_events(spark, SF_SMALL), ["latency_ms"])
    batch = spark.createDataFrame([("2024-01-09 00:00:00", "latency_ms", 5000.0 + i, 1) for i in range(60)]
                                  + [("2024-01-09 00:00:00", ev.ALL_ROWS, 0.0, 60)], "t string, feature string, value double, n long")
    batch = batch.select(F.col("t").cast("timestamp_ntz").alias("window_start"), "feature", "value", "n")
    fn = ev.drift_sink(ref, str(tmp_path / "o"), min_rows=10)
    fn(batch, 0)
    fn(batch, 0)                                  # replayed batch id
    assert spark.read.parquet(str(tmp_path / "o/alerts")).count() == 1 == spark.read.parquet(str(tmp_path / "o/ks")).count()


def test_stream_reads_folders_and_refuses_missing_tables(spark, tmp_path):
    import pytest
    spark.read.parquet(EVENTS).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    ev.run_to_table(ev.to_predictions(ev.read_event_stream(spark, str(tmp_path / "t.parquet"))),
                    str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == spark.read.parquet(EVENTS).count()
    with pytest.raises(FileNotFoundError):
        ev.read_event_stream(spark, str(tmp_path / "none.parquet"))


def test_event_log_day_read_prunes_partitions(spark, tmp_path):
    from cohortlab.sources import io
    path = str(tmp_path / "log")
    io.write_events(frames.prediction_events(spark, SF_SMALL), path)
    day = spark.read.parquet(path).filter(F.col("event_date") == F.lit("2024-01-15").cast("date"))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert day.count() == frames.prediction_events(spark, SF_SMALL).filter(
        F.to_date("ts") == F.lit("2024-01-15").cast("date")).count()


def test_late_event_after_watermark_is_dropped(spark, tmp_path):
    """A row older than the watermark, arriving after its window was emitted, is dropped."""
    import datetime
    import time
    src = tmp_path / "src"
    d = datetime.datetime
    batches = [[(1, d(2024, 1, 1, 10)), (2, d(2024, 1, 3, 12))],
               [(3, d(2024, 1, 5, 12))],                          # watermark passes day 1 and 3
               [(4, d(2024, 1, 1, 11)), (5, d(2024, 1, 7, 12))]]  # day-1 event is late
    for i, rows in enumerate(batches):
        full = [(k, t, 1, "view", 100.0 * k, "{}") for k, t in rows]
        spark.createDataFrame(full, ev.EVENT_SCHEMA).coalesce(1).write.parquet(str(src / f"b{i}"))
        time.sleep(1.1)                                   # file order = arrival order
    stream = (spark.readStream.schema(ev.EVENT_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ev.run_to_table(ev.windowed_metrics(ev.to_predictions(stream), "1 day", "1 hour"), out, ck)
    got = {r.window_start.day: r.requests_total for r in spark.read.parquet(out).collect()}
    assert got == {1: 1, 3: 1, 5: 1}     # late row dropped; the day-7 window is still open


def test_continuous_trigger_returns_running_query(spark, tmp_path):
    q = ev.run_to_table(ev.to_predictions(ev.read_event_stream(spark, EVENTS)), str(tmp_path / "o"),
                        str(tmp_path / "c"), processing_time="1 second")
    try:
        q.processAllAvailable()
        assert spark.read.parquet(str(tmp_path / "o")).count() == \
            frames.prediction_events(spark, SF_SMALL).count()
    finally:
        q.stop()
