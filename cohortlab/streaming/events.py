"""Structured Streaming over the prediction-event log.

The reference appends one JSON line per request and keeps in-process ring
buffers (last 500 events, last 200 rows for drift). Here the log is a file
stream: events are scored and appended by a checkpointed Parquet sink,
request metrics are event-time tumbling windows with a watermark (late rows
past the watermark are dropped, each closed window is emitted once), replays
are de-duplicated by trace id within the watermark, and drift is tested once
per closed window from value counts kept in the streaming state, with an
idempotent, batch-keyed sink.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from ..functions.columns import risk_level
from ..operators.drift import drift_alerts, ks_from_counts
from ..operators.score import score_all
from ..session import temporary_tables

EVENT_SCHEMA = StructType([
    StructField("event_id", LongType()), StructField("ts", TimestampNTZType()),
    StructField("user_id", LongType()), StructField("event_type", StringType()),
    StructField("value", DoubleType()), StructField("props", StringType())])


def read_event_stream(spark: SparkSession, table: str, max_files: int | None = None) -> DataFrame:
    """File stream over an event table: a folder of Parquet files, or a single file.

    A folder is watched for new files; a single file is streamed from its own folder by
    its name. A path that does not exist is an error, not an empty stream.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(table)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(f"no event table at {table}")
    r = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if fs.getFileStatus(where).isDirectory():
        return r.parquet(table)
    folder, _, name = table.rpartition("/")
    return r.option("pathGlobFilter", name).parquet(folder)


def to_predictions(events: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Prediction events: trace_id, ts (timestamp; watermarks reject TIMESTAMP_NTZ),
    probability, latency_ms, prediction, risk_level."""
    p = F.col("value") / 500
    return events.select(F.col("event_id").alias("trace_id"), F.col("ts").cast("timestamp").alias("ts"),
                         p.alias("probability"), (F.col("event_id") % 200).alias("latency_ms"),
                         (p >= threshold).cast("int").alias("prediction"),
                         risk_level(p).alias("risk_level"), "event_type")


def windowed_metrics(pred: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Tumbling-window request metrics; append mode emits a window once the watermark passes it."""
    g = (pred.withWatermark("ts", delay)
             .groupBy(F.window("ts", window))
             .agg(F.count(F.lit(1)).alias("requests_total"),
                  F.avg(F.coalesce("probability", F.lit(0.0))).alias("avg_prob"),
                  F.avg(F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0))).alias("avg_latency_ms")))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                    "requests_total", "avg_prob", "avg_latency_ms")


def dedup(pred: DataFrame, delay: str = "1 hour", key: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Drop replayed events: one row per trace id while it is within the watermark."""
    return pred.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(key))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 processing_time: str | None = None):
    """Parquet sink with a checkpoint (exactly-once file output).

    By default drains the available input and returns when done
    (``availableNow``); with ``processing_time`` (e.g. "1 minute") it starts a
    continuously running query and returns its handle.
    """
    w = (stream.writeStream.format("parquet").outputMode(mode)
               .option("path", path).option("checkpointLocation", checkpoint))
    if processing_time:
        return w.trigger(processingTime=processing_time).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


ALL_ROWS = "_rows"    # pseudo-feature that counts the events of a window


def window_counts(pred: DataFrame, features: Sequence[str], window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window_start, feature, value, n) of each window, emitted once, when the watermark has passed it.

    The counts live in the streaming state across batches and restarts, so a window may
    arrive in any number of pieces. ``ALL_ROWS`` counts the events whatever they hold.
    """
    stack = ", ".join([f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features] + [f"'{ALL_ROWS}', CAST(0 AS DOUBLE)"])
    long = (pred.withWatermark("ts", delay)
            .selectExpr("ts", f"stack({len(features) + 1}, {stack}) AS (feature, value)")
            .filter("value IS NOT NULL AND NOT isnan(value)"))
    g = long.groupBy(F.window("ts", window), "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "feature", "value", "n")


def drift_sink(reference: DataFrame, path: str, min_rows: int = 50, alpha: float = 0.01):
    """``foreachBatch`` function over ``window_counts``: KS and alerts of each closed window of >= min_rows events.

    ``reference`` holds stored value counts (``value_counts``). Results go to
    ``ks/batch_id=<id>`` and ``alerts/batch_id=<id>`` with overwrite, so a replayed batch
    rewrites, never duplicates. The alerts are taken from the written KS rows. Range tables of
    the running sums are deleted with each batch.
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        big = batch.filter((F.col("feature") == ALL_ROWS) & (F.col("n") >= min_rows)).select("window_start")
        counts = batch.filter(F.col("feature") != ALL_ROWS).join(big, "window_start", "left_semi")
        where = f"batch_id={batch_id}"
        with temporary_tables(spark):
            ks_from_counts(reference, counts, ["window_start"], alpha).write.mode("overwrite").parquet(f"{path}/ks/{where}")
        found = spark.read.parquet(f"{path}/ks/{where}")
        drift_alerts(found, by=["window_start"]).write.mode("overwrite").parquet(f"{path}/alerts/{where}")
        batch.unpersist()
    return fn


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, processing_time: str | None = None):
    """Each micro-batch through ``sink``; the state and the progress stay in ``checkpoint``.

    By default drains what has arrived since the last run; with ``processing_time`` the running
    query is returned.
    """
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if processing_time:
        return w.trigger(processingTime=processing_time).start()
    w.trigger(availableNow=True).start().awaitTermination()
    return None


run_drift = run_batches


def scored_sink(prepare: Callable[[DataFrame], DataFrame], scorer, path: str, key: str, then: Sequence[Callable] = (), **kw):
    """``foreachBatch`` function: rows prepared, scored and written to ``batch_id=<id>/status=<status>``.

    ``prepare`` makes the scorer's input of raw rows; ``kw`` goes to ``score_all``. Every
    function of ``then`` gets the written rows of the batch that were scored, and its number: they see
    the very values that were stored. A replayed batch rewrites its own folder.
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark, where = batch.sparkSession, f"{path}/batch_id={batch_id}"
        with temporary_tables(spark):
            rows = score_all(prepare(batch), scorer, key, **kw)
            rows.write.mode("overwrite").partitionBy("status").parquet(where)
            kept = spark.read.schema(rows.schema).parquet(where).filter("status = 'scored'")
            for sink in then:
                sink(kept, batch_id)
    return fn


def scored_events(stream: DataFrame, scorer, key: str, **kw) -> DataFrame:
    """Every event through the batch scorer: status, reason, probability, threshold, version, hashes.

    The same projection as the batch path, so a stream and a batch over the same rows agree.
    """
    return score_all(stream, scorer, key, **kw)


def run_scored(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append scored and quarantined rows, partitioned by status (exactly-once file sink)."""
    q = (stream.writeStream.format("parquet").outputMode("append").partitionBy("status")
         .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
