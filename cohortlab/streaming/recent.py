"""Running request metrics over the newest events of a stream.

After each micro-batch the newest ``keep`` events read so far are the newest of the ones held before
and of the batch's own newest: a bounded table, whatever the stream's length, order of arrival or
number of sources. Every batch writes what it holds and its metrics under its own number, from the
table of the batch before, so that a batch that is run again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import last_n, request_metrics
from ..session import delete_path

KEEP = 500        # fixed value: events of the running metrics


def recent_sink(path: str, keep: int = KEEP, ts: str = "ts", tie: str = "trace_id", p: str = "probability",
                latency: str = "latency_ms"):
    """``foreachBatch`` function: ``recent/batch_id=<id>`` (held events) and ``metrics/batch_id=<id>``.

    Events without a time are older than all others. ``path`` belongs to one checkpoint: a batch
    needs the table of the one before and fails without it. Of the held tables the last two stay.
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(tie), F.col(ts), F.col(p).cast("double").alias(p), F.col(latency).cast("double").alias(latency))
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/recent/batch_id={batch_id - 1}"))
        here = f"{path}/recent/batch_id={batch_id}"
        last_n(rows, keep, ts, tie).write.mode("overwrite").parquet(here)
        held = spark.read.schema(rows.schema).parquet(here)
        request_metrics(held, p, latency).write.mode("overwrite").parquet(f"{path}/metrics/batch_id={batch_id}")
        if batch_id > 1:
            delete_path(spark, f"{path}/recent/batch_id={batch_id - 2}")
    return fn
