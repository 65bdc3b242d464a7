"""Sources and sinks: cohort CSV scan, metric tables, event logs, alerts, state.

Every writer takes its path from the caller; the shared folder for
intermediates is the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.clean import canonical_name, canonicalize, nan_to_null


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(hpath)) and len(fs.globStatus(hpath)) > 0


def read_cohort_csv(spark: SparkSession, path: str, schema: StructType | None = None,
                    quarantine_column: str | None = None) -> DataFrame:
    """Header CSV; columns are found by canonical name, in any order, and typed by ``schema``.

    The header alone is read first (no data pass). Columns the schema does not name are
    dropped, columns the file lacks are NULL; without a schema every column is text. NaN
    becomes NULL. ``quarantine_column`` keeps malformed lines (PERMISSIVE mode) in that
    column instead of failing the batch. A missing path raises FileNotFoundError.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no CSV input at {path}")
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    header = reader.csv(path).columns
    if schema is None:
        return canonicalize(reader.csv(path))
    wanted = {canonical_name(f.name): f for f in schema}
    fields = [StructField(h, wanted[canonical_name(h)].dataType if canonical_name(h) in wanted else StringType())
              for h in header]
    if quarantine_column:
        fields.append(StructField(quarantine_column, StringType()))
        reader = reader.option("columnNameOfCorruptRecord", quarantine_column)
    # the header of every file is held against the schema instead of being skipped
    df = canonicalize(reader.schema(StructType(fields)).option("enforceSchema", False).csv(path))
    extra = [quarantine_column] if quarantine_column else []
    return nan_to_null(df.select(*[
        (F.col(c) if c in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for c, f in wanted.items()],
        *[F.col(canonical_name(c)).alias(c) for c in extra]))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def new_run_id() -> str:
    return f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"


def append_metrics(metrics_long: DataFrame, path: str, run_id: str, model: str | None = None) -> None:
    """Append (run_id, model, metric, value) rows; runs stay distinguishable."""
    out = metrics_long.withColumn("run_id", F.lit(run_id))
    if model is not None and "model" not in out.columns:
        out = out.withColumn("model", F.lit(model))
    out.write.mode("append").partitionBy("run_id").parquet(path)


def write_document(df: DataFrame, path: str) -> None:
    """Small metric / parameter documents as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_events(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Append-only prediction log, partitioned by event date (partition pruning on reads)."""
    events.withColumn("event_date", F.to_date(F.col(ts))).write.mode("append") \
        .partitionBy("event_date").parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Alert rows as JSON lines; an empty alert frame writes no data file."""
    alerts.write.mode("append").json(path)
