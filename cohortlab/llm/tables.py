"""Shared-storage helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


ARROW_ROWS = 1000


def long_rows(spark: SparkSession) -> None:
    """Texts and whole sets are long rows: Arrow batches of few rows bound the memory of both sides.

    This sets the session's batch size, the only place where Spark takes it from.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    long_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder of the session."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: an executor lost later costs a re-read, not a recomputation,
    and values that differ between runs of a task (none should) are fixed once.
    """
    spark = df.sparkSession
    long_rows(spark)
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget_stored(*frames: DataFrame) -> None:
    """Delete stored frames that nothing later reads, so that intermediates do not add up on the shared disk."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_bucket(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
