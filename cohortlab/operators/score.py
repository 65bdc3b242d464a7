"""Batch scoring with a validity predicate and a quarantine output.

The reference loops over rows and counts the ones that throw. Here one
projection marks each row valid or gives the reason it is not; valid rows
get probability, class, risk level, feature hash and event fields; both
kinds leave in one pass (``write_scored`` partitions by status).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import feature_hash, risk_level
from .clean import AGE_MAX, AGE_MIN

# fixed values: fields a scoring request must carry
REQUIRED = ("age", "fasting_glucose", "fasting_insulin", "bmi")

Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class LinearScorer:
    """p = 1 / (1 + exp(-(intercept + sum w_i x_i))): a fixed scorer with no training."""
    weights: Mapping[str, float]
    intercept: float = 0.0
    out: str = "probability"

    def expr(self) -> Column:
        z = F.lit(float(self.intercept))
        for c, w in self.weights.items():
            z = z + F.lit(float(w)) * F.col(c)
        return 1.0 / (1.0 + F.exp(-z))

    def sql(self) -> str:
        z = f"{float(self.intercept)!r}"
        for c, w in self.weights.items():
            z = f"({z} + {float(w)!r} * {c})"
        return f"1.0 / (1.0 + exp(-{z}))"

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, self.expr())


def invalid_reason(required: Sequence[str] = REQUIRED) -> Column:
    """NULL for a valid row, else the first failed rule."""
    r = F.lit(None).cast("string")
    if "age" in required:
        bad_age = (F.col("age") < AGE_MIN) | (F.col("age") > AGE_MAX)
        r = F.when(F.coalesce(bad_age, F.lit(False)), F.lit("age_out_of_range")).otherwise(r)
    for c in reversed(list(required)):
        r = F.when(F.col(c).isNull(), F.lit(f"missing_{c}")).otherwise(r)
    return r


def score_all(df: DataFrame, scorer: Scorer, key: str, threshold: float = 0.5,
              model_version: str = "v1", features: Sequence[str] = REQUIRED,
              required: Sequence[str] = REQUIRED, ts: str | None = None,
              random_ids: bool = False) -> DataFrame:
    """Every input row once, with ``status`` in {scored, quarantined} and ``reason``."""
    present = [c for c in required if c in df.columns]
    missing = [c for c in required if c not in df.columns]
    for c in missing:
        df = df.withColumn(c, F.lit(None).cast("double"))
    flagged = df.withColumn("reason", invalid_reason(present + missing))
    scored = scorer(flagged)
    valid = F.col("reason").isNull()
    p = F.when(valid, F.col("probability"))
    trace = (F.expr("uuid()") if random_ids else
             F.md5(F.concat(F.lit(f"{model_version}:"), F.col(key).cast("string"))))
    return scored.select(
        key,
        F.when(valid, F.lit("scored")).otherwise(F.lit("quarantined")).alias("status"),
        "reason",
        p.alias("probability"),
        F.when(valid, (F.col("probability") >= threshold).cast("int")).alias("prediction"),
        F.lit(float(threshold)).alias("threshold_used"),
        F.when(valid, risk_level("probability")).alias("risk_level"),
        F.lit(model_version).alias("model_version"),
        trace.alias("trace_id"),
        F.lit(0.0).alias("latency_ms"),
        F.when(valid, feature_hash(*[c for c in features if c in scored.columns])).alias("features_hash"),
        (F.col(ts).cast("timestamp") if ts else F.current_timestamp()).alias("ts"),
    )


def score(df: DataFrame, scorer: Scorer, key: str, **kw) -> tuple[DataFrame, DataFrame]:
    """(scored rows, quarantined rows with reason)."""
    allr = score_all(df, scorer, key, **kw)
    good = allr.filter(F.col("status") == "scored").drop("reason")
    bad = allr.filter(F.col("status") == "quarantined").select(key, "reason")
    return good, bad


def write_scored(all_rows: DataFrame, path: str, mode: str = "append") -> None:
    """One pass writes both outputs, partitioned by status."""
    all_rows.write.mode(mode).partitionBy("status").parquet(path)


def batch_outcome(all_rows: DataFrame) -> DataFrame:
    return all_rows.agg(F.count(F.lit(1)).alias("total_records"),
                        F.count(F.when(F.col("status") == "scored", 1)).alias("successful"),
                        F.count(F.when(F.col("status") == "quarantined", 1)).alias("failed"))


def quarantine_counts(all_rows: DataFrame) -> DataFrame:
    return all_rows.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))
