"""Deterministic, order-free splits, folds and samples from key hashes.

Library seeds cannot be reproduced across engines or after a lost
executor; a hash of the key can. No split here sorts the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_unit
from .ordered import cumulative

# fixed values: split shares and seed
SEED = 42
TEST_SHARE = 0.15
VAL_SHARE = 0.15


def hash_split(df: DataFrame, key: str, salt=SEED, test: float = TEST_SHARE,
               val: float = VAL_SHARE) -> DataFrame:
    """Add ``split`` in {test, validation, train}; stratified in expectation."""
    h = hash_unit(key, salt)
    return df.withColumn("split", F.when(h < test, "test").when(h < test + val, "validation")
                         .otherwise("train"))


def hash_folds(df: DataFrame, key: str, k: int = 5, salt="fold") -> DataFrame:
    """Add ``fold`` in [0, k)."""
    return df.withColumn("fold", F.floor(hash_unit(key, salt) * k).cast("int"))


def random_split(df: DataFrame, key: str, share: float = 0.2, salt="audit") -> DataFrame:
    """Unstratified hash split: ``split`` in {test, train}."""
    return df.withColumn("split", F.when(hash_unit(key, salt) < share, "test").otherwise("train"))


def exact_split(df: DataFrame, key: str, label: str, salt=SEED, test: float = TEST_SHARE,
                val: float = VAL_SHARE) -> DataFrame:
    """Exact per-label shares: within each label, rows ranked by (hash, key).

    The rank is a global running count over the rows themselves, done with
    bucketed windows (:func:`cumulative`, hash ties broken by key inside
    their bucket); label sizes come from the same bucket table. The key must
    be unique; use ``hash_split`` for tables without one.
    """
    rows = df.withColumn("_h", hash_unit(key, salt)).withColumn("_one", F.lit(1))
    # rank within label by (hash, key): a running count, no join back to the rows
    ranked = cumulative(rows, [label], "_h", ["_one"], totals=True, tiebreak=[key])
    n_test = F.round(F.col("tot__one") * test)
    n_val = F.round(F.col("tot__one") * val)
    rank = F.col("cum__one")
    split = (F.when(rank <= n_test, "test")
             .when(rank <= n_test + n_val, "validation").otherwise("train"))
    return ranked.withColumn("split", split).drop("_h", "_one", "cum__one", "tot__one")


def reference_sample(df: DataFrame, key: str, n: int = 2000, salt="reference") -> DataFrame:
    """Fixed-size sample: the n rows with the smallest key hash (top-k, no full sort)."""
    return (df.withColumn("_h", hash_unit(key, salt))
              .orderBy("_h", key).limit(n).drop("_h"))


def poisson_cdf(k_max: int = 12) -> list[float]:
    """P(X <= k) for X ~ Poisson(1), k = 0..k_max."""
    out, acc, term = [], 0.0, math.exp(-1.0)
    for k in range(k_max + 1):
        if k > 0:
            term /= k
        acc += term
        out.append(acc)
    return out


def poisson_weight(key: str, replicate: int, salt="boot") -> F.Column:
    """Poisson(1) resampling weight of a row in a replicate (inverse CDF on a hash)."""
    u = hash_unit(key, f"{salt}{replicate}")
    w = F.lit(0)
    for c in poisson_cdf():
        w = w + F.when(u >= c, 1).otherwise(0)
    return w


def poisson_bootstrap(df: DataFrame, key: str, label: str, replicates: int = 3) -> DataFrame:
    """Bootstrap prevalence: one pass, one weighted sum per replicate (no row blow-up)."""
    aggs = [F.avg(F.col(label).cast("double")).alias("base")]
    for b in range(replicates):
        w = poisson_weight(key, b)
        aggs += [F.sum(w).alias(f"w{b}"), F.sum(w * F.col(label)).alias(f"p{b}")]
    wide = df.agg(*aggs)
    rows = ", ".join(f"{b}, w{b}, p{b}" for b in range(replicates))
    long = wide.selectExpr("base", f"stack({replicates}, {rows}) AS (replicate, n_weighted, n_pos)")
    prev = F.col("n_pos") / F.col("n_weighted")
    return long.select("replicate", F.col("n_weighted").cast("bigint").alias("n_weighted"),
                       prev.alias("prevalence"), "base",
                       F.abs(prev - F.col("base")).alias("abs_diff"))


def ordered_split(df: DataFrame, order: str, share: float = 0.7,
                  cut: float | None = None) -> DataFrame:
    """Pseudo-temporal split: rows at or below the ``share`` quantile train, the rest test.

    The cut is one number (exact distributed quantile unless given), so
    ``max(train) <= min(test)`` holds without a global sort. NULLs go to test.
    """
    if cut is None:
        from .ordered import exact_quantiles
        long = df.select(F.col(order).cast("double").alias("value"))
        cut = exact_quantiles(long, [], "value", share).collect()[0]["quantile"]
    return df.withColumn("split", F.when(F.col(order) <= F.lit(cut), "train").otherwise("test"))


def long_hash_unit(text: F.Column) -> F.Column:
    """Uniform number in [0, 1) from 52 bits of the text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(2.0 ** 52)


def bootstrap(df: DataFrame, key: str, label: str, replicates: int = 3) -> DataFrame:
    """(replicate, n_draws, n_distinct, prevalence, base, abs_diff): resamples of exactly as many draws as rows.

    Draw i of a replicate takes the row whose rank by ``key`` (unique) is floor(hash(replicate, i) * n).
    Draws are counted per rank before they meet the ranked rows; ranks come from ranges, so nothing is
    gathered or sorted in one task. Works for any n; an empty table gives no rows.
    """
    ranked = cumulative(df.select(key, label).withColumn("_k", F.lit(0)).withColumn("_one", F.lit(1)), ["_k"], key, ["_one"])
    rows = ranked.select((F.col("cum__one") - 1).alias("_at"), F.col(label).cast("double").alias("_y"))
    n = rows.count()
    draws = df.sparkSession.range(n * replicates).select(
        F.expr(f"id div {max(n, 1)}").cast("int").alias("replicate"), (F.col("id") % max(n, 1)).alias("_i"))
    text = F.concat_ws(":", F.lit("draw"), F.col("replicate").cast("string"), F.col("_i").cast("string"))
    weights = (draws.select("replicate", F.floor(long_hash_unit(text) * n).cast("long").alias("_at"))
               .groupBy("replicate", "_at").agg(F.count(F.lit(1)).alias("_w")))
    base = rows.agg(F.avg("_y").alias("base"))
    drawn = weights.join(rows, "_at").groupBy("replicate").agg(
        F.sum("_w").alias("n_draws"), F.count(F.lit(1)).alias("n_distinct"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("prevalence"))
    one = drawn.crossJoin(F.broadcast(base))          # a row per replicate beside one row
    return one.withColumn("abs_diff", F.abs(F.col("prevalence") - F.col("base")))
