"""Two-sample Kolmogorov-Smirnov drift per feature, and alert rows.

Both samples are unpivoted to (feature, value) and counted per distinct value;
the two empirical CDFs are running sums over value within each feature (by
ranges, no single-partition window). D is the largest gap.
Spark's own KS test is one-sample only, so this is ours.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import cumulative
from .profile import unpivot

# fixed values: significance level of the drift test
KS_ALPHA = 0.01
EXACT_MOST = 10_000  # samples up to this size get an exact p-value
VALUES_PER_TASK = 1_000_000  # values that a task counts, whatever the size of the samples
KS_TERMS = 30  # terms beyond 30 are below exp(-70) once lambda >= 0.2


def kolmogorov_sf(lam: F.Column, terms: int = KS_TERMS) -> F.Column:
    """Asymptotic Kolmogorov survival function 2*sum (-1)^(k-1) exp(-2 k^2 lam^2)."""
    s = F.lit(0.0)
    for k in range(1, terms + 1):
        s = s + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))


def exact_sf(d: float, m: int, n: int) -> float:
    """P(D >= d) of two samples of m and n values without ties, both from one distribution.

    Counts the lattice paths from (0, 0) to (m, n) that stay inside the band |i / m - j / n| < d, one row of
    the lattice at a time: paths into a row are running sums over the band of those into the row before.
    Rows are scaled as they grow; the share of paths that stay is taken in logarithms.
    """
    if m > n:
        m, n = n, m
    h = round(d * m * n)                      # gaps are whole multiples of 1 / (m n)
    if h <= 0:
        return 1.0
    i, log_scale = np.arange(m + 1), 0.0
    low = np.maximum((i * n - h) // m + 1, 0)              # smallest and largest j with |i n - j m| < h
    high = np.minimum(-(-(i * n + h) // m) - 1, n)
    paths, first = np.ones(int(high[0]) + 1), 0
    for k in range(1, m + 1):
        if low[k] > high[k]:
            return 1.0
        row = np.zeros(int(high[k] - low[k]) + 1)
        a, b = max(int(low[k]), first), min(int(high[k]), first + len(paths) - 1)
        if a > b:
            return 1.0
        row[a - low[k]:b - low[k] + 1] = paths[a - first:b - first + 1]
        paths, first = np.cumsum(row), int(low[k])
        top = paths[-1]
        if top > 1e200:
            paths, log_scale = paths / top, log_scale + math.log(top)
    if first + len(paths) - 1 < n or paths[-1] <= 0:
        return 1.0
    inside = math.log(paths[-1]) + log_scale - (math.lgamma(m + n + 1) - math.lgamma(m + 1) - math.lgamma(n + 1))
    return min(max(-math.expm1(inside), 0.0), 1.0)


def with_exact_p(ks: DataFrame, alpha: float = KS_ALPHA, most: int = EXACT_MOST) -> DataFrame:
    """The p-value and the flag of ``ks_drift`` rows from the exact distribution where neither sample has more
    than ``most`` values; larger samples keep the asymptotic one."""
    @F.pandas_udf("double")
    def exact(d, m, n):
        import pandas as pd

        return pd.Series([exact_sf(*t) for t in zip(d.tolist(), m.tolist(), n.tolist())], dtype="float64")

    small = F.greatest("n_ref", "n_new") <= most
    p = F.when(small, exact("d", F.when(small, F.col("n_ref")).otherwise(1), F.when(small, F.col("n_new")).otherwise(1))).otherwise(F.col("p_value"))
    return ks.withColumn("p_value", p).withColumn("drifted", F.col("p_value") < alpha)


def _long(df: DataFrame, ids: Sequence[str], feats: Sequence[str]) -> DataFrame:
    return unpivot(df.select(*ids, *feats), list(ids), list(feats)).filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, value, n): what a sample's empirical distribution needs; NULL and NaN are left out."""
    return _long(df, by, features).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def dealt(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``features`` of ``df``, dealt so that the values a task counts have a bounded number.

    Measured values hardly repeat, so a task's table of counts is about as large as its rows.
    """
    few = df.select(*by, *features)
    tasks = -(-df.count() * len(features) // VALUES_PER_TASK)
    return few.repartition(tasks, *features) if tasks > 1 else few


def ks_from_counts(ref: DataFrame, new: DataFrame, by: Sequence[str] = (), alpha: float = KS_ALPHA) -> DataFrame:
    """KS of each (by..., feature) group of ``new`` against the feature's one reference, both as value counts.

    Between two values of the new sample its distribution is constant and the reference's
    rises, so the largest gap is at a new value or just before one. The reference's running
    sum is taken once, at its own values and at the distinct new ones; each group then
    looks it up by an equi-join: linear in both tables, no reference copy per group.
    """
    by, keys = list(by), [*by, "feature"]
    points = (ref.select("feature", "value", F.col("n").alias("c_ref"), F.lit(0).alias("_new"))
              .unionByName(new.select("feature", "value", F.lit(0).cast("long").alias("c_ref"), F.lit(1).alias("_new")))
              .groupBy("feature", "value").agg(F.sum("c_ref").alias("c_ref"), F.max("_new").alias("_new")))
    at = (cumulative(points, ["feature"], "value", ["c_ref"], totals=True).filter(F.col("_new") == 1)
          .select("feature", "value", "c_ref", "cum_c_ref", F.col("tot_c_ref").alias("n_ref")))
    own = cumulative(new.withColumnRenamed("n", "c_new"), keys, "value", ["c_new"], totals=True)
    both = (own.join(at, ["feature", "value"]).withColumnRenamed("tot_c_new", "n_new")
            .filter((F.col("n_ref") > 0) & (F.col("n_new") > 0)))

    def gap(r, n):
        return F.abs(r / F.col("n_ref") - n / F.col("n_new"))

    here = gap(F.col("cum_c_ref"), F.col("cum_c_new"))
    before = gap(F.col("cum_c_ref") - F.col("c_ref"), F.col("cum_c_new") - F.col("c_new"))
    d = both.groupBy(*keys).agg(F.max(F.greatest(here, before)).alias("d"), F.first("n_ref").alias("n_ref"),
                                F.first("n_new").alias("n_new"))
    en = F.col("n_ref") * F.col("n_new") / (F.col("n_ref") + F.col("n_new"))
    lam = d.select("*", (F.col("d") * F.sqrt(en)).alias("_lam"))
    withp = lam.select(*keys, "d", "n_ref", "n_new", kolmogorov_sf(F.col("_lam")).alias("p_value"))
    return withp.withColumn("drifted", F.col("p_value") < alpha)


def ks_drift(ref: DataFrame, new: DataFrame, features: Sequence[str],
             alpha: float = KS_ALPHA, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, d, n_ref, n_new, p_value, drifted) for features in both samples.

    NULLs and NaNs are dropped per feature; a feature with an empty side is skipped.
    With ``by`` (e.g. a window), ``new`` is tested group by group against the one
    reference, all groups in one plan. p uses the asymptotic distribution with
    n_eff = n_ref*n_new/(n_ref+n_new); ``with_exact_p`` replaces it for small samples.
    """
    feats = [f for f in features if f in ref.columns and f in new.columns]
    if not feats:
        return ref.sparkSession.createDataFrame(
            [], "feature string, d double, n_ref bigint, n_new bigint, p_value double, drifted boolean")
    return ks_from_counts(value_counts(dealt(ref, feats), feats), value_counts(dealt(new, feats, by), feats, by), by, alpha)


def drift_alerts(ks: DataFrame, at: F.Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One alert row (alert_ts, drift_features sorted) per group with a drifted feature."""
    drifted = ks.filter("drifted")
    g = drifted.groupBy(*by).agg(F.sort_array(F.collect_list("feature")).alias("drift_features"),
                                 F.count(F.lit(1)).alias("n_drifted"))
    g = g.filter(F.col("n_drifted") > 0)
    return g.withColumn("alert_ts", at if at is not None else F.current_timestamp())
