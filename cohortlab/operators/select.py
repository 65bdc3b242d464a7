"""Feature selection by binned mutual information with the label.

The reference estimates MI with a k-nearest-neighbour estimator on one
machine. Here each feature is cut into equal-frequency bins with an exact,
reproducible rule -- ``bin = floor(B * #(values < x) / n)`` from running
counts -- and MI is the plug-in estimate over (bin, label) counts with the
Miller-Madow bias correction, all as grouped aggregates over an unpivoted
table. No feature's values are ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cumulative
from .profile import unpivot

# fixed values: MI keep threshold and default bin count
MI_THRESHOLD = 0.001
MI_BINS = 20


def binned_counts(vcounts: DataFrame, label: str, bins: int = MI_BINS) -> DataFrame:
    """(feature, bin, label, n_xy) from per-(feature, value, label) counts ``_c``.

    ``bin = floor(B * #(values < x) / n)``: a running count over the counts
    table itself (label as tie-breaker), and ``#(values < x)`` is the minimum of
    ``cum - c`` over the rows of one value -- a window clustered by
    (feature, bucket, value), which the running-sum partitioning already
    satisfies, so no join and no extra shuffle. NULL values form bin -1.
    """
    nn = vcounts.filter(F.col("value").isNotNull())
    cum = cumulative(nn, ["feature"], "value", ["_c"], totals=True, tiebreak=[label], keep_bucket=True)
    less = F.min(F.col("cum__c") - F.col("_c")).over(Window.partitionBy("feature", "_bucket", "value"))
    binned = cum.select("feature", label, "_c",
                        F.floor(F.lit(bins) * less / F.col("tot__c")).cast("int").alias("bin"))
    nulls = vcounts.filter(F.col("value").isNull()).select("feature", label, "_c",
                                                          F.lit(-1).alias("bin"))
    return (binned.unionByName(nulls).groupBy("feature", "bin", label)
                  .agg(F.sum("_c").alias("n_xy")))


def binned_mi(df: DataFrame, label: str, features: Sequence[str], bins: int = MI_BINS,
              threshold: float = MI_THRESHOLD) -> DataFrame:
    """(feature, mi_plugin, mi, n, selected); NULL values form their own bin (-1)."""
    long = unpivot(df.select(label, *features), [label], list(features))
    # pre-aggregate before anything else: a hot value collapses to one row per label
    vcounts = long.groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("_c"))
    cells = binned_counts(vcounts, label, bins)
    # a feature has at most 2 * (bins + 1) cells: gather them and finish in one projection
    g = cells.groupBy("feature").agg(F.collect_list(F.struct(
        F.col("bin").alias("b"), F.col(label).alias("y"), F.col("n_xy").cast("double").alias("n")))
        .alias("cells"))
    n = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["n"])

    def marg(c, field):
        return F.aggregate(F.filter("cells", lambda o: o[field] == c[field]), F.lit(0.0),
                           lambda acc, o: acc + o["n"])
    g = g.withColumn("_n", n)
    term = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["n"] / F.col("_n") * F.ln(
        c["n"] * F.col("_n") / (marg(c, "b") * marg(c, "y"))))
    k_xy = F.size("cells")
    k_x = F.size(F.array_distinct(F.transform("cells", lambda c: c["b"])))
    k_y = F.size(F.array_distinct(F.transform("cells", lambda c: c["y"])))
    out = g.select("feature", term.alias("mi_plugin"),
                   ((k_xy - k_x - k_y + 1) / (2.0 * F.col("_n"))).alias("_bias"),
                   F.col("_n").cast("long").alias("n"))
    out = out.select("feature", "mi_plugin", (F.col("mi_plugin") - F.col("_bias")).alias("mi"), "n")
    return out.withColumn("selected", F.col("mi") >= threshold)


def top_by_mi(mi: DataFrame, n: int = 30) -> DataFrame:
    """The n features with the highest MI (ties by name)."""
    return mi.orderBy(F.col("mi").desc(), "feature").limit(n)
