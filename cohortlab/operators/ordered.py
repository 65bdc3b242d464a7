"""Global running sums without a single-partition window.

A ``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one
task. Instead:

1. the caller collapses ties first (input is unique on ``by + [order]``),
2. the rows are dealt by ranges of ``by + [order]`` and written once to the
   shared folder with the number of their range as ``_bucket``: boundaries are
   fixed values from then on, whatever is recomputed later,
3. range totals (groups x ranges rows) are prefix-summed and joined back as
   offsets -- the only step without a data-sized partitioning, over a table
   whose size is bounded by the number of ranges,
4. the running sum inside ``partitionBy(by + _bucket).orderBy(order)`` plus the
   offset is the global running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def by_ranges(df: DataFrame, keys: Sequence, n_buckets: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``keys``, ``_bucket`` rising with them, written to the shared folder.

    Without ``n_buckets`` Spark sizes the ranges (adaptive execution merges small ones).
    """
    dealt = df.repartitionByRange(n_buckets, *keys) if n_buckets else df.repartitionByRange(*keys)
    return materialise(dealt.withColumn("_bucket", F.spark_partition_id()), "ranges")


def cumulative(df: DataFrame, by: Sequence[str], order: str, values: Sequence[str],
               descending: bool = False, n_buckets: int | None = None,
               prefix: str = "cum_", totals: bool = False,
               tiebreak: Sequence[str] = (), keep_bucket: bool = False) -> DataFrame:
    """Add inclusive running sums ``cum_<v>`` of ``values`` along ``order`` within ``by``.

    ``df`` must be unique on ``by + [order]`` (collapse ties with a groupBy),
    unless ``tiebreak`` columns make ``by + [order] + tiebreak`` unique: equal
    ``order`` values share a range, so ordering by the tie-breakers inside it
    gives a row-exact running sum (a rank when the value is 1).
    Rows with a NULL ``order`` get NULL sums. ``totals=True`` also adds the
    group totals ``tot_<v>`` (taken from the range table, no extra join);
    ``keep_bucket=True`` keeps ``_bucket``, so a follow-up window partitioned by
    ``by + [_bucket, ...]`` reuses this partitioning without another shuffle.
    """
    cols_out, by = list(df.columns), list(by)

    def along(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    ranges = by_ranges(df.filter(F.col(order).isNotNull()), [*by, along(order)], n_buckets)
    bt = ranges.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w_off = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    extra = [F.sum(f"_t_{v}").over(w_all).alias(f"_a_{v}") for v in values] if totals else []
    offsets = bt.select(*by, "_bucket", *[
        F.coalesce(F.sum(f"_t_{v}").over(w_off), F.lit(0)).alias(f"_o_{v}") for v in values], *extra)
    out = ranges.join(offsets, on=[*by, "_bucket"])
    w_in = (Window.partitionBy(*by, "_bucket").orderBy(along(order), *[along(c) for c in tiebreak])
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = out.select(*cols_out, *[(F.col(f"_o_{v}") + F.sum(v).over(w_in)).alias(f"{prefix}{v}") for v in values],
                      *[F.col(f"_a_{v}").alias(f"tot_{v}") for v in values if totals],
                      *(["_bucket"] if keep_bucket else []))
    missing = df.filter(F.col(order).isNull())
    return sums.unionByName(missing, allowMissingColumns=True)


def exact_quantiles(long_df: DataFrame, by: Sequence[str], value: str,
                    q: float = 0.5) -> DataFrame:
    """Exact quantile (linear interpolation, like pandas/DuckDB) per group.

    Works on value counts: groupBy(by, value).count, running counts as above,
    then pick the two order statistics around ``q*(n-1)``. No group's values
    are ever gathered into one buffer.
    """
    by = list(by)
    counts = (long_df.filter(F.col(value).isNotNull())
              .groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")))
    j = cumulative(counts, by, value, ["_n"], totals=True)
    pos = F.lit(q) * (F.col("tot__n") - 1)
    lo_pos, hi_pos = F.floor(pos), F.ceil(pos)
    start = F.col("cum__n") - F.col("_n")
    j = j.withColumn("_pos", pos)
    hit_lo = (start <= lo_pos) & (lo_pos < F.col("cum__n"))
    hit_hi = (start <= hi_pos) & (hi_pos < F.col("cum__n"))
    sel = j.filter(hit_lo | hit_hi).select(
        *by, "_pos",
        F.when(hit_lo, F.col(value)).alias("_lo"),
        F.when(hit_hi, F.col(value)).alias("_hi"))
    agg = sel.groupBy(*by).agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
                               F.first("_pos").alias("_pos"))
    frac = F.col("_pos") - F.floor(F.col("_pos"))
    return agg.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("quantile"))
