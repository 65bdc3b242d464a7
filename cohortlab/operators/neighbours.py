"""Nearest-neighbour mutual information of a numeric feature with a discrete label.

For every value its distance to the k-th nearest value of the same label is taken; with ``k_i``
values of the same label and ``m_i`` values of any label within that distance (the value itself not
counted), the estimate is ``psi(N) + mean(psi(k_i) - psi(N_label) - psi(m_i))``, psi the digamma
function. Distances are closed on both sides, so ties need no noise: without ties ``k_i = k``.

No feature is ever sorted or held in one task. Equal values are counted first. Neighbours within a
label come from blocks of equal length of the label's sorted distinct values, each with a halo of
``k`` rows from the blocks beside it; the counts over all labels come from one running count in
which the ends of the distances take part as rows of weight zero.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import cumulative
from .profile import unpivot
from .select import MI_THRESHOLD

NEIGHBOURS = 3       # fixed value: neighbours of the estimator
BLOCK = 100_000      # distinct values of one label that a task sorts at a time


def digamma(n: Column) -> Column:
    """psi(n) of a positive whole number: recurrence to n + 6, then the asymptotic series (1e-10)."""
    x = n + F.lit(6.0)
    sq = x * x
    series = F.ln(x) - 0.5 / x - (1 / 12 - (1 / 120 - (1 / 252 - 1 / 240 / sq) / sq) / sq) / sq
    return series - sum((1.0 / (n + F.lit(float(j))) for j in range(1, 6)), 1.0 / n.cast("double"))


def _with_neighbours(ranked: DataFrame, label: str, k: int, block: int) -> DataFrame:
    """``_d<i>``, ``_n<i>``, ``_v<i>``: distance, count and value of up to k distinct values on either side, else null."""
    at = F.col("cum__one") - 1
    home, place = F.floor(at / block), at % block
    copies = F.array(home, F.when((place < k) & (home > 0), home - 1), F.when(place >= block - k, home + 1))
    dealt = ranked.withColumn("_home", home).withColumn("_block", F.explode(copies)).filter("_block IS NOT NULL")
    w = Window.partitionBy("feature", label, "_block").orderBy("value")
    sides = [(shift, i) for shift in (F.lag, F.lead) for i in range(1, k + 1)]
    near = dealt.withColumns({f"_{name}{j}": shift(c, i).over(w) for j, (shift, i) in enumerate(sides)
                              for name, c in (("v", "value"), ("n", "_c"))}).filter("_block = _home")
    return near.withColumns({f"_d{j}": F.abs(F.col("value") - F.col(f"_v{j}")) for j in range(2 * k)})


def _ends(near: DataFrame, k: int) -> DataFrame:
    """``_k``, ``_lo``, ``_hi``: values of the same label within the k-th distance, and where that distance ends."""
    sides = range(2 * k)

    def within(d):
        return sum((F.when(F.col(f"_d{j}") <= d, F.col(f"_n{j}")).otherwise(0) for j in sides), F.col("_c") - 1)
    enough = F.least(F.lit(k), F.col("_ny") - 1)
    distances = [F.lit(0.0), *[F.col(f"_d{j}") for j in sides]]
    near = near.withColumn("_r", F.least(*[F.when(within(d) >= enough, d) for d in distances]))
    inside = [F.when(F.col(f"_d{j}") <= F.col("_r"), F.col(f"_v{j}")) for j in sides]
    # a rounded end must not leave out the neighbour that defines it
    return (near.withColumn("_k", within(F.col("_r")))
                .withColumn("_lo", F.least(F.col("value") - F.col("_r"), F.col("value"), *inside))
                .withColumn("_hi", F.greatest(F.col("value") + F.col("_r"), F.col("value"), *inside)))


def neighbour_mi(df: DataFrame, label: str, features: Sequence[str], fills: Mapping[str, float] | None = None,
                 k: int = NEIGHBOURS, threshold: float = MI_THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(feature, mi, n, selected); ``mi`` in nats, never below 0.

    ``fills`` replace missing values first. Values still missing or not finite, rows without a label and
    labels with a single value of the feature take no part; a feature of which nothing is left has no
    row. A label with fewer than k + 1 values uses all its others as neighbours. ``block`` must be at least k.
    """
    if block < k:
        raise ValueError(f"a block of {block} values has no room for {k} neighbours")
    fills = fills or {}
    filled = df.select(label, *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")),
                                           F.lit(fills.get(f)).cast("double")).alias(f) for f in features])
    long = unpivot(filled.filter(F.col(label).isNotNull()), [label], list(features))
    counts = (long.filter(F.abs("value") < float("inf")).groupBy("feature", label, "value")
                  .agg(F.count(F.lit(1)).alias("_c")))
    counts = materialise(counts, "neighbour-counts")
    sizes = counts.groupBy("feature", label).agg(F.sum("_c").alias("_ny")).filter("_ny > 1")
    kept = counts.join(sizes, ["feature", label])
    ranked = cumulative(kept.withColumn("_one", F.lit(1).cast("long")), ["feature", label], "value", ["_one"])
    ends = _ends(_with_neighbours(ranked, label, k, block), k)
    ends = materialise(ends.select("feature", label, "value", "_c", "_ny", "_k", "_lo", "_hi"), "neighbour-ends")

    # at one place: lower ends, then values, then upper ends; only values weigh, and equal values of several labels need not be one row
    def place(at, kind, weight):
        return F.struct(F.col(at).alias("_at"), F.lit(kind).alias("_kind"), weight.alias("_w"))
    none = F.lit(0).cast("long")
    three = F.array(place("_lo", 0, none), place("value", 1, F.col("_c")), place("_hi", 2, none))
    places = ends.withColumn("_p", F.explode(three)).select("feature", "_p.*", "value", label, "_c", "_ny", "_k")
    run = cumulative(places, ["feature"], "_at", ["_w"], tiebreak=["_kind"]).filter("_kind != 1")
    m = run.groupBy("feature", label, "value", "_c", "_ny", "_k").agg(
        (F.sum(F.when(F.col("_kind") == 2, F.col("cum__w")).otherwise(-F.col("cum__w"))) - 1).alias("_m"))
    term = F.col("_c") * (digamma(F.col("_k")) - digamma(F.col("_ny")) - digamma(F.col("_m")))
    out = m.groupBy("feature").agg(F.sum(term).alias("_s"), F.sum("_c").alias("n"))
    mi = F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("_s") / F.col("n"))
    return out.select("feature", mi.alias("mi"), "n").withColumn("selected", F.col("mi") >= threshold)
