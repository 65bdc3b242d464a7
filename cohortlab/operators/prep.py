"""Fitted preprocessing: fill values, encoders and the selected column list.

``fit_prep`` runs a few aggregate passes and returns a small state (per-column
fills, one-hot category lists, ordinal dictionaries written as tables to the
shared checkpoint folder, selected features). ``apply_prep`` is then a pure
projection plus, for ordinal columns, a left join on the dictionary.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .clean import INSULIN
from .features import MISSING_CATEGORY
from .neighbours import neighbour_mi
from .ordered import by_ranges
from .profile import MAX_ONE_HOT_CARDINALITY, exact_medians, numeric_columns, string_columns
from .select import MI_BINS, MI_THRESHOLD, binned_mi


@dataclass
class PrepState:
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    one_hot: dict[str, list[str]]
    ordinal: dict[str, str]          # column -> dictionary table path
    selected: list[str]
    mi: list[tuple] = field(default_factory=list)
    input_fills: dict[str, float] = field(default_factory=dict)   # medians of the engineered features' inputs

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "PrepState":
        d = json.loads(text)
        d["mi"] = [tuple(x) for x in d.get("mi", [])]
        return PrepState(**d)


# ------------------------------------------------------------------ encoders

def one_hot_categories(df: DataFrame, cols: Sequence[str],
                       max_card: int = MAX_ONE_HOT_CARDINALITY) -> dict[str, list[str]]:
    """Sorted category list per column.

    The sets are gathered only after a HyperLogLog pass shows every column is
    near the limit; a column with more than ``max_card`` values must use the
    ordinal dictionary.
    """
    est = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(cols)]).collect()[0]
    wide = [c for i, c in enumerate(cols) if est[f"d{i}"] > 1.25 * max_card]
    found = {}
    if not wide:
        row = df.agg(*[F.sort_array(F.collect_set(c)).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
        found = {c: list(row[f"s{i}"]) for i, c in enumerate(cols)}
        wide = [c for c in cols if len(found[c]) > max_card]
    if wide:
        raise ValueError(f"too many categories for one-hot encoding: {wide}; use ordinal()")
    return found


def one_hot(df: DataFrame, categories: dict[str, list[str]], drop_source: bool = True) -> DataFrame:
    """``<col>_<value>`` = 1.0 where the value matches; unknown or NULL gives all zeros."""
    out = []
    for c, cats in categories.items():
        out += [F.when(F.col(c) == v, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}") for v in cats]
    keep = [c for c in df.columns if not (drop_source and c in categories)]
    return df.select(*keep, *out)


def ordinal_dictionary(df: DataFrame, col: str, n_buckets: int | None = None) -> DataFrame:
    """(category, idx): 0-based position of each distinct value in sorted order.

    A global sort without one task: the distinct values are dealt by ranges and
    written once; row_number inside a range plus the prefix sum of range sizes (a
    table of one row per range).
    """
    d = df.select(F.col(col).cast("string").alias("category")).filter("category IS NOT NULL").distinct()
    b = by_ranges(d, ["category"], n_buckets)
    sizes = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select("_bucket", F.coalesce(F.sum("_n").over(
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    ranked = b.join(offs, "_bucket").withColumn(
        "idx", (F.col("_off") + F.row_number().over(Window.partitionBy("_bucket").orderBy("category")) - 1)
        .cast("long"))
    return ranked.select("category", "idx")


def ordinal(df: DataFrame, col: str, dictionary: DataFrame) -> DataFrame:
    """Replace ``col`` by its dictionary index, -1 when unknown.

    The planner broadcasts a dictionary it has measured to be small. Otherwise this is
    a shuffle equi-join, and adaptive execution splits the rows of a category that is
    much larger than the others (the kept side of a left join may be split).
    """
    d = dictionary.withColumnRenamed("category", "_cat").withColumnRenamed("idx", "_idx")
    j = df.join(d, F.col(col).cast("string") == F.col("_cat"), "left")
    return j.withColumn(col, F.coalesce(F.col("_idx"), F.lit(-1)).cast("double")).drop("_cat", "_idx")


# ------------------------------------------------------------------ fit / apply

def fit_prep(df: DataFrame, label: str, key: Sequence[str] = (), exact: bool = False,
             mi_bins: int = MI_BINS, threshold: float = MI_THRESHOLD,
             include_categoricals: bool = False, max_card: int = MAX_ONE_HOT_CARDINALITY,
             path: str | None = None, estimator: str = "binned") -> PrepState:
    """Fit fills, encoders and the MI selection on ``df`` (the training split).

    The frame is persisted (recoverable from lineage) for the fit's passes:
    one aggregate for non-null counts, medians, the insulin mean and HLL
    cardinalities; one for the category sets of low-cardinality columns;
    then the ordinal dictionaries and the MI table (``estimator``: ``binned`` or ``neighbours``).
    """
    if estimator not in ("binned", "neighbours"):
        raise ValueError(f"no MI estimator {estimator!r}")
    spark = df.sparkSession
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    skip = set(key) | {label}
    numeric = numeric_columns(df, exclude=list(skip))
    categorical = string_columns(df, exclude=list(skip))
    aggs = []
    for i, c in enumerate(numeric):
        aggs.append(F.count(c).alias(f"n{i}"))
        if c != INSULIN and not exact:
            aggs.append(F.percentile_approx(F.col(c).cast("double"), 0.5, 10000).alias(f"m{i}"))
    if INSULIN in numeric:
        aggs.append(F.avg(INSULIN).alias("insulin_mean"))
    aggs += [F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(categorical)]
    row = df.agg(*aggs).collect()[0] if aggs else {}
    alive = [c for i, c in enumerate(numeric) if row[f"n{i}"] > 0]
    if exact:
        mcols = [c for c in alive if c != INSULIN]
        medians = ({r["feature"]: r["median"] for r in exact_medians(df, mcols).collect()}
                   if mcols else {})
    else:
        medians = {c: row[f"m{i}"] for i, c in enumerate(numeric) if c in alive and c != INSULIN}
    medians = {k: float(v) for k, v in medians.items() if v is not None}
    means = ({INSULIN: float(row["insulin_mean"])}
             if INSULIN in alive and row["insulin_mean"] is not None else {})
    numeric = alive

    card = {c: row[f"d{i}"] for i, c in enumerate(categorical)}
    near = [c for c in categorical if 0.8 * max_card <= card[c] <= 1.25 * max_card]
    low_guess = [c for c in categorical if card[c] <= 1.25 * max_card]
    cats = {}
    if low_guess:
        # bounded: HLL says these columns have at most ~60 values
        r2 = df.agg(*[F.sort_array(F.collect_set(c)).alias(f"s{i}")
                      for i, c in enumerate(low_guess)]).collect()[0]
        sets = {c: list(r2[f"s{i}"]) for i, c in enumerate(low_guess)}
        card.update({c: len(sets[c]) for c in near})
        cats = {c: sets[c] for c in low_guess if card[c] <= max_card}
    high = [c for c in categorical if card[c] > max_card]

    base = path or scratch_path(spark, f"prep-{uuid.uuid4().hex}")
    ordinal_paths = {}
    for c in high:
        p = f"{base}/ordinal_{c}"
        ordinal_dictionary(df, c).write.mode("overwrite").parquet(p)
        ordinal_paths[c] = p

    filled = df.fillna({**medians, **means})
    if estimator == "neighbours":
        found = neighbour_mi(filled, label, numeric, threshold=threshold)
    else:
        found = binned_mi(filled, label, numeric, mi_bins, threshold)
    mi_rows = found.collect() if numeric else []
    df.unpersist()
    mi = sorted(((r["feature"], float(r["mi"])) for r in mi_rows), key=lambda t: (-t[1], t[0]))
    picked = {f for f, v in mi if v >= threshold}
    selected = [c for c in numeric if c in picked]
    if include_categoricals:
        selected += [f"{c}_{v}" for c in cats for v in cats[c]] + high
    return PrepState(numeric, categorical, medians, means, cats, ordinal_paths, selected, mi)


def apply_prep(df: DataFrame, state: PrepState, keep: Sequence[str] = ()) -> DataFrame:
    """Align, fill, encode and select; unknown numeric columns fill with 0.0."""
    spark: SparkSession = df.sparkSession
    for c in state.numeric:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    for c in state.categorical:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(MISSING_CATEGORY))
    fills = {c: state.means.get(c, state.medians.get(c, 0.0)) for c in state.numeric}
    df = df.fillna(fills)
    # encode only what the selection uses
    df = one_hot(df, {c: v for c, v in state.one_hot.items() if any(f"{c}_{x}" in state.selected for x in v)})
    for c, p in state.ordinal.items():
        if c not in state.selected:
            continue
        df = ordinal(df, c, spark.read.parquet(p))
    keep = [c for c in keep if c in df.columns]
    cols = [c for c in state.selected if c in df.columns and c not in keep]
    return df.select(*keep, *cols)


def save_state(state: PrepState, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(state.to_json(),)], "state string").coalesce(1) \
        .write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str) -> PrepState:
    return PrepState.from_json(spark.read.json(path).collect()[0]["state"])
