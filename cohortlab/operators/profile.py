"""Column profiling: medians, means, missingness, cardinality, label stats.

Each report is one aggregate pass over the table (all columns in one
``agg``), unpivoted with ``stack`` into a long table. Partial aggregation
happens map-side, so only one small row per task crosses the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .clean import INSULIN, LABEL, nan_to_null
from .ordered import exact_quantiles

# fixed values: routing and leakage thresholds
MAX_ONE_HOT_CARDINALITY = 50
TRAIN_LEAKAGE_CORR = 0.995
AUDIT_LEAKAGE_CORR = 0.95
LEAKAGE_EXEMPT = ("fasting_glucose", "fasting_insulin")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() == "string" and f.name not in exclude]


def _stack(wide: DataFrame, names: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """Unpivot ``<field><i>`` columns of a one-row frame into one row per name."""
    rows = ", ".join("'" + n + "', " + ", ".join(f"`{f}{i}`" for f in fields)
                     for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {rows}) AS ({out})")


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
            name: str = "feature", value: str = "value") -> DataFrame:
    """Long form (ids..., feature, value) with values cast to double."""
    wide = nan_to_null(df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]))
    return wide.unpivot(list(ids), list(cols), name, value)


def exact_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, median): exact medians, linear interpolation between the middle values.

    Distributed order statistics over value counts; no column's values are ever
    held in one buffer, at any size.
    """
    long = unpivot(df, [], list(cols))
    return exact_quantiles(long, ["feature"], "value", 0.5).withColumnRenamed("quantile", "median")


def column_medians(df: DataFrame, cols: Sequence[str], exact: bool = True,
                   accuracy: int = 10000) -> dict[str, float | None]:
    """Median per column. Exact: :func:`exact_medians`; approx: a mergeable sketch."""
    cols = list(cols)
    if not cols:
        return {}
    if exact:
        got = {r["feature"]: r["median"] for r in exact_medians(df, cols).collect()}
        return {c: got.get(c) for c in cols}
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(f"m{i}")
                   for i, c in enumerate(cols)]).collect()[0]
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    row = nan_to_null(df.select(*cols)).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def mean_fill(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict]:
    """Fill NULLs with the column mean (what a one-column kNN imputer reduces to)."""
    means = {k: v for k, v in column_means(df, cols).items() if v is not None}
    return df.fillna(means), means


def missingness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_missing, all_missing) for columns with any NULL or NaN."""
    cols = list(cols or df.columns)
    df = nan_to_null(df.select(*cols))
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"m{i}")
                    for i, c in enumerate(cols)])
    rows = ", ".join(f"'{c}', `m{i}`" for i, c in enumerate(cols))
    long = wide.selectExpr("_rows AS n_rows",
                           f"stack({len(cols)}, {rows}) AS (column_name, n_missing)")
    return (long.filter(F.col("n_missing") > 0)
                .withColumn("all_missing", F.col("n_missing") == F.col("n_rows"))
                .select("column_name", "n_rows", "n_missing", "all_missing"))


def cardinality_routing(df: DataFrame, cols: Sequence[str],
                        max_card: int = MAX_ONE_HOT_CARDINALITY) -> DataFrame:
    """(column_name, n_distinct, encoding): <= max_card distinct values -> one_hot, else ordinal.

    HyperLogLog first; only columns whose estimate does not rule the one-hot side out are
    counted, through their few distinct values. ``n_distinct`` is exact for one_hot columns
    and NULL for the others, whose size does not matter here.
    """
    cols = list(cols)
    est = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(cols)]).collect()[0]
    near = [c for i, c in enumerate(cols) if est[f"d{i}"] <= 1.25 * max_card]
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in near])
    counts = (text.unpivot([], near, "column_name", "_v") if near else
              df.sparkSession.createDataFrame([], "column_name string, _v string"))
    counts = (counts.filter("_v IS NOT NULL").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("_n"))
              .withColumnRenamed("column_name", "_c"))
    n = F.when(F.col("column_name").isin(near), F.coalesce("_n", F.lit(0)))
    few = F.coalesce(n <= max_card, F.lit(False))
    return names.join(counts, F.col("column_name") == F.col("_c"), "left").select(
        "column_name", F.when(few, n).alias("n_distinct"),
        F.when(few, "one_hot").otherwise("ordinal").alias("encoding"))


def label_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, n, share); NULL labels are not counted."""
    g = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the grouped result: one row per label value
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return g.select(F.col(label).alias("label"), "n", (F.col("n") / total).alias("share"))


def label_correlation(df: DataFrame, label: str = LABEL, cols: Sequence[str] | None = None,
                      key: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each numeric column with the label, pairwise deletion.

    Zero variance gives NULL (the ANSI ``corr`` would raise); every column is
    handled in one aggregate pass.
    """
    cols = list(cols or numeric_columns(df, exclude=list(key)))
    df = nan_to_null(df.select(*dict.fromkeys([label, *cols])))
    y = F.col(label).cast("double")
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        xp = F.when(y.isNotNull(), x)
        yp = F.when(x.isNotNull(), y)
        aggs.append(F.try_divide(F.covar_pop(xp, yp),
                                 F.stddev_pop(xp) * F.stddev_pop(yp)).alias(f"r{i}"))
    wide = df.agg(*aggs)
    return _stack(wide, cols, ["r"], "feature, corr")


def leakage_report(corr: DataFrame, threshold: float = AUDIT_LEAKAGE_CORR,
                   exempt: Sequence[str] = ()) -> DataFrame:
    """Features whose |corr| with the label exceeds the threshold."""
    return (corr.filter(F.abs("corr") > threshold)
                .filter(~F.col("feature").isin(list(exempt)) if exempt else F.lit(True)))


def shape_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))
