"""Score curves and threshold choice over score tables of any size.

Everything reads one intermediate, ``score_curve``: scores grouped by
value (ties collapse into one row, as in the library curve functions),
then global running sums of positives/negatives in descending score order
(bucketed, see :mod:`ordered`). Totals P and N per group come from the same
bucket table, so no join is needed; the three areas can be taken in one
aggregate (:func:`curve_summary`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cumulative

GRID_STEPS = 100  # thresholds 0.00, 0.01, ..., 1.00


def _group(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, list(by)
    return df.withColumn("_g", F.lit(0)), ["_g"]


def score_curve(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
                n_buckets: int | None = None, resolution: float | None = None) -> DataFrame:
    """(by..., score, pos, neg, tp, fp, n_pos, n_neg) with tp/fp = counts at score >= this score.

    Exact by default. ``resolution`` (e.g. 1e-6) floors scores to a grid first,
    bounding the curve at 1/resolution points per group for huge score sets.
    """
    keys = list(by)
    s = F.col(p) if resolution is None else F.floor(F.col(p) / resolution) * F.lit(resolution)
    counts = (df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
                .groupBy(*keys, s.alias("score"))
                .agg(F.sum(F.col(y).cast("long")).alias("pos"),
                     F.sum((1 - F.col(y)).cast("long")).alias("neg")))
    cum = cumulative(counts, keys, "score", ["pos", "neg"], descending=True, n_buckets=n_buckets,
                     totals=True)
    return (cum.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")
               .withColumnRenamed("tot_pos", "n_pos").withColumnRenamed("tot_neg", "n_neg"))


def roc_points(curve: DataFrame) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr); keeps collinear points (same area)."""
    return curve.select(*[c for c in curve.columns if c not in
                          ("score", "pos", "neg", "tp", "fp", "n_pos", "n_neg")],
                        F.col("score").alias("threshold"), "tp", "fp",
                        (F.col("tp") / F.col("n_pos")).alias("tpr"),
                        (F.col("fp") / F.col("n_neg")).alias("fpr"))


def _keys(curve: DataFrame) -> list[str]:
    return [c for c in curve.columns if c not in ("score", "pos", "neg", "tp", "fp", "n_pos", "n_neg")]


def _auc_term() -> F.Column:
    dec = "decimal(38,0)"
    above = F.col("tp") - F.col("pos")
    return F.col("neg").cast(dec) * (2 * above + F.col("pos")).cast(dec)


def _auc_value() -> F.Column:
    return F.try_divide(F.col("_num").cast("double"),
                        2.0 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """Area under ROC with ties counted one half; exact integer numerator."""
    keys = _keys(curve)
    agg = curve.groupBy(*keys).agg(F.sum(_auc_term()).alias("_num"), F.first("n_pos").alias("n_pos"),
                                   F.first("n_neg").alias("n_neg"))
    return agg.select(*keys, _auc_value().alias("roc_auc"))


def _prec(tp, fp):
    return F.try_divide(tp.cast("double"), (tp + fp).cast("double"))


def _pr_segment() -> F.Column:
    tp_prev = F.col("tp") - F.col("pos")
    fp_prev = F.col("fp") - F.col("neg")
    prec = _prec(F.col("tp"), F.col("fp"))
    prec_prev = F.when((tp_prev + fp_prev) == 0, F.lit(1.0)).otherwise(_prec(tp_prev, fp_prev))
    dr = F.col("pos") / F.col("n_pos")
    return F.when(tp_prev < F.col("n_pos"), dr * (prec + prec_prev) / 2.0).otherwise(F.lit(0.0))


def _ap_term() -> F.Column:
    return F.col("pos") / F.col("n_pos") * _prec(F.col("tp"), F.col("fp"))


def pr_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid area under the PR curve anchored at (recall 0, precision 1),
    stopping at the first point of full recall."""
    return curve.groupBy(*_keys(curve)).agg(F.sum(_pr_segment()).alias("pr_auc"))


def average_precision(curve: DataFrame) -> DataFrame:
    """sum over thresholds of (R_n - R_{n-1}) * P_n."""
    return curve.groupBy(*_keys(curve)).agg(F.sum(_ap_term()).alias("average_precision"))


def curve_summary(curve: DataFrame) -> DataFrame:
    """roc_auc, pr_auc and average_precision in one aggregate over the curve."""
    keys = _keys(curve)
    agg = curve.groupBy(*keys).agg(F.sum(_auc_term()).alias("_num"), F.first("n_pos").alias("n_pos"),
                                   F.first("n_neg").alias("n_neg"),
                                   F.sum(_pr_segment()).alias("pr_auc"),
                                   F.sum(_ap_term()).alias("average_precision"))
    return agg.select(*keys, _auc_value().alias("roc_auc"), "pr_auc", "average_precision")


def youden(curve: DataFrame) -> DataFrame:
    """argmax of tpr - fpr, first maximum = highest threshold; the (0,0) start
    point has threshold +inf and J = 0."""
    keys = _keys(curve)
    j = F.col("tp") / F.col("n_pos") - F.col("fp") / F.col("n_neg")
    best = curve.groupBy(*keys).agg(
        F.max_by(F.struct(j.alias("j"), F.col("score").alias("t")),
                 F.struct(j, F.col("score"))).alias("b"))
    return best.select(*keys,
                       F.when(F.col("b.j") > 0, F.col("b.t"))
                        .otherwise(F.lit(float("inf"))).alias("threshold"),
                       F.greatest(F.col("b.j"), F.lit(0.0)).alias("j_score"))


def grid_bin(p: str = "p", steps: int = GRID_STEPS) -> F.Column:
    """Largest i with i/steps (as i*0.01 in floating point) <= p, clamped to [0, steps]."""
    step = 1.0 / steps if steps != 100 else 0.01
    b0 = F.floor(F.col(p) * steps).cast("int")
    b1 = F.when(b0 * F.lit(step) > F.col(p), b0 - 1).otherwise(b0)
    b2 = F.when((b1 + 1) * F.lit(step) <= F.col(p), b1 + 1).otherwise(b1)
    return F.least(F.greatest(b2, F.lit(-1)), F.lit(steps))


def threshold_grid(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
                   steps: int = GRID_STEPS) -> DataFrame:
    """Confusion counts at every grid threshold t = i*0.01 with prediction p >= t.

    Scores are grouped into grid bins (one shuffle of at most steps+2 keys
    per group, with map-side partial aggregation), then suffix sums run
    over the 101-row grid -- never 101 scans and no join on raw rows.
    """
    df, keys = _group(df, by)
    step = 0.01 if steps == 100 else 1.0 / steps
    binned = (df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
                .groupBy(*keys, grid_bin(p, steps).alias("bin"))
                .agg(F.sum(F.col(y).cast("long")).alias("pos"),
                     F.sum((1 - F.col(y)).cast("long")).alias("neg")))
    groups = binned.select(*keys).distinct()
    # every group gets all grid rows: a join on the group keys against a
    # per-group copy of the fixed 101-row grid (groups are few: folds, splits)
    full = (groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(steps))))
                  .join(binned, on=[*keys, "bin"], how="full")
                  .fillna(0, subset=["pos", "neg"]))
    w_suffix = (Window.partitionBy(*keys).orderBy(F.col("bin").desc())
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    w_all = Window.partitionBy(*keys)
    g = full.select(*keys, "bin",
                    F.sum("pos").over(w_suffix).alias("tp"),
                    F.sum("neg").over(w_suffix).alias("fp"),
                    F.sum("pos").over(w_all).alias("n_pos"),
                    F.sum("neg").over(w_all).alias("n_neg"))
    g = g.filter(F.col("bin") >= 0)
    out = g.select(*keys, (F.col("bin") * F.lit(step)).alias("threshold"), "tp", "fp",
                   (F.col("n_pos") - F.col("tp")).alias("fn"), (F.col("n_neg") - F.col("fp")).alias("tn"))
    f1 = F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"),
                                 (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")),
                    F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"),
                                     (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    spec = 1.0 - F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double"))
    out = out.select("*", f1.alias("f1"), recall.alias("recall"), spec.alias("specificity"))
    return out if by else out.drop("_g")


def f1_threshold(grid: DataFrame) -> DataFrame:
    """Best F1 over the grid; strict '>' so the lowest tied threshold wins; 0.5 if all zero."""
    keys = [c for c in grid.columns if c not in
            ("threshold", "tp", "fp", "fn", "tn", "f1", "recall", "specificity")]
    best = grid.groupBy(*keys).agg(F.max_by(F.struct("f1", "threshold"),
                                            F.struct("f1", -F.col("threshold"))).alias("b"))
    return best.select(*keys, F.when(F.col("b.f1") > 0, F.col("b.threshold"))
                       .otherwise(F.lit(0.5)).alias("threshold"),
                       F.col("b.f1").alias("f1"))


def sensitivity_first(grid: DataFrame, min_recall: float = 0.90) -> DataFrame:
    """Among thresholds with recall >= min_recall, highest specificity (lowest t on ties);
    0.5 / 0.0 when none beats zero."""
    keys = [c for c in grid.columns if c not in
            ("threshold", "tp", "fp", "fn", "tn", "f1", "recall", "specificity")]
    spec = F.when(F.col("recall") >= min_recall, F.coalesce(F.col("specificity"), F.lit(0.0)))
    eligible = F.coalesce(spec, F.lit(-1.0))
    best = grid.groupBy(*keys).agg(F.max_by(
        F.struct(eligible.alias("s"), F.col("threshold").alias("t")),
        F.struct(eligible, -F.col("threshold"))).alias("b"))
    return best.select(*keys,
                       F.when(F.col("b.s") > 0, F.col("b.t")).otherwise(F.lit(0.5)).alias("threshold"),
                       F.lit(min_recall).alias("sensitivity"),
                       F.when(F.col("b.s") > 0, F.col("b.s")).otherwise(F.lit(0.0)).alias("specificity"))
