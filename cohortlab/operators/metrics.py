"""Classification and calibration metrics as aggregates over a score table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .curves import roc_auc, score_curve

# fixed values: ECE bin edges are numpy linspace(0, 1, 11) as doubles
ECE_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001,
             0.7000000000000001, 0.8, 0.9, 1.0]


def confusion_counts(df: DataFrame, y: str = "y", p: str = "p", t: float = 0.5,
                     by: Sequence[str] = ()) -> DataFrame:
    pred = F.col(p) >= t
    pos = F.col(y) == 1
    return df.groupBy(*by).agg(
        F.count(F.when(pred & pos, 1)).alias("tp"),
        F.count(F.when(pred & ~pos, 1)).alias("fp"),
        F.count(F.when(~pred & pos, 1)).alias("fn"),
        F.count(F.when(~pred & ~pos, 1)).alias("tn"))


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def threshold_metrics(df: DataFrame, y: str = "y", p: str = "p", t: float = 0.5,
                      by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, F1 (0 on 0/0) and MCC (0 when undefined) at p >= t."""
    c = confusion_counts(df, y, p, t, by)
    return c.select(*by, "tp", "fp", "fn", "tn", *_threshold_columns())


def _threshold_columns() -> list:
    """accuracy, precision, recall, f1 and mcc of the columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    mcc_den = F.sqrt((tp + fp).cast("double") * (tp + fn).cast("double")
                     * (tn + fp).cast("double") * (tn + fn).cast("double"))
    mcc = F.coalesce(F.try_divide(tp.cast("double") * tn.cast("double")
                                  - fp.cast("double") * fn.cast("double"), mcc_den), F.lit(0.0))
    return [_div(tp + tn, n).alias("accuracy"), _div(tp, tp + fp).alias("precision"),
            _div(tp, tp + fn).alias("recall"), _div(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc.alias("mcc")]


def brier(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier_score"))


def ece_bin(p: str = "p") -> F.Column:
    """Bin i holds p in (edge_i, edge_{i+1}]; p = 0 (or outside (0, 1]) is in no bin."""
    b = F.lit(None).cast("int")
    for i in range(len(ECE_EDGES) - 2, -1, -1):
        b = F.when((F.col(p) > ECE_EDGES[i]) & (F.col(p) <= ECE_EDGES[i + 1]), F.lit(i)).otherwise(b)
    return b


def reliability_bins(df: DataFrame, y: str = "y", p: str = "p",
                     by: Sequence[str] = ()) -> DataFrame:
    """Per-bin n, accuracy of (p >= 0.5) and mean confidence, weight over all rows."""
    keys = list(by)
    hit = (F.col(y) == (F.col(p) >= 0.5).cast("int")).cast("double")
    binned = df.select(*keys, y, p, ece_bin(p).alias("bin"), hit.alias("_hit"))
    g = (binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("bin_acc"),
                                          F.avg(p).alias("bin_conf")))
    # the total of a group is the sum over its bins, that of unbinned rows included: eleven rows a group
    g = g.withColumn("_n_all", F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))).filter(F.col("bin").isNotNull())
    return g.select(*by, "bin", "n", "bin_acc", "bin_conf",
                    (F.col("n") / F.col("_n_all")).alias("weight"))


def ece(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    rel = reliability_bins(df, y, p, by)
    return rel.groupBy(*by).agg(
        F.coalesce(F.sum(F.abs(F.col("bin_acc") - F.col("bin_conf")) * F.col("weight")),
                   F.lit(0.0)).alias("ece"))


def confusion(df: DataFrame, y: str = "y", p: str = "p", t: float = 0.5) -> DataFrame:
    """2x2 counts as (actual, predicted, n); zero cells are present."""
    c = confusion_counts(df, y, p, t)
    return c.selectExpr("stack(4, 1, 1, tp, 0, 1, fp, 1, 0, fn, 0, 0, tn) AS (actual, predicted, n)")


def class_report(df: DataFrame, y: str = "y", p: str = "p", t: float = 0.5) -> DataFrame:
    """Per class precision / recall / f1 / support, then macro and weighted averages."""
    c = confusion_counts(df, y, p, t)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    per = c.select(
        _div(tn, tn + fn).alias("p0"), _div(tn, tn + fp).alias("r0"),
        _div(2 * tn, 2 * tn + fn + fp).alias("f0"), (tn + fp).alias("s0"),
        _div(tp, tp + fp).alias("p1"), _div(tp, tp + fn).alias("r1"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("s1"))
    n = F.col("s0") + F.col("s1")
    w0, w1 = F.col("s0") / n, F.col("s1") / n
    wide = per.select(
        "*", ((F.col("p0") + F.col("p1")) / 2).alias("pm"), ((F.col("r0") + F.col("r1")) / 2).alias("rm"),
        ((F.col("f0") + F.col("f1")) / 2).alias("fm"), n.alias("sn"),
        (F.col("p0") * w0 + F.col("p1") * w1).alias("pw"), (F.col("r0") * w0 + F.col("r1") * w1).alias("rw"),
        (F.col("f0") * w0 + F.col("f1") * w1).alias("fw"))
    return wide.selectExpr(
        "stack(4, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, 'macro avg', pm, rm, fm, sn,"
        " 'weighted avg', pw, rw, fw, sn) AS (class_label, precision, recall, f1_score, support)")


def auc_by(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    return roc_auc(score_curve(df, y, p, by))


def cv_summary(fold_auc: DataFrame, value: str = "roc_auc", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of per-fold AUC."""
    return fold_auc.groupBy(*by).agg(F.avg(value).alias("mean_auc"),
                                     F.stddev_pop(value).alias("std_auc"),
                                     F.count(F.lit(1)).alias("n_folds"))


def generalisation_gap(split_auc: DataFrame, split: str = "split", value: str = "roc_auc",
                       by: Sequence[str] = (), train: str = "train",
                       held_out: str = "validation") -> DataFrame:
    """train AUC - held-out AUC, per model (or other grouping)."""
    g = split_auc.groupBy(*by).agg(
        F.max(F.when(F.col(split) == train, F.col(value))).alias("train_auc"),
        F.max(F.when(F.col(split) == held_out, F.col(value))).alias("val_auc"))
    return g.withColumn("gap", F.col("train_auc") - F.col("val_auc"))


def request_metrics(events: DataFrame, p: str = "probability", latency: str = "latency_ms",
                    by: Sequence[str] = ()) -> DataFrame:
    """requests_total, avg_prob, avg_latency_ms; a missing value counts as 0, zeros when empty."""
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests_total"),
        F.coalesce(F.avg(F.coalesce(F.col(p), F.lit(0.0))), F.lit(0.0)).alias("avg_prob"),
        F.coalesce(F.avg(F.coalesce(F.col(latency).cast("double"), F.lit(0.0))),
                   F.lit(0.0)).alias("avg_latency_ms"))


def last_n(events: DataFrame, n: int = 500, ts: str = "ts", tie: str = "trace_id") -> DataFrame:
    """Newest n events (top-k by time, no full sort)."""
    return events.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def _cells(df: DataFrame, y: str, p: str, t: float, keys: list[str]) -> DataFrame:
    """One row per (keys, confidence bin, none included): every sum the bin-wise and thresholded metrics need."""
    pred, pos = F.col(p) >= t, F.col(y) == 1
    hit = (F.col(y) == (F.col(p) >= 0.5).cast("int")).cast("double")
    return df.groupBy(*keys, ece_bin(p).alias("_bin")).agg(
        F.count(F.when(pred & pos, 1)).alias("tp"), F.count(F.when(pred & ~pos, 1)).alias("fp"),
        F.count(F.when(~pred & pos, 1)).alias("fn"), F.count(F.when(~pred & ~pos, 1)).alias("tn"),
        F.count(F.lit(1)).alias("_n"), F.avg(hit).alias("_acc"), F.avg(p).alias("_conf"),
        F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("_sq"), F.count(F.col(p) - F.col(y)).alias("_n_sq"))


def evaluate(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
             t: float = 0.5) -> DataFrame:
    """Long metric table (by..., metric, value): the ten validation metrics.

    Two aggregates over the scores: one over confidence bins (thresholded metrics,
    Brier, calibration error), one over distinct scores (the curve areas).
    """
    from .curves import curve_summary

    keys = list(by)
    quoted = [f"`{k}`" for k in keys]
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_acc") - F.col("_conf")) * F.col("_n"))
    total = _cells(df, y, p, t, keys).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "_sq", "_n_sq", "_n")], F.sum(gap).alias("_gap"))
    binned = total.select(
        *keys, *_threshold_columns(),
        F.try_divide(F.col("_sq"), F.col("_n_sq").cast("double")).alias("brier_score"),
        F.coalesce(F.try_divide(F.col("_gap"), F.col("_n").cast("double")), F.lit(0.0)).alias("ece"))
    names = ("accuracy", "precision", "recall", "f1", "mcc", "brier_score", "ece")
    areas = ("roc_auc", "pr_auc", "average_precision")

    def long(wide, metrics):
        return wide.selectExpr(*quoted, f"stack({len(metrics)}, "
                               + ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics) + ") AS (metric, value)")

    return long(binned, names).unionByName(long(curve_summary(score_curve(df, y, p, keys)), areas))


def validate_external(df: DataFrame, baseline_auc, y: str = "y", p: str = "p",
                      threshold: float = 0.5, max_drop: float = 0.10,
                      raise_on_fail: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """AUC, Brier and accuracy on another cohort (or several, ``by``) against a stored baseline.

    ``passed`` only when the AUC is defined and baseline - AUC <= max_drop (an absolute
    difference); a cohort of one class fails with ``status`` 'undefined'. ``baseline_auc``
    is a number or a column.
    """
    keys = list(by)
    # both classes or the areas are undefined; counted with the other sums in one aggregate
    other = df.groupBy(*keys).agg(
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier_score"),
        F.avg((F.col(y) == (F.col(p) >= threshold).cast("int")).cast("double")).alias("accuracy"))
    auc = roc_auc(score_curve(df, y, p, keys))
    joined = other.join(auc, keys, "left") if keys else other.withColumn("roc_auc", auc.scalar())
    base = baseline_auc if isinstance(baseline_auc, F.Column) else F.lit(baseline_auc).cast("double")
    out = joined.select(*keys, "roc_auc", "brier_score", "accuracy", base.alias("baseline_auc"),
                        (base - F.col("roc_auc")).alias("auc_drop"))
    passed = F.coalesce(F.col("auc_drop") <= max_drop, F.lit(False))
    out = out.withColumn("passed", passed).withColumn(
        "status", F.when(F.col("auc_drop").isNull(), "undefined").when(passed, "pass").otherwise("fail"))
    if raise_on_fail:
        for r in out.filter(~F.col("passed")).limit(1).collect():
            raise RuntimeError(f"external cohort not accepted: {r['status']}, AUC {r['roc_auc']} against a baseline of"
                               f" {r['baseline_auc']} (allowed drop {max_drop})")
    return out
