"""ROC / PR / thresholds against brute-force definitions."""

import numpy as np

from cohortlab.operators import curves, metrics


def _scores(spark, n=400, seed=11):
    rnd = np.random.default_rng(seed)
    y = rnd.integers(0, 2, n)
    p = np.clip(np.round(0.3 * y + rnd.uniform(0, 0.7, n), 2), 0, 1)  # ties on purpose
    p[:3] = [0.0, 1.0, 0.5]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    return df, y, p


def _auc_pairs(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def _curve_np(y, p):
    th = np.unique(p)[::-1]
    tp = np.array([((p >= t) & (y == 1)).sum() for t in th])
    fp = np.array([((p >= t) & (y == 0)).sum() for t in th])
    return th, tp, fp


def test_auc(spark):
    df, y, p = _scores(spark)
    got = curves.roc_auc(curves.score_curve(df, n_buckets=4)).collect()[0][0]
    assert abs(got - _auc_pairs(y, p)) < 1e-12


def test_pr_auc_and_average_precision(spark):
    df, y, p = _scores(spark)
    th, tp, fp = _curve_np(y, p)
    P = (y == 1).sum()
    prec, rec = tp / (tp + fp), tp / P
    last = int(np.searchsorted(tp, P))
    r = np.r_[0.0, rec[: last + 1]]
    q = np.r_[1.0, prec[: last + 1]]
    pr = float(np.sum(np.diff(r) * (q[1:] + q[:-1]) / 2))
    ap = float(np.sum(np.diff(np.r_[0.0, rec]) * prec))
    c = curves.score_curve(df, n_buckets=3)
    assert abs(curves.pr_auc(c).collect()[0][0] - pr) < 1e-12
    assert abs(curves.average_precision(c).collect()[0][0] - ap) < 1e-12


def test_youden(spark):
    df, y, p = _scores(spark)
    th, tp, fp = _curve_np(y, p)
    j = tp / (y == 1).sum() - fp / (y == 0).sum()
    j = np.r_[0.0, j]
    th = np.r_[np.inf, th]
    i = int(np.argmax(j))
    got = curves.youden(curves.score_curve(df)).collect()[0]
    assert got["threshold"] == th[i] and abs(got["j_score"] - j[i]) < 1e-12


def test_threshold_grid_and_choices(spark):
    df, y, p = _scores(spark)
    grid = {round(r.threshold, 2): r for r in curves.threshold_grid(df).collect()}
    best_f1, best_t, best_spec, best_ts = 0.0, 0.5, 0.0, 0.5
    for i in range(101):
        t = i * 0.01
        pred = p >= t
        tp = int((pred & (y == 1)).sum()); fp = int((pred & (y == 0)).sum())
        fn = int((~pred & (y == 1)).sum())
        g = grid[round(t, 2)]
        assert (g.tp, g.fp, g.fn) == (tp, fp, fn)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        if f1 > best_f1:
            best_f1, best_t = f1, t
        if tp / (y == 1).sum() >= 0.9:
            spec = 1 - fp / (y == 0).sum()
            if spec > best_spec:
                best_spec, best_ts = spec, t
    g = curves.threshold_grid(df)
    f = curves.f1_threshold(g).collect()[0]
    s = curves.sensitivity_first(g).collect()[0]
    assert f.threshold == best_t and abs(f.f1 - best_f1) < 1e-12
    assert s.threshold == best_ts and abs(s.specificity - best_spec) < 1e-12


def test_threshold_metrics_and_brier(spark):
    df, y, p = _scores(spark)
    m = metrics.threshold_metrics(df).collect()[0]
    pred = p >= 0.5
    assert m.tp == int((pred & (y == 1)).sum())
    assert abs(metrics.brier(df).collect()[0][0] - float(np.mean((p - y) ** 2))) < 1e-12


def test_grouped_auc(spark):
    df, y, p = _scores(spark)
    from pyspark.sql import functions as F
    g = df.withColumn("k", F.round(F.col("p") * 100).cast("int") % 2)
    rows = metrics.auc_by(g, ["k"]).collect()
    assert len(rows) == 2 and all(0 <= r.roc_auc <= 1 for r in rows)


def test_resolution_bounds_curve_and_keeps_auc_close(spark):
    df, y, p = _scores(spark)
    exact = curves.roc_auc(curves.score_curve(df)).collect()[0][0]
    coarse_curve = curves.score_curve(df, resolution=0.05)
    assert coarse_curve.count() <= 21
    assert abs(curves.roc_auc(coarse_curve).collect()[0][0] - exact) < 0.05
