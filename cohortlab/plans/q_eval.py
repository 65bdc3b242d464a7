"""Registered queries: splits, score curves, thresholds and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_out
from ..operators import curves, metrics, split
from . import frames
from .q_table import CORR_COLS, _corr_sql, _label_correlation_df
from .registry import query
from .sql_text import LABELLED, PREPARED, SCORES, engineered_cte, split_hash, with_ctes

R = round_out


def _sc(spark, sf_dir):
    return frames.scores(spark, sf_dir)


# ---------------------------------------------------------------- splits

@query("hash_split", with_ctes(PREPARED, body=(
    f"SELECT patient_id, ir_label, CASE WHEN {split_hash()} < 0.15 THEN 'test'"
    f" WHEN {split_hash()} < 0.3 THEN 'validation' ELSE 'train' END AS split FROM prepared")))
def hash_split(spark, sf_dir):
    df = frames.prepared(spark, sf_dir).select("patient_id", "ir_label")
    return split.hash_split(df, "patient_id")


@query("holdout_rebuild", with_ctes(PREPARED, body=(
    f"SELECT patient_id, ir_label FROM prepared WHERE {split_hash()} < 0.15")))
def holdout_rebuild(spark, sf_dir):
    df = frames.prepared(spark, sf_dir).select("patient_id", "ir_label")
    return split.hash_split(df, "patient_id").filter("split = 'test'").drop("split")


@query("hash_folds", with_ctes(PREPARED, body=(
    f"SELECT patient_id, CAST(floor({split_hash(salt='fold')} * 5) AS INTEGER) AS fold"
    " FROM prepared")))
def hash_folds(spark, sf_dir):
    df = frames.prepared(spark, sf_dir).select("patient_id")
    return split.hash_folds(df, "patient_id", 5)


@query("random_split", with_ctes(PREPARED, body=(
    f"SELECT patient_id, CASE WHEN {split_hash(salt='audit')} < 0.2 THEN 'test' ELSE 'train' END"
    " AS split FROM prepared")))
def random_split(spark, sf_dir):
    return split.random_split(frames.prepared(spark, sf_dir).select("patient_id"), "patient_id")


@query("exact_split", with_ctes(PREPARED, body=(
    "SELECT patient_id, ir_label, CASE WHEN rk <= round(n * 0.15) THEN 'test'"
    " WHEN rk <= round(n * 0.15) + round(n * 0.15) THEN 'validation' ELSE 'train' END AS split"
    f" FROM (SELECT patient_id, ir_label, row_number() OVER (PARTITION BY ir_label ORDER BY"
    f" {split_hash()}, patient_id) AS rk, count(*) OVER (PARTITION BY ir_label) AS n FROM prepared)")))
def exact_split(spark, sf_dir):
    df = frames.prepared(spark, sf_dir).select("patient_id", "ir_label")
    return split.exact_split(df, "patient_id", "ir_label")


@query("reference_sample", with_ctes(PREPARED, body=(
    f"SELECT patient_id, bmi, age FROM prepared ORDER BY {split_hash(salt='reference')},"
    " patient_id LIMIT 2000")))
def reference_sample(spark, sf_dir):
    df = frames.prepared(spark, sf_dir).select("patient_id", "bmi", "age")
    return split.reference_sample(df, "patient_id", 2000)


def _boot_sql(replicates=3):
    cdf = split.poisson_cdf()
    parts = []
    for b in range(replicates):
        u = split_hash(salt=f"boot{b}")
        w = " + ".join(f"CASE WHEN {u} >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in cdf)
        parts.append(
            f"SELECT {b} AS replicate, CAST(sum({w}) AS BIGINT) AS n_weighted,"
            f" sum(({w}) * ir_label) / sum({w}) AS prevalence, avg(CAST(ir_label AS DOUBLE)) AS base"
            " FROM prepared")
    return ("SELECT replicate, n_weighted, round(prevalence, 6) AS prevalence, round(base, 6) AS base,"
            " round(abs(prevalence - base), 6) AS abs_diff FROM (" + " UNION ALL ".join(parts) + ")")


@query("poisson_bootstrap", with_ctes(PREPARED, body=_boot_sql()))
def poisson_bootstrap(spark, sf_dir):
    df = frames.prepared(spark, sf_dir)
    b = split.poisson_bootstrap(df, "patient_id", "ir_label", 3)
    return b.select("replicate", "n_weighted", R("prevalence").alias("prevalence"),
                    R("base").alias("base"), R("abs_diff").alias("abs_diff"))


_DRAW = "((('0x' || substr(md5(concat('draw:', r.replicate, ':', d.i)), 1, 13))::BIGINT / 4503599627370496.0) * n.n)"


@query("bootstrap", with_ctes(PREPARED, f"""
n AS (SELECT count(*) AS n, avg(CAST(ir_label AS DOUBLE)) AS base FROM prepared),
ranked AS (SELECT row_number() OVER (ORDER BY patient_id) - 1 AS rank, ir_label FROM prepared),
draws AS (SELECT r.replicate, CAST(floor({_DRAW}) AS BIGINT) AS place FROM n
          CROSS JOIN (VALUES (0), (1), (2)) r(replicate) CROSS JOIN (SELECT row_number() OVER () - 1 AS i FROM prepared) d)""", body=(
    "SELECT replicate, count(*) AS n_draws, count(DISTINCT place) AS n_distinct, round(avg(CAST(ir_label AS DOUBLE)), 6) AS prevalence,"
    " round(any_value(n.base), 6) AS base, round(abs(avg(CAST(ir_label AS DOUBLE)) - any_value(n.base)), 6) AS abs_diff"
    " FROM draws JOIN ranked ON place = rank CROSS JOIN n GROUP BY replicate")))
def bootstrap(spark, sf_dir):
    """Resamples of exactly as many draws as rows."""
    b = split.bootstrap(frames.prepared(spark, sf_dir), "patient_id", "ir_label", 3)
    return b.select("replicate", "n_draws", "n_distinct", R("prevalence").alias("prevalence"), R("base").alias("base"),
                    R("abs_diff").alias("abs_diff"))


@query("ordered_split", with_ctes(PREPARED, body=(
    "SELECT patient_id, bmi, CASE WHEN bmi <= (SELECT quantile_cont(bmi, 0.7) FROM prepared)"
    " THEN 'train' ELSE 'test' END AS split FROM prepared")))
def ordered_split(spark, sf_dir):
    df = frames.prepared(spark, sf_dir).select("patient_id", "bmi")
    return split.ordered_split(df, "bmi", 0.7)


# ---------------------------------------------------------------- curves

_CURVE_SQL = """
counts AS (SELECT p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
           FROM scores GROUP BY p),
curve AS (SELECT p, pos, neg,
            sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
            sum(neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp,
            sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM counts)"""


def _curve(spark, sf_dir):
    return curves.score_curve(_sc(spark, sf_dir), "y", "p")


@query("roc_points", with_ctes(LABELLED, SCORES, _CURVE_SQL, body=(
    "SELECT round(p, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,"
    ' tp / n_pos AS tpr, fp / n_neg AS fpr FROM curve')))
def roc_points(spark, sf_dir):
    r = curves.roc_points(_curve(spark, sf_dir))
    return r.select(R("threshold").alias("threshold"), "tp", "fp", "tpr", "fpr")


@query("roc_auc", with_ctes(LABELLED, SCORES, _CURVE_SQL, body=(
    'SELECT CAST(sum(CAST(neg AS HUGEINT) * (2 * (tp - pos) + pos)) AS DOUBLE)'
    ' / (2.0 * max(n_pos) * max(n_neg)) AS roc_auc FROM curve')))
def roc_auc(spark, sf_dir):
    return curves.roc_auc(_curve(spark, sf_dir))


@query("pr_auc", with_ctes(LABELLED, SCORES, _CURVE_SQL, body=(
    'SELECT round(sum(CASE WHEN tp - pos < n_pos THEN pos / n_pos * (tp / (tp + fp)'
    ' + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0 ELSE (tp - pos) / (tp - pos + fp - neg) END)'
    ' / 2.0 ELSE 0.0 END), 6) AS pr_auc FROM curve')))
def pr_auc(spark, sf_dir):
    return curves.pr_auc(_curve(spark, sf_dir)).select(R("pr_auc").alias("pr_auc"))


@query("average_precision", with_ctes(LABELLED, SCORES, _CURVE_SQL, body=(
    'SELECT round(sum(pos / n_pos * (tp / (tp + fp))), 6) AS average_precision FROM curve')))
def average_precision(spark, sf_dir):
    ap = curves.average_precision(_curve(spark, sf_dir))
    return ap.select(R("average_precision").alias("average_precision"))


@query("youden", with_ctes(LABELLED, SCORES, _CURVE_SQL, body=(
    'SELECT round(CASE WHEN max(tp / n_pos - fp / n_neg) > 0 THEN arg_max(p, (tp / n_pos - fp / n_neg, p))'
    " ELSE 'inf'::DOUBLE END, 6) AS threshold,"
    ' round(greatest(max(tp / n_pos - fp / n_neg), 0.0), 6) AS j_score FROM curve')))
def youden(spark, sf_dir):
    y = curves.youden(_curve(spark, sf_dir))
    return y.select(R("threshold").alias("threshold"), R("j_score").alias("j_score"))


_GRID_SQL = """
grid AS (SELECT CAST(i AS INTEGER) * 0.01::DOUBLE AS threshold FROM range(0, 101) t(i)),
gc AS (SELECT g.threshold,
         CAST(count(CASE WHEN s.p >= g.threshold AND s.y = 1 THEN 1 END) AS BIGINT) AS tp,
         CAST(count(CASE WHEN s.p >= g.threshold AND s.y = 0 THEN 1 END) AS BIGINT) AS fp,
         CAST(count(CASE WHEN s.p < g.threshold AND s.y = 1 THEN 1 END) AS BIGINT) AS fn,
         CAST(count(CASE WHEN s.p < g.threshold AND s.y = 0 THEN 1 END) AS BIGINT) AS tn
       FROM grid g CROSS JOIN scores s GROUP BY g.threshold),
gm AS (SELECT *, coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1,
         coalesce(tp / NULLIF(tp + fn, 0), 0.0) AS recall,
         1.0 - fp / NULLIF(fp + tn, 0) AS specificity FROM gc)"""


def _grid(spark, sf_dir):
    return curves.threshold_grid(_sc(spark, sf_dir), "y", "p")


@query("threshold_grid", with_ctes(LABELLED, SCORES, _GRID_SQL, body=(
    "SELECT threshold, tp, fp, fn, tn, round(f1, 6) AS f1, round(recall, 6) AS recall,"
    " round(specificity, 6) AS specificity FROM gm")))
def threshold_grid(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return g.select("threshold", "tp", "fp", "fn", "tn", R("f1").alias("f1"),
                    R("recall").alias("recall"), R("specificity").alias("specificity"))


@query("f1_sweep", with_ctes(LABELLED, SCORES, _GRID_SQL, body=(
    "SELECT CASE WHEN max(f1) > 0 THEN arg_max(threshold, (f1, -threshold)) ELSE 0.5 END"
    " AS threshold, round(max(f1), 6) AS f1 FROM gm")))
def f1_sweep(spark, sf_dir):
    b = curves.f1_threshold(_grid(spark, sf_dir))
    return b.select("threshold", R("f1").alias("f1"))


@query("sensitivity_first", with_ctes(LABELLED, SCORES, _GRID_SQL, body=(
    "SELECT CASE WHEN max(s) > 0 THEN arg_max(threshold, (s, -threshold)) ELSE 0.5 END AS threshold,"
    " 0.9::DOUBLE AS sensitivity, round(CASE WHEN max(s) > 0 THEN max(s) ELSE 0.0 END, 6) AS specificity"
    " FROM (SELECT threshold, CASE WHEN recall >= 0.9 THEN coalesce(specificity, 0.0) ELSE -1.0 END"
    " AS s FROM gm)")))
def sensitivity_first(spark, sf_dir):
    b = curves.sensitivity_first(_grid(spark, sf_dir))
    return b.select("threshold", "sensitivity", R("specificity").alias("specificity"))


# ---------------------------------------------------------------- metrics

_CM = """
cm AS (SELECT count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS tp,
              count(CASE WHEN p >= 0.5 AND y = 0 THEN 1 END) AS fp,
              count(CASE WHEN p < 0.5 AND y = 1 THEN 1 END) AS fn,
              count(CASE WHEN p < 0.5 AND y = 0 THEN 1 END) AS tn FROM scores)"""


@query("threshold_metrics", with_ctes(LABELLED, SCORES, _CM, body=(
    "SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,"
    " round(coalesce(tp / NULLIF(tp + fp, 0), 0.0), 6) AS precision,"
    " round(coalesce(tp / NULLIF(tp + fn, 0), 0.0), 6) AS recall,"
    " round(coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0), 6) AS f1,"
    " round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / NULLIF(sqrt((tp + fp)::DOUBLE * (tp + fn)"
    " * (tn + fp) * (tn + fn)), 0), 0.0), 6) AS mcc FROM cm")))
def threshold_metrics(spark, sf_dir):
    m = metrics.threshold_metrics(_sc(spark, sf_dir))
    return m.select("tp", "fp", "fn", "tn", *[R(c).alias(c) for c in
                                              ("accuracy", "precision", "recall", "f1", "mcc")])


@query("brier", with_ctes(LABELLED, SCORES, body=(
    "SELECT round(avg(pow(p - y, 2)), 6) AS brier_score FROM scores")))
def brier(spark, sf_dir):
    return metrics.brier(_sc(spark, sf_dir)).select(R("brier_score").alias("brier_score"))


def _ece_case(col="p"):
    e = metrics.ECE_EDGES
    whens = " ".join(f"WHEN {col} > {e[i]!r}::DOUBLE AND {col} <= {e[i + 1]!r}::DOUBLE THEN {i}"
                     for i in range(len(e) - 1))
    return f"CASE {whens} END"


_REL_SQL = f"""
rel AS (SELECT bin, count(*) AS n,
          avg(CASE WHEN y = CAST(p >= 0.5 AS INTEGER) THEN 1.0 ELSE 0.0 END) AS bin_acc,
          avg(p) AS bin_conf, count(*) / (SELECT count(*) FROM scores) AS weight
        FROM (SELECT *, {_ece_case()} AS bin FROM scores) WHERE bin IS NOT NULL GROUP BY bin)"""


@query("reliability_bins", with_ctes(LABELLED, SCORES, _REL_SQL, body=(
    "SELECT bin, n, round(bin_acc, 6) AS bin_acc, round(bin_conf, 6) AS bin_conf, weight FROM rel")))
def reliability_bins(spark, sf_dir):
    r = metrics.reliability_bins(_sc(spark, sf_dir))
    return r.select("bin", "n", R("bin_acc").alias("bin_acc"), R("bin_conf").alias("bin_conf"),
                    "weight")


@query("ece", with_ctes(LABELLED, SCORES, _REL_SQL, body=(
    "SELECT round(sum(abs(bin_acc - bin_conf) * weight), 6) AS ece FROM rel")))
def ece(spark, sf_dir):
    return metrics.ece(_sc(spark, sf_dir)).select(R("ece").alias("ece"))


@query("confusion", with_ctes(LABELLED, SCORES, _CM, body=(
    "SELECT 1 AS actual, 1 AS predicted, tp AS n FROM cm UNION ALL SELECT 0, 1, fp FROM cm"
    " UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 0, 0, tn FROM cm")))
def confusion(spark, sf_dir):
    return metrics.confusion(_sc(spark, sf_dir))


@query("class_report", with_ctes(LABELLED, SCORES, _CM, """
pc AS (SELECT coalesce(tn / NULLIF(tn + fn, 0), 0.0) AS p0, coalesce(tn / NULLIF(tn + fp, 0), 0.0) AS r0,
  coalesce(2 * tn / NULLIF(2 * tn + fn + fp, 0), 0.0) AS f0, tn + fp AS s0,
  coalesce(tp / NULLIF(tp + fp, 0), 0.0) AS p1, coalesce(tp / NULLIF(tp + fn, 0), 0.0) AS r1,
  coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1, tp + fn AS s1 FROM cm)""", body=(
    "SELECT class_label, round(precision, 6) AS precision, round(recall, 6) AS recall,"
    " round(f1_score, 6) AS f1_score, support FROM ("
    "SELECT '0' AS class_label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM pc"
    " UNION ALL SELECT '1', p1, r1, f1, s1 FROM pc"
    " UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM pc"
    " UNION ALL SELECT 'weighted avg', p0 * s0 / (s0 + s1) + p1 * s1 / (s0 + s1),"
    " r0 * s0 / (s0 + s1) + r1 * s1 / (s0 + s1), f0 * s0 / (s0 + s1) + f1 * s1 / (s0 + s1), s0 + s1"
    " FROM pc)")))
def class_report(spark, sf_dir):
    r = metrics.class_report(_sc(spark, sf_dir))
    return r.select("class_label", *[R(c).alias(c) for c in ("precision", "recall", "f1_score")],
                    "support")


def _group_auc_sql(group_expr, name):
    return f"""
gcounts AS (SELECT {group_expr} AS {name}, p, CAST(sum(y) AS BIGINT) AS pos,
              CAST(sum(1 - y) AS BIGINT) AS neg FROM scores GROUP BY ALL),
gcurve AS (SELECT {name}, pos, neg,
  sum(pos) OVER (PARTITION BY {name} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(pos) OVER (PARTITION BY {name}) AS n_pos, sum(neg) OVER (PARTITION BY {name}) AS n_neg FROM gcounts),
gauc AS (SELECT {name}, CAST(sum(CAST(neg AS HUGEINT) * (2 * (tp - pos) + pos)) AS DOUBLE)
  / (2.0 * max(n_pos) * max(n_neg)) AS roc_auc FROM gcurve GROUP BY {name})"""


@query("fold_auc", with_ctes(LABELLED, SCORES, _group_auc_sql(
        f"CAST(floor({split_hash(salt='fold')} * 5) AS INTEGER)", "fold"),
        body="SELECT fold, roc_auc FROM gauc"))
def fold_auc(spark, sf_dir):
    s = split.hash_folds(_sc(spark, sf_dir), "patient_id", 5)
    return metrics.auc_by(s, ["fold"])


@query("cv_summary", with_ctes(LABELLED, SCORES, _group_auc_sql(
        f"CAST(floor({split_hash(salt='fold')} * 5) AS INTEGER)", "fold"), body=(
    "SELECT round(avg(roc_auc), 6) AS mean_auc, round(stddev_pop(roc_auc), 6) AS std_auc,"
    " count(*) AS n_folds FROM gauc")))
def cv_summary(spark, sf_dir):
    s = split.hash_folds(_sc(spark, sf_dir), "patient_id", 5)
    c = metrics.cv_summary(metrics.auc_by(s, ["fold"]))
    return c.select(R("mean_auc").alias("mean_auc"), R("std_auc").alias("std_auc"), "n_folds")


@query("generalisation_gap", with_ctes(LABELLED, SCORES, _group_auc_sql(
        f"CASE WHEN {split_hash()} < 0.15 THEN 'test' WHEN {split_hash()} < 0.3 THEN 'validation'"
        " ELSE 'train' END", "split"), body=(
    "SELECT round(max(CASE WHEN split = 'train' THEN roc_auc END), 6) AS train_auc,"
    " round(max(CASE WHEN split = 'validation' THEN roc_auc END), 6) AS val_auc,"
    " round(max(CASE WHEN split = 'train' THEN roc_auc END)"
    " - max(CASE WHEN split = 'validation' THEN roc_auc END), 6) AS gap FROM gauc")))
def generalisation_gap(spark, sf_dir):
    s = split.hash_split(_sc(spark, sf_dir), "patient_id")
    g = metrics.generalisation_gap(metrics.auc_by(s, ["split"]))
    return g.select(*[R(c).alias(c) for c in ("train_auc", "val_auc", "gap")])


@query("top_k_correlation", with_ctes(PREPARED, engineered_cte(), body=(
    "SELECT feature, corr, side FROM ("
    "(SELECT feature, corr, 'top' AS side FROM ({c}) ORDER BY corr DESC, feature LIMIT 10)"
    " UNION ALL (SELECT feature, corr, 'bottom' AS side FROM ({c}) ORDER BY corr ASC, feature LIMIT 10))"
).format(c=_corr_sql(CORR_COLS, "engineered"))))
def top_k_correlation(spark, sf_dir):
    corr = _label_correlation_df(spark, sf_dir).filter(F.col("corr").isNotNull())
    top = corr.orderBy(F.col("corr").desc(), "feature").limit(10).withColumn("side", F.lit("top"))
    bottom = corr.orderBy(F.col("corr").asc(), "feature").limit(10).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


# ---------------------------------------------------------------- text cohort (second label source)

_TEXT = """
text_scores AS (SELECT d.doc_id, l.quality AS y, CAST(d.n_chars AS DOUBLE) AS p
                FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tcounts AS (SELECT p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
            FROM text_scores GROUP BY p),
tcurve AS (SELECT pos, neg, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM tcounts)"""


def text_scores(spark, sf_dir):
    from ..sources.tables import read_table
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select("doc_id", F.col("quality").alias("y"),
                                        F.col("n_chars").cast("double").alias("p"))


@query("text_label_auc", with_ctes(_TEXT, body=(
    "SELECT CAST(sum(CAST(neg AS HUGEINT) * (2 * (tp - pos) + pos)) AS DOUBLE)"
    " / (2.0 * max(n_pos) * max(n_neg)) AS roc_auc, CAST(max(n_pos) AS BIGINT) AS n_pos,"
    " CAST(max(n_neg) AS BIGINT) AS n_neg FROM tcurve")))
def text_label_auc(spark, sf_dir):
    """How well document length ranks quality labels (documents joined to labels)."""
    return _auc_with_totals(curves.score_curve(text_scores(spark, sf_dir), "y", "p"))


def _auc_with_totals(c):
    term = (F.col("neg").cast("decimal(38,0)")
            * (2 * (F.col("tp") - F.col("pos")) + F.col("pos")).cast("decimal(38,0)"))
    g = c.agg(F.sum(term).alias("_num"), F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    return g.select((F.col("_num").cast("double") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
                    "n_pos", "n_neg")


@query("text_label_correlation", with_ctes(body=(
    "SELECT 'n_chars' AS feature, round(covar_pop(CAST(d.n_chars AS DOUBLE), CAST(l.quality AS DOUBLE))"
    " / NULLIF(stddev_pop(CAST(d.n_chars AS DOUBLE)) * stddev_pop(CAST(l.quality AS DOUBLE)), 0), 6) AS corr"
    " FROM documents d JOIN labels l ON d.doc_id = l.doc_id")))
def text_label_correlation(spark, sf_dir):
    from ..operators import profile
    s = text_scores(spark, sf_dir).select(F.col("p").alias("n_chars"), F.col("y").alias("quality"))
    c = profile.label_correlation(s, "quality", ["n_chars"])
    return c.select("feature", R("corr").alias("corr"))
