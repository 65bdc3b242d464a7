"""Registered queries over trained models (rows-only checks: learner values are
not reproducible in SQL). A trained bundle is cached per session and scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_out
from ..operators import attribution, boosting, isotonic, metrics, models, split
from ..operators.ordered import cumulative
from ..operators.score import REQUIRED, score_all
from ..session import materialise
from ..sources.cohort import cohort
from . import frames
from .registry import query
from .sql_text import LABELLED, PREPARED, SCORES, split_hash, with_ctes
from .training import Bundle, TrainConfig, base_validation_metrics, prepare_training_frame, train

_CACHE: dict = {}
# The production settings: 200 rounds, five folds. Trained once a session and scale, every query below reuses it.
CONFIG = TrainConfig()
R = round_out


def trained(spark, sf_dir, cfg: TrainConfig | None = None) -> tuple[Bundle, object]:
    cfg = cfg or CONFIG
    k = (spark.sparkContext.applicationId, sf_dir, repr(cfg))
    if k not in _CACHE:
        _CACHE[k] = train(frames.prepared(spark, sf_dir), cfg)
    return _CACHE[k]


def _split_frame(spark, sf_dir, which):
    cfg = CONFIG
    b, _ = trained(spark, sf_dir, cfg)
    data = prepare_training_frame(frames.prepared(spark, sf_dir), cfg, b.state.input_fills)
    return data.filter(F.col("split") == which).drop("split")


@query("base_fit_scores")
def base_fit_scores(spark, sf_dir):
    """Validation metrics (long) of each full-train base learner."""
    b, _ = trained(spark, sf_dir)
    from ..operators import prep
    va = _split_frame(spark, sf_dir, "validation")
    x = prep.apply_prep(va, b.state, keep=["patient_id", "ir_label"])
    return base_validation_metrics(b, x, "ir_label")


@query("oof_scores")
def oof_scores(spark, sf_dir):
    """One held-out score per training row and model."""
    b, _ = trained(spark, sf_dir)
    return b.extras["oof"]


@query("meta_stack")
def meta_stack(spark, sf_dir):
    """Stacked validation scores (meta learner on fold-averaged base scores)."""
    _, val = trained(spark, sf_dir)
    return val.select("patient_id", "ir_label", "p_stack")


@query("calibrated_scores")
def calibrated_scores(spark, sf_dir):
    """Cross-fitted calibrated validation scores with the chosen method."""
    b, val = trained(spark, sf_dir)
    return val.select("patient_id", "ir_label", "p_stack", "p_cal",
                      F.lit(b.calibrator.method).alias("method"))


@query("test_report")
def test_report(spark, sf_dir):
    """Hold-out evaluation of the calibrated stack at the chosen threshold."""
    b, _ = trained(spark, sf_dir)
    # two aggregates over the scored split: score once
    te = materialise(b.score(_split_frame(spark, sf_dir, "test")).select("ir_label", "probability"), "test-scores")
    ev = metrics.evaluate(te, "ir_label", "probability", t=b.threshold)
    return ev.withColumn("threshold", F.lit(b.threshold))


@query("model_scored_batch")
def model_scored_batch(spark, sf_dir):
    """Batch scoring of the whole cohort with the trained bundle; bad rows quarantined."""
    b, _ = trained(spark, sf_dir)
    from ..operators import features as feat
    eng = feat.engineer(cohort(spark, sf_dir), b.state.input_fills)
    return score_all(eng, b.score, "patient_id", threshold=b.threshold, ts="ts",
                     features=b.state.selected or REQUIRED)


@query("rf_importance")
def rf_importance(spark, sf_dir):
    """Audit job: mean-imputed random forest, top-10 importances plus held-out AUC."""
    from ..operators import features as feat
    df = feat.engineer(frames.prepared(spark, sf_dir))
    cols = [c for c in ("age", "bmi", "triglycerides", "hdl_cholesterol", "waist_circumference",
                        "hip_circumference", "tg_hdl_ratio", "waist_hip_ratio", "age_bmi",
                        "triglycerides_log") if c in df.columns]
    imp, auc = models.rf_importance(df, "ir_label", cols, "patient_id")
    top = imp.orderBy(F.col("importance").desc(), "feature").limit(10)
    return top.withColumn("holdout_auc", F.lit(float(auc)))


@query("occlusion_top3")
def occlusion_top3(spark, sf_dir):
    """Top-3 occlusion attributions for every row of the prepared cohort."""
    b, _ = trained(spark, sf_dir)
    va = prepare_training_frame(frames.prepared(spark, sf_dir), CONFIG, b.state.input_fills).drop("split")
    fills = {c: b.state.medians[c] for c in b.state.selected if c in b.state.medians}
    return attribution.occlusion_top(va, "patient_id", b.state.selected, fills, b.score, k=3)


@query("hash_split_sizes", with_ctes(PREPARED, body=(
    f"SELECT CASE WHEN {split_hash()} < 0.15 THEN 'test' WHEN {split_hash()} < 0.3 THEN 'validation'"
    " ELSE 'train' END AS split, ir_label, count(*) AS n FROM prepared GROUP BY ALL")))
def hash_split_sizes(spark, sf_dir):
    """Split sizes per label (stratification check)."""
    df = split.hash_split(frames.prepared(spark, sf_dir), "patient_id")
    return df.groupBy("split", "ir_label").agg(F.count(F.lit(1)).alias("n"))


@query("model_cv_summary")
def model_cv_summary(spark, sf_dir):
    """Per learner: mean and population std of the out-of-fold AUC across folds."""
    from .training import oof_auc
    b, _ = trained(spark, sf_dir)
    p_cols = b.meta.p_cols
    return metrics.cv_summary(oof_auc(b.extras["oof"], "ir_label", p_cols), by=["model"])


@query("model_generalisation_gap")
def model_generalisation_gap(spark, sf_dir):
    """Per learner: train AUC minus validation AUC (full-train models)."""
    from ..operators import prep
    b, _ = trained(spark, sf_dir)
    cfg = CONFIG
    data = prepare_training_frame(frames.prepared(spark, sf_dir), cfg, b.state.input_fills).filter(
        F.col("split").isin("train", "validation"))
    s = models.add_scores(prep.apply_prep(data, b.state, keep=["patient_id", "ir_label", "split"]), b.base)
    names = list(b.base)
    rows = ", ".join(f"'{n}', `p_{n}`" for n in names)
    long = s.selectExpr("ir_label", "split", f"stack({len(names)}, {rows}) AS (model, p)")
    return metrics.generalisation_gap(metrics.auc_by(long, ["model", "split"], y="ir_label", p="p"),
                                      by=["model"])


@query("model_thresholds")
def model_thresholds(spark, sf_dir):
    """Thresholds chosen on calibrated validation scores, as written to the model document."""
    import uuid
    from ..session import scratch_path
    from .training import load_bundle, save_bundle
    b, _ = trained(spark, sf_dir)
    path = scratch_path(spark, f"bundle-{uuid.uuid4().hex}")
    save_bundle(b, spark, path)
    back = load_bundle(spark, path)
    rows = [(k, float(v)) for k, v in sorted(back.thresholds.items())]
    return spark.createDataFrame(rows, "name string, value double").withColumn(
        "calibration", F.lit(back.calibrator.method))


# ---------------------------------------------------------------- invariants that SQL can state
# learner values are not reproducible in SQL; counts, ranges and orders are

LEARNERS = [s.name for s in models.default_specs()]
_LEARNERS_SQL = ", ".join(f"('{n}')" for n in LEARNERS)
_VALIDATION_SQL = f"{split_hash()} >= 0.15 AND {split_hash()} < 0.3"


def _outside(c, lo=0.0):
    return F.count(F.when(F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > 1.0), 1))


@query("oof_invariants", with_ctes(PREPARED, f"""
f AS (SELECT patient_id, ir_label, CAST(floor({split_hash(salt='oof')} * {CONFIG.oof_folds}) AS INTEGER) AS fold
      FROM prepared WHERE {split_hash()} >= 0.3)""", body=(
    "SELECT m.model, f.fold, count(*) AS n, count(DISTINCT patient_id) AS n_keys, CAST(sum(ir_label) AS BIGINT) AS n_pos,"
    f" CAST(0 AS BIGINT) AS n_outside FROM f CROSS JOIN (VALUES {_LEARNERS_SQL}) m(model) GROUP BY m.model, f.fold")))
def oof_invariants(spark, sf_dir):
    """Per model and fold: every training row once, no score missing or outside [0, 1]."""
    b, _ = trained(spark, sf_dir)
    rows = ", ".join(f"'{n}', `p_{n}`" for n in LEARNERS)
    long = b.extras["oof"].selectExpr("patient_id", "ir_label", "fold", f"stack({len(LEARNERS)}, {rows}) AS (model, p)")
    return long.groupBy("model", F.col("fold").cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("n_keys"),
        F.sum(F.col("ir_label").cast("long")).alias("n_pos"), _outside("p").alias("n_outside"))


@query("base_fit_invariants", with_ctes(body=(
    f"SELECT m.model, CAST(10 AS BIGINT) AS n_metrics, CAST(0 AS BIGINT) AS n_outside FROM (VALUES {_LEARNERS_SQL}) m(model)")))
def base_fit_invariants(spark, sf_dir):
    """Per full-train learner: ten validation metrics, each inside its range (MCC from -1)."""
    m = base_fit_scores(spark, sf_dir).withColumn("v", F.when(F.col("metric") == "mcc", (F.col("value") + 1) / 2).otherwise(F.col("value")))
    return m.groupBy("model").agg(F.count(F.lit(1)).alias("n_metrics"), _outside("v").alias("n_outside"))


@query("calibration_invariants", with_ctes(PREPARED, body=(
    "SELECT ir_label, count(*) AS n, count(DISTINCT patient_id) AS n_keys, CAST(0 AS BIGINT) AS n_outside, true AS monotone"
    f" FROM prepared WHERE {_VALIDATION_SQL} GROUP BY ir_label")))
def calibration_invariants(spark, sf_dir):
    """Per label of the validation split: each row once, scores in [0, 1]; within a calibration fold
    the calibrated score never falls as the stacked score rises."""
    from pyspark.sql import Window
    _, val = trained(spark, sf_dir)
    v = split.hash_folds(val.select("patient_id", "ir_label", "p_stack", "p_cal"), "patient_id", CONFIG.calibration_folds, "calibration")
    # equal stacked scores get equal calibrated ones, so compare neighbours among distinct scores
    steps = v.groupBy("fold", "p_stack").agg(F.min("p_cal").alias("lo"), F.max("p_cal").alias("hi"))
    order = Window.partitionBy("fold").orderBy("p_stack")
    falls = (F.col("hi") - F.col("lo") > 1e-9) | (F.lag("hi").over(order) - F.col("lo") > 1e-9)
    broken = steps.select(falls.alias("f")).agg(F.count(F.when(F.col("f"), 1)).alias("n")).scalar()
    return v.groupBy("ir_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("n_keys"), _outside("p_cal").alias("n_outside")
    ).withColumn("monotone", broken == 0)


@query("test_split_invariants", with_ctes(PREPARED, body=(
    "SELECT ir_label, count(*) AS n, CAST(0 AS BIGINT) AS n_outside, CAST(10 AS BIGINT) AS n_metrics"
    f" FROM prepared WHERE {split_hash()} < 0.15 GROUP BY ir_label")))
def test_split_invariants(spark, sf_dir):
    """Per label of the hold-out: every row scored, in [0, 1]; ten defined metrics at the chosen threshold."""
    b, _ = trained(spark, sf_dir)
    te = materialise(b.score(_split_frame(spark, sf_dir, "test")).select("ir_label", "probability"), "test-scores")
    ev = metrics.evaluate(te, "ir_label", "probability", t=b.threshold)
    return te.groupBy("ir_label").agg(F.count(F.lit(1)).alias("n"), _outside("probability").alias("n_outside")).withColumn(
        "n_metrics", ev.agg(F.count("value")).scalar())


@query("occlusion_invariants", with_ctes(PREPARED, body=(
    "SELECT count(*) AS n, count(DISTINCT patient_id) AS n_keys, count(*) AS n_three, count(*) AS n_descending FROM prepared")))
def occlusion_invariants(spark, sf_dir):
    """Every row has three attributions, by falling size."""
    top = occlusion_top3(spark, sf_dir)
    size = F.transform("top", lambda t: F.abs(t["contribution"]))
    return top.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("n_keys"),
                   F.count(F.when(F.size("top") == 3, 1)).alias("n_three"),
                   F.count(F.when((size[0] >= size[1]) & (size[1] >= size[2]), 1)).alias("n_descending"))


@query("bundle_invariants", with_ctes(PREPARED, body=(
    f"SELECT count(*) AS n, count(*) AS n_equal, true AS same_document FROM prepared WHERE {_VALIDATION_SQL}")))
def bundle_invariants(spark, sf_dir):
    """A saved and loaded bundle scores the validation split as the fitted one, and its document holds the same values."""
    import uuid
    from ..session import scratch_path
    from .training import load_bundle, save_bundle
    b, _ = trained(spark, sf_dir)
    path = scratch_path(spark, f"bundle-{uuid.uuid4().hex}")
    save_bundle(b, spark, path)
    back = load_bundle(spark, path)
    va = _split_frame(spark, sf_dir, "validation")
    one = b.score(va).select("patient_id", F.col("probability").alias("p"))
    two = back.score(va).select("patient_id", F.col("probability").alias("q"))
    same = back.thresholds == b.thresholds and back.validation == b.validation and "roc_auc" in back.validation
    return one.join(two, "patient_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(F.col("p") - F.col("q")) < 1e-12, 1)).alias("n_equal")
    ).withColumn("same_document", F.lit(same))


@query("importance_invariants", with_ctes(body=(
    "SELECT CAST(10 AS BIGINT) AS n, CAST(10 AS BIGINT) AS n_names, 1.0::DOUBLE AS total, CAST(0 AS BIGINT) AS n_negative,"
    " true AS auc_above_half FROM (SELECT count(*) FROM cohort)")))
def importance_invariants(spark, sf_dir):
    """The audit forest's importances: one per feature, none negative, summing to one; better than chance."""
    top = rf_importance(spark, sf_dir)
    return top.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("feature").alias("n_names"), R(F.sum("importance")).alias("total"),
                   F.count(F.when(F.col("importance") < 0, 1)).alias("n_negative"), (F.min("holdout_auc") > 0.5).alias("auc_above_half"))


# ---------------------------------------------------------------- trees, attribution, isotonic blocks

_SHAPES_SQL = ", ".join(
    f"('{s.name}', {s.rounds}, {s.leaves if s.growth == 'leaf' else 2 ** s.depth})" for s in models.default_specs())


def _base_nodes(spark, sf_dir):
    b, _ = trained(spark, sf_dir)
    return materialise(boosting.node_table(spark, list(b.base.values())), "nodes").filter("tree >= 0")


@query("tree_shapes", (
    f"SELECT m.model, CAST(m.trees AS BIGINT) AS n_trees, CAST(m.leaves AS BIGINT) AS most_leaves, CAST(0 AS BIGINT) AS n_over,"
    f" CAST(0 AS BIGINT) AS n_mixed_levels, CAST(0 AS BIGINT) AS n_row_errors FROM (VALUES {_SHAPES_SQL}) m(model, trees, leaves)"))
def tree_shapes(spark, sf_dir):
    """Per full-train learner: its trees; trees with more leaves than it may have; levels of symmetric trees with
    more than one split; inner nodes whose children's rows don't add up to its own."""
    nodes = _base_nodes(spark, sf_dir)
    most = {s.name: (s.leaves if s.growth == "leaf" else 2 ** s.depth) for s in models.default_specs()}
    bound = F.coalesce(*[F.when(F.col("model") == n, F.lit(k).cast("long")) for n, k in most.items()])
    trees = nodes.groupBy("model", "tree").agg(F.count(F.when(F.col("left") == 0, 1)).alias("leaves"))
    over = trees.groupBy("model").agg(F.count(F.lit(1)).alias("n_trees"), F.max(bound).alias("most_leaves"),
                                      F.count(F.when(F.col("leaves") > bound, 1)).alias("n_over"))
    inner = nodes.filter("left > 0")
    rows = nodes.select("model", "tree", F.col("node").alias("child"), F.col("rows").alias("child_rows"))
    errors = (inner.withColumn("child", F.explode(F.array("left", "right"))).join(rows, ["model", "tree", "child"])
              .groupBy("model", "tree", "node", "rows").agg(F.sum("child_rows").alias("s"))
              .groupBy("model").agg(F.count(F.when(F.col("s") != F.col("rows"), 1)).alias("n_row_errors")))
    # nodes are numbered level by level, so a full level of a symmetric tree is a power-of-two range
    symmetric = [s.name for s in models.default_specs() if s.growth == "symmetric"]
    level = F.floor(F.log2((F.col("node") + 1).cast("double")) + 1e-9).cast("int")
    mixed = (inner.filter(F.col("model").isin(symmetric)).groupBy("model", "tree", level.alias("level"))
             .agg(F.count_distinct("feature", "threshold").alias("n"))
             .groupBy("model").agg(F.count(F.when(F.col("n") > 1, 1)).alias("n_mixed_levels")))
    return over.join(mixed, "model", "left").join(errors, "model", "left").select(
        "model", "n_trees", "most_leaves", "n_over", F.coalesce("n_mixed_levels", F.lit(0)).cast("long").alias("n_mixed_levels"),
        F.coalesce("n_row_errors", F.lit(0)).cast("long").alias("n_row_errors"))


def _attributions(spark, sf_dir):
    from ..operators import prep
    b, _ = trained(spark, sf_dir)
    va = prepare_training_frame(frames.prepared(spark, sf_dir), CONFIG, b.state.input_fills).drop("split")
    x = prep.apply_prep(va, b.state, keep=["patient_id"])
    return attribution.tree_attributions(x, "patient_id", [b.base[c[2:]] for c in b.meta.p_cols], b.meta.model.weights)


@query("tree_attribution_top3")
def tree_attribution_top3(spark, sf_dir):
    """Top-3 exact tree attributions of every row of the prepared cohort, base learners weighted by the meta coefficients."""
    return _attributions(spark, sf_dir).select("patient_id", "score", "expectation", "top")


@query("tree_attribution_invariants", with_ctes(PREPARED, body=(
    "SELECT count(*) AS n, count(DISTINCT patient_id) AS n_keys, count(*) AS n_additive, count(*) AS n_three,"
    " count(*) AS n_largest FROM prepared")))
def tree_attribution_invariants(spark, sf_dir):
    """Every row's contributions add up to score - expectation; its top three are the largest of all."""
    a = _attributions(spark, sf_dir)
    total = F.aggregate("contributions", F.lit(0.0), lambda t, c: t + c["contribution"])
    size = F.transform("top", lambda t: F.abs(t["contribution"]))
    every = F.array_sort(F.transform("contributions", lambda c: -F.abs(c["contribution"])))
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("n_keys"),
                 F.count(F.when(F.abs(total - (F.col("score") - F.col("expectation"))) < 1e-6, 1)).alias("n_additive"),
                 F.count(F.when(F.size("top") == 3, 1)).alias("n_three"),
                 F.count(F.when((size[0] >= size[1]) & (size[1] >= size[2]) & (size[2] == -every[2]), 1)).alias("n_largest"))


@query("isotonic_blocks", with_ctes(LABELLED, SCORES, body=(
    "SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, count(DISTINCT bmi) AS n_scores, CAST(0 AS BIGINT) AS n_not_rising,"
    " CAST(0 AS BIGINT) AS n_off_mean, CAST(0 AS BIGINT) AS n_early_low, CAST(0 AS BIGINT) AS n_outside FROM scores")))
def isotonic_blocks(spark, sf_dir):
    """Isotonic blocks of the label on bmi, held against what makes the isotonic regression unique: values rise from
    block to block, each is its block's mean, no beginning of a block has a lower mean, every score is in one block."""
    from pyspark.sql import Window
    scores = frames.scores(spark, sf_dir)
    s = scores.groupBy(F.col("bmi").cast("double").alias("x")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("m"))
    blocks = materialise(isotonic.fit_blocks(scores, "bmi", "y"), "blocks")
    # a running count of block starts gives every score its block; running sums from there
    marks = blocks.select(F.col("lo").alias("x"), F.struct("lo", "hi", "value", "n").alias("b"))
    both = cumulative(s.join(marks, "x", "left").withColumn("one", F.when(F.col("b").isNotNull(), 1).otherwise(0))
                      .withColumn("k", F.lit(0)), ["k"], "x", ["one", "pos", "m"])
    heads = both.filter("b IS NOT NULL").select("cum_one", F.col("b").alias("own"), (F.col("cum_pos") - F.col("pos")).alias("pos0"),
                                                (F.col("cum_m") - F.col("m")).alias("m0"))
    run = both.join(heads, "cum_one", "left").withColumn("mean", (F.col("cum_pos") - F.col("pos0")) / (F.col("cum_m") - F.col("m0")))
    order = Window.partitionBy("fit").orderBy("lo")
    falls = blocks.select(((F.lag("value").over(order) >= F.col("value")) | (F.lag("hi").over(order) >= F.col("lo"))).alias("f"))
    means = run.groupBy("cum_one").agg(F.first("own").alias("b"), F.sum("pos").alias("pos"), F.sum("m").alias("m"))
    off = (F.abs(F.col("pos") / F.col("m") - F.col("b.value")) > 1e-12) | (F.col("m") != F.col("b.n"))
    return run.agg(
        F.sum("m").alias("n"), F.sum("pos").cast("long").alias("n_pos"), F.count(F.lit(1)).alias("n_scores"),
        F.lit(falls.agg(F.count(F.when(F.col("f"), 1))).collect()[0][0]).cast("long").alias("n_not_rising"),
        F.lit(means.agg(F.count(F.when(off, 1))).collect()[0][0]).cast("long").alias("n_off_mean"),
        F.count(F.when(F.col("mean") < F.col("own.value") - 1e-12, 1)).alias("n_early_low"),
        F.count(F.when(F.col("own").isNull() | (F.col("x") > F.col("own.hi")), 1)).alias("n_outside"))
