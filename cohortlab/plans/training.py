"""End-to-end training run composed from the operators.

prepare -> hash split -> fill medians of the train split -> engineer -> drop
leakage inputs -> fit preprocessing on train -> leakage guard -> base learners
-> out-of-fold stacking -> meta learner (C by CV AUC) -> cross-fitted
calibration on the validation split -> thresholds on calibrated validation
scores -> metrics. Everything fitted, the fills of the engineered features
included, comes from the train split and travels in the bundle's state; every
later use (evaluation, validation, scoring) takes it from there.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting, curves, features, isotonic, metrics, models, newton, prep, profile, split
from ..operators.clean import LABEL
from ..session import materialise


@dataclass
class TrainConfig:
    max_iter: int = 200           # boosting rounds (production default)
    oof_folds: int = 5
    meta_folds: int = 3
    calibration_folds: int = 3
    include_categoricals: bool = False
    exact_medians: bool = True
    mi_estimator: str = "binned"  # or "neighbours"
    key: str = "patient_id"
    label: str = LABEL

    @staticmethod
    def quick() -> "TrainConfig":
        """Test-size settings: 10 rounds, 3 folds."""
        return TrainConfig(max_iter=10, oof_folds=3)


@dataclass
class Bundle:
    state: prep.PrepState
    base: dict
    meta: models.MetaModel
    calibrator: models.Calibrator
    thresholds: dict
    validation: dict = field(default_factory=dict)   # metrics of the calibrated stack on the validation split
    model_version: str = "v1"
    extras: dict = field(default_factory=dict)

    @property
    def threshold(self) -> float:
        return self.thresholds.get("f1_max", 0.5)

    def score(self, df: DataFrame, out: str = "probability") -> DataFrame:
        """All input columns plus ``out`` (calibrated stacked probability)."""
        x = prep.apply_prep(df, self.state, keep=[c for c in df.columns])
        x = models.add_scores(x, self.base)
        x = models.meta_score(x, self.meta, "_p_stack")
        x = models.apply_calibrator(x, self.calibrator, "_p_stack", out)
        return x.drop("_p_stack", *[f"p_{n}" for n in self.base])

    __call__ = score


def leakage_guard(df: DataFrame, label: str, cols: list[str]) -> list[str]:
    """Columns whose |corr| with the label exceeds 0.995 (raw glucose/insulin exempt)."""
    corr = profile.label_correlation(df, label, cols)
    bad = profile.leakage_report(corr, profile.TRAIN_LEAKAGE_CORR, profile.LEAKAGE_EXEMPT)
    return [r["feature"] for r in bad.collect()]


def fit_input_fills(prepared: DataFrame, cfg: TrainConfig) -> dict[str, float]:
    """Medians of the engineered features' inputs over the train split."""
    rows = split.hash_split(prepared, cfg.key).filter("split = 'train'")
    meds = profile.column_medians(rows, [c for c in features.FILL_INPUTS if c in prepared.columns],
                                  exact=cfg.exact_medians)
    return {c: float(v) for c, v in meds.items() if v is not None}


def prepare_training_frame(prepared: DataFrame, cfg: TrainConfig, fills: dict[str, float]) -> DataFrame:
    """Split first, then engineered features with the given (fitted) fills, without the leakage inputs."""
    eng = features.engineer(split.hash_split(prepared, cfg.key), fills)
    return features.drop_leakage_inputs(eng, keep=[cfg.label]).drop("ts")


def train(prepared: DataFrame, cfg: TrainConfig | None = None) -> tuple[Bundle, DataFrame]:
    """Returns the bundle and the validation-split scores (key, label, p_<model>..., p_stack, p_cal)."""
    cfg = cfg or TrainConfig()
    key, label = cfg.key, cfg.label
    # written once: every pass below reads a few files sized by their bytes, not the shuffle partitions of the caller's plan
    prepared = materialise(prepared, "prepared")
    fills = fit_input_fills(prepared, cfg)
    data = prepare_training_frame(prepared, cfg, fills)
    train_df = data.filter("split = 'train'").drop("split")
    state = prep.fit_prep(train_df, label, key=[key], exact=cfg.exact_medians, estimator=cfg.mi_estimator,
                          include_categoricals=cfg.include_categoricals)
    state.input_fills = fills
    x = prep.apply_prep(data, state, keep=[key, label, "split"])
    guard = leakage_guard(x.filter("split = 'train'"), label,
                          [c for c in state.selected if c in x.columns])
    if guard:
        state.selected = [c for c in state.selected if c not in guard]
    x = materialise(x.select(key, label, "split", *state.selected), "training-rows")
    tr, va = x.filter("split = 'train'"), x.filter("split = 'validation'")

    specs = models.default_specs(cfg.max_iter)
    base, fold_models = models.fit_stack_bases(tr, specs, label, key, state.selected, cfg.oof_folds)
    oof = models.oof_scores(tr, fold_models, label, key, cfg.oof_folds)
    p_cols = [f"p_{s.name}" for s in specs]
    meta = models.fit_meta(oof, label, p_cols, key, cv_folds=cfg.meta_folds)

    val = models.fold_average_scores(va, fold_models).drop(*state.selected)
    # calibration, thresholds and every metric read these scores: compute them once
    val = materialise(models.meta_score(val, meta, "p_stack"), "validation-scores")
    cal, val_cal = models.fit_calibrators(val, label, "p_stack", key, cfg.calibration_folds)
    val_cal = materialise(val_cal, "calibrated-scores")
    grid = curves.threshold_grid(val_cal, label, "p_cal")
    f1 = curves.f1_threshold(grid).collect()[0]
    yj = curves.youden(curves.score_curve(val_cal, label, "p_cal")).collect()[0]
    sens = curves.sensitivity_first(grid).collect()[0]
    thresholds = {"f1_max": float(f1["threshold"]), "f1": float(f1["f1"]),
                  "youden": float(yj["threshold"]), "j_score": float(yj["j_score"]),
                  "sensitivity_first": float(sens["threshold"]),
                  "specificity": float(sens["specificity"])}
    ev = metrics.evaluate(val_cal, label, "p_cal", t=thresholds["f1_max"]).collect()
    bundle = Bundle(state, base, meta, cal, thresholds,
                    validation={r["metric"]: r["value"] for r in ev},
                    extras={"guard_dropped": guard, "oof": oof, "fold_models": fold_models})
    return bundle, val_cal


def base_validation_metrics(bundle: Bundle, x_val: DataFrame, label: str) -> DataFrame:
    """Long metric table per base model on the validation split (full-train models)."""
    s = models.add_scores(x_val, bundle.base)
    rows = ", ".join(f"'{n}', `p_{n}`" for n in bundle.base)
    long = s.selectExpr(f"`{label}`", f"stack({len(bundle.base)}, {rows}) AS (model, p)")
    return metrics.evaluate(long, label, "p", by=["model"])


def save_bundle(bundle: Bundle, spark, path: str) -> None:
    """Node tables of the learners and JSON documents for the rest."""
    from ..operators.prep import save_state
    save_state(bundle.state, spark, f"{path}/prep_state")
    boosting.node_table(spark, list(bundle.base.values())).write.mode("overwrite").parquet(f"{path}/base")
    for i, m in enumerate(bundle.calibrator.models):
        if getattr(m, "cells", None):
            spark.read.parquet(m.cells).write.mode("overwrite").parquet(f"{path}/calibrator/{i}")
    doc = {"model_version": bundle.model_version, "thresholds": bundle.thresholds, "validation": bundle.validation,
           "best_c": bundle.meta.best_c, "p_cols": bundle.meta.p_cols, "meta": asdict(bundle.meta.model),
           "calibration": {"method": bundle.calibrator.method, "oof_brier": bundle.calibrator.oof_brier,
                           "models": [asdict(m) for m in bundle.calibrator.models]},
           "base": list(bundle.base), "features": bundle.state.selected}
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "doc string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark, path: str) -> Bundle:
    from ..operators.prep import load_state
    doc = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).collect()[0]["value"])
    found = {m.name: m for m in boosting.from_node_table(spark.read.parquet(f"{path}/base"), doc["features"])}
    base = {n: found[n] for n in doc["base"]}
    meta = models.MetaModel(newton.Logistic(**doc["meta"]), doc["best_c"], [], doc["p_cols"])
    own = doc["calibration"]
    if own["method"] == "sigmoid":
        cals = [newton.Logistic(**m) for m in own["models"]]
    else:
        cals = [isotonic.Steps(**(m | ({"cells": f"{path}/calibrator/{i}"} if m["cells"] else {}))) for i, m in enumerate(own["models"])]
    cal = models.Calibrator(own["method"], cals, own["oof_brier"])
    return Bundle(load_state(spark, f"{path}/prep_state"), base, meta, cal, doc["thresholds"],
                  doc["validation"], doc["model_version"])


def oof_auc(oof: DataFrame, label: str, p_cols: list[str]) -> DataFrame:
    """AUC per (model, fold) from the out-of-fold table: one grouped curve job."""
    names = [c[2:] for c in p_cols]
    rows = ", ".join(f"'{n}', `{c}`" for n, c in zip(names, p_cols))
    long = oof.selectExpr(label, "fold", f"stack({len(names)}, {rows}) AS (model, p)")
    return metrics.auc_by(long, ["model", "fold"], y=label, p="p")
