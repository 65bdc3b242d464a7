"""Boosted learners, out-of-fold stacking and calibration.

The boosting itself is in ``boosting`` (all fits side by side), the small logistic regressions of
the meta learner and of the sigmoid calibration in ``newton`` (all fits in one pass), the isotonic
calibration in ``isotonic``. Fitted models are a few thousand numbers; scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import isotonic, metrics
from .boosting import Boosted, Fit, Learner, fit_all, with_probabilities
from .curves import roc_auc, score_curve
from .newton import Logistic, fit_many
from .split import hash_folds

SEED = 42
# fixed values: meta-learner inverse regularisation grid
META_C_GRID = (0.01, 0.1, 1.0, 10.0)


def default_specs(max_iter: int = 200) -> list[Learner]:
    """Four boosted learners, each with its own way to grow a tree.

    fixed values: depth 4, rows 0.85, columns 0.7 | 20 leaves, columns 0.8 (no row sampling: its
    bagging fraction is inactive without a bagging frequency) | symmetric, depth 4 | depth 3, rows
    0.8; rate 0.03 and 200 rounds each; penalties and least sizes are the learners' usual defaults.
    """
    return [
        Learner("gbt_d4_row85_col70", "level", depth=4, rows=0.85, columns=0.7, rounds=max_iter, l2=1.0, least_hessian=1.0),
        Learner("gbt_leaves20_col80", "leaf", leaves=20, columns=0.8, rounds=max_iter, l2=0.0, least_rows=20),
        Learner("gbt_symmetric_d4", "symmetric", depth=4, rounds=max_iter, l2=3.0),
        Learner("gbt_d3_row80", "level", depth=3, rows=0.8, rounds=max_iter, l2=0.0),
    ]


def positive_probability(col: str) -> F.Column:
    return vector_to_array(F.col(col))[1]


def fit_stack_bases(train: DataFrame, specs: Sequence[Learner], label: str, key: str, features: Sequence[str],
                    k: int = 5, salt: str = "oof") -> tuple[dict[str, Boosted], dict[tuple[str, int], Boosted]]:
    """(learner -> model on all rows, (learner, fold) -> model on the rows outside the fold), fitted side by side."""
    folded = hash_folds(train.select(key, label, *features), key, k, salt)
    fits = [Fit(s, f) for s in specs for f in (-1, *range(k))]
    found = fit_all(folded, key, label, features, fits, "fold")
    return ({f.learner.name: m for f, m in zip(fits, found) if f.fold < 0},
            {(f.learner.name, f.fold): m for f, m in zip(fits, found) if f.fold >= 0})


def add_scores(df: DataFrame, models: dict[str, Boosted], prefix: str = "p_") -> DataFrame:
    """One ``p_<name>`` column per model, from one pass over the feature columns."""
    return with_probabilities(df, list(models.values()), [f"{prefix}{n}" for n in models])


def oof_scores(train: DataFrame, fold_models: dict[tuple[str, int], Boosted], label: str, key: str,
               k: int = 5, salt: str = "oof") -> DataFrame:
    """Held-out score of every training row for every learner: (key, label, fold, p_<learner>...), stored.

    Each row is scored only by the models that left its fold out; no join.
    """
    names = list(dict.fromkeys(n for n, _ in fold_models))
    features = next(iter(fold_models.values())).features

    @F.pandas_udf(", ".join(f"m{i} double" for i in range(len(names))))
    def held_out(x):
        import pandas as pd

        values, fold = x.iloc[:, 1:].to_numpy(float), x.iloc[:, 0].to_numpy()
        out = np.full((len(x), len(names)), np.nan)
        for f in np.unique(fold).tolist():
            at = np.flatnonzero(fold == f)
            for i, n in enumerate(names):
                out[at, i] = 1 / (1 + np.exp(-fold_models[n, f].margins(values[at])))
        return pd.DataFrame(out, columns=[f"m{i}" for i in range(len(names))])

    t = hash_folds(train.select(key, label, *features), key, k, salt)
    row = F.struct(F.col("fold").cast("int").alias("f"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    scored = t.withColumn("_held", held_out(row))
    return materialise(scored.select(key, label, "fold", *[F.col(f"_held.m{i}").alias(f"p_{n}") for i, n in enumerate(names)]), "oof")


def fold_average_scores(df: DataFrame, fold_models: dict[tuple[str, int], Boosted], prefix: str = "p_") -> DataFrame:
    """Validation meta features: per learner, the mean score of its fold models."""
    order = sorted(fold_models)
    scored = with_probabilities(df, [fold_models[i] for i in order], [f"_f{n}" for n in range(len(order))])
    own: dict[str, list[str]] = {}
    for i, (n, _) in enumerate(order):
        own.setdefault(n, []).append(f"_f{i}")
    return scored.select(*df.columns, *[(sum(F.col(c) for c in cols) / len(cols)).alias(f"{prefix}{n}") for n, cols in own.items()])


# ------------------------------------------------------------------ meta learner

@dataclass
class MetaModel:
    model: Logistic
    best_c: float
    cv: list[tuple[float, float]]
    p_cols: list[str]


def _auc(df: DataFrame, y: str, p: str) -> float:
    return roc_auc(score_curve(df, y, p)).collect()[0]["roc_auc"]


def fit_meta(oof: DataFrame, label: str, p_cols: Sequence[str], key: str,
             c_grid: Sequence[float] = META_C_GRID, cv_folds: int = 3) -> MetaModel:
    """Pick C by mean 3-fold AUC (strict '>', first best in grid order); the model of that C on all rows.

    All (C, fold) fits and those on all rows share their passes. Class weights, mean and scale belong to
    the rows of each fit.
    """
    f = hash_folds(oof, key, cv_folds, "meta").persist(StorageLevel.MEMORY_AND_DISK)
    fits = [(c, k) for c in c_grid for k in (*range(cv_folds), None)]
    found = dict(zip(fits, fit_many(f, p_cols, label, fits, "fold")))
    held = [F.struct(F.lit(float(c)).alias("c"), F.coalesce(*[F.when(F.col("fold") == k, found[c, k].probability())
                                                              for k in range(cv_folds)]).alias("p")) for c in c_grid]
    long = f.select(label, "fold", F.explode(F.array(*held)).alias("s")).select(label, "fold", "s.c", "s.p")
    auc: dict[float, list[float]] = {}
    for r in metrics.auc_by(long, ["c", "fold"], y=label, p="p").collect():
        auc.setdefault(r["c"], []).append(r["roc_auc"])
    f.unpersist()
    best_c, best, table = 1.0, 0.0, []
    for c in c_grid:       # grid order, strict '>': the first best C wins
        values = [a for a in auc.get(float(c), []) if a is not None]
        mean = sum(sorted(values)) / len(values) if values else 0.0
        table.append((float(c), float(mean)))
        if mean > best:
            best, best_c = mean, c
    return MetaModel(found[best_c, None], float(best_c), table, list(p_cols))


def meta_score(df: DataFrame, meta: MetaModel, out: str = "p_stack") -> DataFrame:
    return df.withColumn(out, meta.model.probability())


# ------------------------------------------------------------------ calibration

def _logit(p: str) -> F.Column:
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.ln(q / (1 - q))


@dataclass
class Calibrator:
    method: str                    # "sigmoid" or "isotonic"
    models: list                   # one per fold; applied as their mean
    oof_brier: float


def calibrated(df: DataFrame, method: str, models: Sequence, p: str, outs: Sequence[str]) -> DataFrame:
    """``df`` with one calibrated column per model."""
    if method == "sigmoid":
        x = df.withColumn("_logit", _logit(p))
        return x.select(*df.columns, *[m.probability().alias(o) for m, o in zip(models, outs)])
    return isotonic.apply_steps(df, models, p, outs)


def apply_calibrator(df: DataFrame, cal: Calibrator, p: str, out: str = "p_cal") -> DataFrame:
    outs = [f"_c{i}" for i in range(len(cal.models))]
    scored = calibrated(df, cal.method, cal.models, p, outs)
    return scored.select(*df.columns, (sum(F.col(c) for c in outs) / len(outs)).alias(out))


def fit_calibrators(df: DataFrame, y: str, p: str, key: str, folds: int = 3,
                    methods: Sequence[str] = ("sigmoid", "isotonic")) -> tuple[Calibrator, DataFrame]:
    """Cross-fitted calibrators: each fold's rows are calibrated by the model fitted on the
    other folds; the method with the lower out-of-fold Brier wins."""
    f = hash_folds(df, key, folds, "calibration").persist(StorageLevel.MEMORY_AND_DISK)
    outs = [f"_c{i}" for i in range(folds)]
    best = None
    for method in methods:
        if method == "sigmoid":
            models = fit_many(f.withColumn("_logit", _logit(p)), ["_logit"], y, [(1e6, k) for k in range(folds)], "fold",
                              standardise=False, balanced=False)
        else:
            models = isotonic.fit_steps(f, p, y, "fold", folds)
        scored = calibrated(f, method, models, p, outs)
        oof = scored.select(*f.columns, F.coalesce(*[F.when(F.col("fold") == k, F.col(c)) for k, c in enumerate(outs)]).alias("p_cal"))
        b = oof.agg(F.avg(F.pow(F.col("p_cal") - F.col(y), 2))).collect()[0][0]
        if best is None or b < best[0].oof_brier:
            best = (Calibrator(method, models, float(b)), oof)
    f.unpersist()
    return best


# ------------------------------------------------------------------ audit importance

def rf_importance(df: DataFrame, label: str, feature_cols: Sequence[str], key: str,
                  trees: int = 50, depth: int = 5, test_share: float = 0.2) -> tuple[DataFrame, float]:
    """Mean-imputed numeric features, random forest on an 80/20 hash split:
    (feature, importance) rows and the held-out AUC."""
    from .split import random_split
    cols = list(feature_cols)
    imp = Imputer(inputCols=cols, outputCols=[f"_i_{c}" for c in cols], strategy="mean")
    data = random_split(df.select(key, label, *[F.col(c).cast("double") for c in cols]), key, test_share)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    pipe = Pipeline(stages=[imp, VectorAssembler(inputCols=[f"_i_{c}" for c in cols], outputCol="_x"),
                            RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees,
                                                   maxDepth=depth, seed=SEED, cacheNodeIds=True,
                                                   maxMemoryInMB=1024)]).fit(train)
    scored = pipe.transform(test).withColumn("_p", positive_probability("probability"))
    auc = _auc(scored, label, "_p")
    importances = pipe.stages[-1].featureImportances.toArray().tolist()
    data.unpersist()
    spark = df.sparkSession
    rows = spark.createDataFrame(list(zip(cols, [float(v) for v in importances])),
                                 "feature string, importance double")
    return rows, auc
