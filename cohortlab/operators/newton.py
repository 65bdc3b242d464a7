"""Many small logistic regressions over the same rows at once, by Newton steps.

Every fit has its own penalty and may leave one fold out. One pass over the rows adds up the
gradient and the Gram matrix of all fits (a few dozen numbers each); the driver solves for the
next coefficients. The number of passes is that of the slowest fit, not their sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 50
TOLERANCE = 1e-10             # largest change of a coefficient at which a fit is done


@dataclass
class Logistic:
    """log-odds = intercept + sum of weight * (x - mean) / scale."""

    columns: list[str]
    weights: list[float]
    intercept: float
    mean: list[float]
    scale: list[float]

    def log_odds(self) -> Column:
        out = F.lit(self.intercept)
        for c, w, m, s in zip(self.columns, self.weights, self.mean, self.scale):
            out = out + F.lit(w) * (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
        return out

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.log_odds()))


def sums(df: DataFrame, columns: Sequence[str], label: str, fold: str | None) -> dict[int, np.ndarray]:
    """fold -> (rows, positives, sum and sum of squares per column about 0.5)."""
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("p")]
    for i, c in enumerate(columns):
        d = F.col(c).cast("double") - 0.5
        aggs += [F.sum(d).alias(f"s{i}"), F.sum(d * d).alias(f"q{i}")]
    key = (F.col(fold) if fold else F.lit(0)).cast("int").alias("_f")
    rows = df.groupBy(key).agg(*aggs).collect()
    names = ["n", "p", *[f"{k}{i}" for i in range(len(columns)) for k in "sq"]]
    return {r["_f"]: np.array([r[c] for c in names], float) for r in rows}


def fit_many(df: DataFrame, columns: Sequence[str], label: str, fits: Sequence[tuple[float, int | None]], fold: str | None = None,
             standardise: bool = True, balanced: bool = True) -> list[Logistic]:
    """One regression per (C, fold left out or None): sum of weighted log-losses + |weights|**2 / (2 C).

    Class weights are n / (2 * rows of the class), mean and scale (sample deviation) those of the fit's own
    rows; a column without spread has scale 1. Rows with null columns are left out. A fit without rows of
    both labels has weights 0 and the log-odds of its label held within 20.
    """
    columns, d = list(columns), len(columns)
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("y"),
                     (F.col(fold) if fold else F.lit(0)).cast("int").alias("f")).dropna()
    totals = sums(rows, [f"x{i}" for i in range(d)], "y", "f")
    own = []
    for _, left_out in fits:
        t = sum((v for k, v in totals.items() if k != left_out), np.zeros(2 + 2 * d))
        n, pos = t[0], t[1]
        mean = t[2::2] / n if n else np.zeros(d)
        spread = np.sqrt(np.maximum(t[3::2] - n * mean * mean, 0) / (n - 1)) if n > 1 else np.zeros(d)
        own.append((n, pos, mean + 0.5 if standardise else np.zeros(d), np.where(spread > 1e-12, spread, 1.0) if standardise else np.ones(d)))
    live = np.array([0 < pos < n for n, pos, _, _ in own], bool)
    weight = np.array([[n / (2 * (n - p)), n / (2 * p)] if balanced and ok else [1.0, 1.0] for (n, p, _, _), ok in zip(own, live)])
    mean, scale = np.array([o[2] for o in own]), np.array([o[3] for o in own])
    held = np.array([-1 if f is None else f for _, f in fits])
    ridge = np.array([1 / c if np.isfinite(c) else 0.0 for c, _ in fits])
    beta = np.zeros((len(fits), d + 1))                     # the intercept last
    for i, (n, p, _, _) in enumerate(own):
        if not balanced and live[i]:
            beta[i, -1] = np.log(p / (n - p))
        elif not live[i]:
            beta[i, -1] = 0.0 if not n else (20.0 if p else -20.0)
    todo = live.copy()
    size = d + 1
    for _ in range(STEPS):
        if not todo.any():
            break
        at = np.flatnonzero(todo)

        def run(batches: Iterator[pa.RecordBatch], at=at, beta=beta.copy()) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(at), size + size * size + 1))
            for batch in batches:
                x = np.stack([batch.column(i).to_numpy() for i in range(d)], axis=1)
                y, f = batch.column("y").to_numpy(), batch.column("f").to_numpy()
                for k, i in enumerate(at):
                    keep = f != held[i]
                    z = np.concatenate([(x[keep] - mean[i]) / scale[i], np.ones((int(keep.sum()), 1))], axis=1)
                    m = z @ beta[i]
                    p = 1 / (1 + np.exp(-m))
                    w = weight[i][y[keep].astype(int)]
                    total[k, :size] += z.T @ (w * (p - y[keep]))
                    total[k, size:-1] += (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()
                    total[k, -1] += (w * (np.logaddexp(0, m) - y[keep] * m)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "v"])

        found = rows.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        total = np.zeros(len(at) * (size + size * size + 1))
        total[found.column("cell").to_numpy()] = found.column("v").to_numpy()
        for i, t in zip(at, total.reshape(len(at), -1)):
            penal = np.append(np.full(d, ridge[i]), 0.0)
            grad, gram = t[:size] + penal * beta[i], t[size:-1].reshape(size, size) + np.diag(penal + 1e-12 * own[i][0])
            step = np.linalg.solve(gram, grad)
            step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-300))      # far from the optimum a full step may overshoot
            beta[i] -= step
            todo[i] = np.abs(step).max() > TOLERANCE * max(1.0, np.abs(beta[i]).max())
    return [Logistic(columns, [float(v) for v in b[:-1]], float(b[-1]), [float(v) for v in m], [float(v) for v in s])
            for b, m, s in zip(beta, mean, scale)]
