"""Buffered drift check of a stream: the last rows of each source, tested row by row, emptied by an alert.

The buffer is keyed state of the streaming query (its checkpoint holds it across batches and
restarts): the newest ``keep`` rows of a source. From ``least`` rows on every arriving row is
tested with the buffer against a reference sample; drift in any feature gives one alert and
empties the buffer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.drift import KS_ALPHA, exact_sf
from ..operators.split import reference_sample

KEEP, LEAST = 200, 50         # fixed values: rows of the buffer, and from how many on it is tested
REFERENCE_ROWS = 2000         # fixed value: rows of the reference sample


def reference_values(df: DataFrame, key: str, features: Sequence[str], rows: int = REFERENCE_ROWS) -> dict[str, list[float]]:
    """Sorted values per feature of a fixed-size sample; nulls and NaN are left out."""
    few = reference_sample(df, key, rows).select(*[F.col(f).cast("double").alias(f) for f in features]).collect()
    return {f: sorted(r[f] for r in few if r[f] is not None and r[f] == r[f]) for f in features}


@lru_cache(maxsize=100_000)
def critical_gap(m: int, n: int, alpha: float) -> int:
    """Smallest gap, in multiples of 1 / (m n), whose exact p-value is below ``alpha``; m n + 1 when none is."""
    low, high = 0, m * n + 1
    about = int(math.sqrt(-math.log(alpha / 2) / 2 * (m + n) / (m * n)) * m * n)      # the asymptotic one, to start near
    for guess in (int(0.9 * about), int(1.1 * about)):
        if low < guess < high:
            low, high = (low, guess) if exact_sf(guess / (m * n), m, n) < alpha else (guess, high)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if exact_sf(middle / (m * n), m, n) < alpha else (middle, high)
    return high


def largest_gap(new: np.ndarray, ref: np.ndarray) -> int:
    """Largest distance of the two empirical distributions in multiples of 1 / (m n); ``ref`` is sorted."""
    new = np.sort(new)
    # between two new values only the reference rises: the largest gap is at a new value or just before one
    at, n = np.searchsorted(ref, new, "right"), len(new)
    before = np.searchsorted(ref, new, "left")
    here = np.searchsorted(new, new, "right") * len(ref) - at * n
    below = np.searchsorted(new, new, "left") * len(ref) - before * n
    return int(max(np.abs(here).max(), np.abs(below).max()))


class Ring:
    """The buffer of one source; the same steps for a stream and for a replay of its rows."""

    def __init__(self, reference: Mapping[str, Sequence[float]], features: Sequence[str], keep: int = KEEP, least: int = LEAST,
                 alpha: float = KS_ALPHA, held: Sequence[float] = ()):
        self.reference = {f: np.asarray(reference[f], float) for f in features}
        self.features, self.keep, self.least, self.alpha = list(features), keep, least, alpha
        self.rows = np.asarray(held, float).reshape(-1, len(features))

    def add(self, row: Sequence[float]) -> tuple[list[str], int]:
        """(drifted features, rows tested) after one more row; an alert empties the buffer."""
        n = min(len(self.rows) + 1, self.keep)
        return next(((found, n) for _, found, n in self.extend([row])), ([], n))

    def extend(self, rows: Sequence[Sequence[float]]) -> list[tuple[int, list[str], int]]:
        """(place in ``rows``, drifted features, rows tested) of every alert, the rows taken one by one.

        One more row moves a feature's gap by at most the size of its reference, so a feature is compared again
        only when the gap last found could have reached the critical one; no alert is missed.
        """
        every = np.concatenate([self.rows, np.asarray(rows, float).reshape(-1, len(self.features))])
        told = ~np.isnan(every)
        n_told = np.concatenate([np.zeros((1, len(self.features)), int), np.cumsum(told, axis=0)])
        refs = [self.reference[f] for f in self.features]
        held, start, out = len(self.rows), 0, []
        end, most = held, [None] * len(refs)                # largest possible gap of each feature; None: not known
        while end < len(every):
            end = max(end + 1, min(start + self.least, len(every)))
            n = min(end - start, self.keep)
            if n < self.least:
                continue
            first, found = end - n, []
            for i, ref in enumerate(refs):
                m, own = len(ref), int(n_told[end, i] - n_told[first, i])
                most[i] = None if most[i] is None else most[i] + m
                if not m or not own or (most[i] is not None and most[i] < critical_gap(m, own, self.alpha)):
                    continue
                most[i] = largest_gap(every[first:end, i][told[first:end, i]], ref)
                if most[i] >= critical_gap(m, own, self.alpha):
                    found.append(self.features[i])
            if found:
                out.append((end - 1 - held, sorted(found), n))
                start, most = end, [None] * len(refs)
        self.rows = every[max(start, len(every) - self.keep):].copy()
        return out


ALERTS = "source string, ts timestamp, drift_features string, n_rows int"


def ring_alerts(stream: DataFrame, source: str, ts: str, order: str, reference: Mapping[str, Sequence[float]],
                keep: int = KEEP, least: int = LEAST, alpha: float = KS_ALPHA) -> DataFrame:
    """(source, ts, drift_features, n_rows) of every alert; rows of a batch are taken in order of (ts, order).

    ``reference`` has at most a few thousand values a feature (``reference_values``). Null features of a
    row are left out of the tests; rows without a source share one buffer.
    """
    features = sorted(reference)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches)).sort_values(["_ts", "_order"], kind="stable")
        ring = Ring(reference, features, keep, least, alpha, state.get[0] if state.exists else ())
        found, at = ring.extend(own[features].to_numpy(float)), own["_ts"]
        out = [(key[0], at.iloc[i], ",".join(names), n) for i, names, n in found]
        state.update((ring.rows.ravel().tolist(),))
        yield pd.DataFrame(out, columns=["source", "ts", "drift_features", "n_rows"])

    rows = stream.select(F.col(source).cast("string").alias("_source"), F.col(ts).cast("timestamp").alias("_ts"),
                         F.col(order).alias("_order"), *[F.col(f).cast("double").alias(f) for f in features])
    return rows.groupBy("_source").applyInPandasWithState(run, ALERTS, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def run_ring(stream: DataFrame, path: str, checkpoint: str, processing_time: str | None = None):
    """Append the alerts to ``path``; with ``processing_time`` the running query is returned, else it drains and ends."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if processing_time:
        return w.trigger(processingTime=processing_time).start()
    w.trigger(availableNow=True).start().awaitTermination()
    return None
