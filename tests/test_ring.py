"""Keyed ring buffer: the alerts of a stream in three files equal a sequential replay, with an alert in the middle."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from cohortlab.operators.drift import exact_sf
from cohortlab.streaming import ring

SCHEMA = "id long, ts timestamp, source string, a double, b double"
REFERENCE = {"a": sorted(np.random.default_rng(0).normal(size=400).tolist()), "b": sorted(np.random.default_rng(1).random(300).tolist())}


def rows_of(rng, n, first, shift):
    start = datetime.datetime(2024, 1, 1)
    return [(first + i, start + datetime.timedelta(seconds=first + i), "x" if i % 2 else "y",
             float(rng.normal()) + (shift if i % 2 else 0.0), None if i % 9 == 0 else float(rng.random())) for i in range(n)]


def test_stream_equals_replay(spark, tmp_path):
    rng = np.random.default_rng(5)
    files = [rows_of(rng, 150, 0, 0.0), rows_of(rng, 160, 150, 2.0), rows_of(rng, 140, 310, 0.0)]
    out, ck = str(tmp_path / "alerts"), str(tmp_path / "ck")
    for i, rows in enumerate(files):                        # each file drained by a run of its own: state survives restarts
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "src"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "src"))
        ring.run_ring(ring.ring_alerts(stream, "source", "ts", "id", REFERENCE, keep=60, least=30), out, ck)
    got = sorted((r.source, r.ts, r.drift_features, r.n_rows) for r in spark.read.parquet(out).collect())
    want, rings = [], {s: ring.Ring(REFERENCE, ["a", "b"], 60, 30) for s in "xy"}
    for i, ts, source, a, b in (r for f in files for r in f):
        found, n = rings[source].add([a, np.nan if b is None else b])
        if found:
            want.append((source, ts, ",".join(found), n))
    assert got == sorted(want)
    assert any(s == "x" and f == "a" for s, _, f, _ in got)          # the shifted source alerts
    assert len([g for g in got if g[0] == "x"]) >= 2 and all(n <= 60 for *_, n in got)


def test_buffer_is_emptied_by_an_alert_and_bounded():
    r = ring.Ring({"a": REFERENCE["a"]}, ["a"], keep=60, least=30)
    alerts = [i for i in range(100) if r.add([5.0])[0]]
    assert alerts == [29, 59, 89] and len(r.rows) == 10
    calm = ring.Ring({"a": REFERENCE["a"]}, ["a"], keep=60, least=30)
    shuffled = np.random.default_rng(2).permutation(REFERENCE["a"])[:100]
    assert not any(calm.add([float(v)])[0] for v in shuffled) and len(calm.rows) == 60


def test_reference_values(spark):
    df = spark.range(50).select("id", F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("a"))
    found = ring.reference_values(df, "id", ["a"], 1000)
    assert found["a"] == [float(i) for i in range(50) if i % 5]


def test_critical_gap_is_where_the_exact_value_passes():
    for m, n, alpha in ((300, 50, 0.01), (400, 31, 0.01), (7, 5, 0.05), (3, 2, 0.01)):
        h = ring.critical_gap(m, n, alpha)
        assert h == m * n + 1 or exact_sf(h / (m * n), m, n) < alpha
        assert exact_sf((h - 1) / (m * n), m, n) >= alpha


def drifted_every_row(rows, reference, features, alpha):
    """Plain check of one buffer: both distributions at every value."""
    out = []
    for i, f in enumerate(features):
        new, ref = np.sort(rows[~np.isnan(rows[:, i]), i]), np.asarray(reference[f])
        at = np.concatenate([new, ref])
        if not len(new) or not len(ref):
            continue
        gap = np.abs(np.searchsorted(new, at, "right") * len(ref) - np.searchsorted(ref, at, "right") * len(new)).max()
        if gap >= ring.critical_gap(len(ref), len(new), alpha):
            out.append(f)
    return out


def test_skipped_comparisons_miss_no_alert(monkeypatch):
    """Rows taken together alert exactly where a check of every row does, in far fewer comparisons."""
    rng = np.random.default_rng(7)
    n = 1500
    rows = np.stack([rng.normal(size=n) + np.repeat([0.0, 0.4, 0.0, 1.5, 0.0], n // 5), np.round(rng.random(n), 1)], axis=1)
    rows[rng.random((n, 2)) < 0.1] = np.nan
    rows[700:760, 1] = np.nan
    want, buffer = [], np.zeros((0, 2))
    for i, row in enumerate(rows):
        buffer = np.concatenate([buffer, [row]])[-60:]
        found = drifted_every_row(buffer, REFERENCE, ["a", "b"], 0.01) if len(buffer) >= 30 else []
        if found:
            want.append((i, found, len(buffer)))
            buffer = buffer[:0]
    calls, exact = [], ring.largest_gap
    monkeypatch.setattr(ring, "largest_gap", lambda *a: calls.append(1) or exact(*a))
    parts = ring.Ring(REFERENCE, ["a", "b"], 60, 30)
    got = [(first + i, f, k) for first in range(0, n, 250) for i, f, k in parts.extend(rows[first:first + 250])]
    assert got == want and len(want) >= 5
    assert np.array_equal(parts.rows, buffer, equal_nan=True)
    assert len(calls) < n                                  # two features: 2 n comparisons when every row is checked
    one = ring.Ring(REFERENCE, ["a", "b"], 60, 30)
    assert [(i, *r) for i, r in ((i, one.add(row)) for i, row in enumerate(rows)) if r[0]] == want
