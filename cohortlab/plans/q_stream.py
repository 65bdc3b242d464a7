"""Registered queries: Structured Streaming jobs drained with availableNow and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import round_out
from ..operators import score
from ..operators.drift import value_counts
from ..session import materialise, scratch_path
from ..sources.tables import read_table
from ..streaming import events as ev
from .q_io import PE
from .registry import query
from .sql_text import with_ctes

R = round_out


def _dirs(spark, name):
    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    return f"{base}/out", f"{base}/checkpoint"


@query("stream_events", with_ctes(PE, body=(
    "SELECT trace_id, ts, round(probability, 6) AS probability, latency_ms,"
    " CAST(probability >= 0.5 AS INTEGER) AS prediction, CASE WHEN probability < 0.33 THEN 'low'"
    " WHEN probability < 0.67 THEN 'medium' ELSE 'high' END AS risk_level FROM pe")))
def stream_events(spark, sf_dir):
    out, ck = _dirs(spark, "stream-events")
    ev.run_to_table(ev.to_predictions(ev.read_event_stream(spark, f"{sf_dir}/events.parquet")), out, ck)
    df = spark.read.parquet(out)
    return df.select("trace_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
                     R("probability").alias("probability"), "latency_ms", "prediction", "risk_level")


@query("stream_windowed_metrics", with_ctes(PE, body=(
    "SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,"
    " count(*) AS requests_total, round(avg(probability), 6) AS avg_prob,"
    " round(avg(CAST(latency_ms AS DOUBLE)), 6) AS avg_latency_ms FROM pe GROUP BY date_trunc('day', ts)"
    " HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM pe) - INTERVAL 1 HOUR")))
def stream_windowed_metrics(spark, sf_dir):
    out, ck = _dirs(spark, "stream-windows")
    s = ev.windowed_metrics(ev.to_predictions(ev.read_event_stream(spark, f"{sf_dir}/events.parquet")), "1 day", "1 hour")
    ev.run_to_table(s, out, ck)
    df = spark.read.parquet(out)
    return df.select("window_start", "window_end", "requests_total",
                     R("avg_prob").alias("avg_prob"), R("avg_latency_ms").alias("avg_latency_ms"))


@query("stream_dedup", with_ctes(PE, body=(
    "SELECT trace_id, round(probability, 6) AS probability FROM pe")))
def stream_dedup(spark, sf_dir):
    """The event log read twice (a replay) and de-duplicated by trace id."""
    out, ck = _dirs(spark, "stream-dedup")
    a = ev.to_predictions(ev.read_event_stream(spark, f"{sf_dir}/events.parquet"))
    b = ev.to_predictions(ev.read_event_stream(spark, f"{sf_dir}/events.parquet"))
    ev.run_to_table(ev.dedup(a.unionByName(b)), out, ck)
    df = spark.read.parquet(out)
    return df.select("trace_id", R("probability").alias("probability"))


STREAM_SCORER = score.LinearScorer({"value": 0.01}, intercept=-2.5)


@query("stream_scored", with_ctes(body=(
    "SELECT event_id, CASE WHEN value IS NULL OR user_id IS NULL THEN 'quarantined' ELSE 'scored' END AS status,"
    f" round({STREAM_SCORER.sql()}, 6) AS probability, CAST({STREAM_SCORER.sql()} >= 0.4 AS INTEGER) AS prediction,"
    " CAST(0.4 AS DOUBLE) AS threshold_used, 'v7' AS model_version,"
    " md5(concat('v7:', CAST(event_id AS VARCHAR))) AS trace_id, ts FROM events")))
def stream_scored(spark, sf_dir):
    """The event stream through the batch scorer into a sink partitioned by status; equal to the batch result."""
    out, ck = _dirs(spark, "stream-scored")
    events = ev.read_event_stream(spark, f"{sf_dir}/events.parquet")
    ev.run_scored(ev.scored_events(events, STREAM_SCORER, "event_id", threshold=0.4, model_version="v7", ts="ts",
                                   features=("value", "user_id"), required=("value", "user_id")), out, ck)
    df = spark.read.parquet(out)
    return df.select("event_id", "status", R("probability").alias("probability"), "prediction", "threshold_used",
                     "model_version", "trace_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


DRIFT_WINDOW, DRIFT_ROWS = "4 hours", 50


def _stream_drift_sql():
    from ..operators.drift import KS_TERMS
    lam = "(d * sqrt(n_ref * n_new / (n_ref + n_new)))"
    series = " + ".join(f"{2.0 * (-1) ** (k - 1)!r} * exp({-2.0 * k * k!r} * {lam} * {lam})"
                        for k in range(1, KS_TERMS + 1))
    p = f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(greatest({series}, 0.0), 1.0) END"
    return with_ctes(PE, f"""
ref AS (SELECT probability, CAST(latency_ms AS DOUBLE) AS latency_ms FROM pe
        WHERE ts < TIMESTAMP '2024-01-08'),
new AS (SELECT time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, probability,
          CAST(latency_ms AS DOUBLE) AS latency_ms FROM pe),
wins AS (SELECT window_start FROM new GROUP BY window_start HAVING count(*) >= {DRIFT_ROWS}
         AND window_start + INTERVAL 4 HOURS <= (SELECT max(ts) FROM pe) - INTERVAL 1 HOUR),
rlong AS (SELECT 'probability' AS feature, probability AS value FROM ref
          UNION ALL SELECT 'latency_ms', latency_ms FROM ref),
long AS (SELECT w.window_start, r.feature, r.value, 0 AS side FROM wins w CROSS JOIN rlong r
         UNION ALL SELECT window_start, 'probability', probability, 1 FROM new SEMI JOIN wins USING (window_start)
         UNION ALL SELECT window_start, 'latency_ms', latency_ms, 1 FROM new SEMI JOIN wins USING (window_start)),
cnt AS (SELECT window_start, feature, value, count(CASE WHEN side = 0 THEN 1 END) AS c_ref,
          count(CASE WHEN side = 1 THEN 1 END) AS c_new FROM long
        WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY window_start, feature, value),
cum AS (SELECT window_start, feature, sum(c_ref) OVER w AS cr, sum(c_new) OVER w AS cn,
          sum(c_ref) OVER (PARTITION BY window_start, feature) AS nr,
          sum(c_new) OVER (PARTITION BY window_start, feature) AS nn
        FROM cnt WINDOW w AS (PARTITION BY window_start, feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks0 AS (SELECT window_start, feature, max(abs(cr / nr - cn / nn)) AS d, CAST(max(nr) AS BIGINT) AS n_ref,
          CAST(max(nn) AS BIGINT) AS n_new FROM cum GROUP BY window_start, feature
        HAVING max(nr) > 0 AND max(nn) > 0),
ks AS (SELECT window_start, feature, d, n_ref, n_new, {p} AS p_value FROM ks0)""", body=(
        "SELECT k.window_start, k.feature, round(k.d, 6) AS d, k.n_ref, k.n_new, round(k.p_value, 6) AS p_value,"
        " k.p_value < 0.01 AS drifted, a.drift_features IS NOT NULL AS alerted,"
        " coalesce(a.drift_features, '') AS drift_features FROM ks k LEFT JOIN (SELECT window_start,"
        " string_agg(feature, ',' ORDER BY feature) AS drift_features FROM ks WHERE p_value < 0.01"
        " GROUP BY window_start) a ON k.window_start = a.window_start"))


@query("stream_drift", _stream_drift_sql())
def stream_drift(spark, sf_dir):
    """KS and alerts of closed four-hour windows of at least 50 events against the first week's stored counts.

    The events arrive in three parts, each drained by a run of its own from the same
    checkpoint, so windows are split over batches and restarts; the result is what the
    sink has written.
    """
    out, ck = _dirs(spark, "stream-drift")
    base = scratch_path(spark, f"stream-drift-{uuid.uuid4().hex}")
    events = read_table(spark, sf_dir, "events")
    feats = ["probability", "latency_ms"]
    first_week = events.filter(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    reference = materialise(value_counts(ev.to_predictions(first_week), feats), "drift-reference")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * k / 3 for k in (1, 2)]
    part = sum(((F.col("ts") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    for k in range(3):
        events.filter(part == k).write.mode("append").parquet(f"{base}/events")
        pred = ev.to_predictions(ev.read_event_stream(spark, f"{base}/events"))
        ev.run_drift(ev.window_counts(pred, feats, DRIFT_WINDOW), ev.drift_sink(reference, out, DRIFT_ROWS), ck)
    ks = spark.read.parquet(f"{out}/ks").drop("batch_id")
    alerts = spark.read.parquet(f"{out}/alerts").select("window_start", F.array_join("drift_features", ",").alias("drift_features"))
    return ks.join(alerts, "window_start", "left").select(
        "window_start", "feature", R("d").alias("d"), "n_ref", "n_new", R("p_value").alias("p_value"), "drifted",
        F.col("drift_features").isNotNull().alias("alerted"), F.coalesce("drift_features", F.lit("")).alias("drift_features"))


@query("stream_ring_drift")
def stream_ring_drift(spark, sf_dir):
    """Alerts of the buffered drift check, one buffer per event type, over all events against the first week."""
    from ..streaming import ring
    out, ck = _dirs(spark, "stream-ring")
    events = read_table(spark, sf_dir, "events")
    first_week = ev.to_predictions(events.filter(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")))
    reference = ring.reference_values(first_week, "trace_id", ["probability", "latency_ms"])
    pred = ev.to_predictions(ev.read_event_stream(spark, f"{sf_dir}/events.parquet"))
    ring.run_ring(ring.ring_alerts(pred, "event_type", "ts", "trace_id", reference), out, ck)
    return spark.read.schema(ring.ALERTS).parquet(out)


def _last_n_sql():
    batch = ("SELECT {k} AS batch_id, count(*) AS requests_total, round(coalesce(avg(coalesce(probability, 0.0)), 0.0), 6) AS avg_prob,"
             " round(coalesce(avg(coalesce(CAST(latency_ms AS DOUBLE), 0.0)), 0.0), 6) AS avg_latency_ms FROM"
             " (SELECT * FROM pe WHERE trace_id % 3 <= {k} ORDER BY ts DESC NULLS LAST, trace_id DESC LIMIT 500)")
    return with_ctes(PE, body=" UNION ALL ".join(f"({batch.format(k=k)})" for k in range(3)))


@query("stream_last_n", _last_n_sql())
def stream_last_n(spark, sf_dir):
    """Request metrics of the newest 500 events after each of three micro-batches.

    The events arrive in three files, each drained by a run of its own and spread over the whole
    time, so that later batches bring older events and push out only some of the held ones.
    """
    from ..streaming import recent
    out, ck = _dirs(spark, "stream-last-n")
    base = scratch_path(spark, f"stream-last-n-{uuid.uuid4().hex}")
    events = read_table(spark, sf_dir, "events")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{base}/events")
        pred = ev.to_predictions(ev.read_event_stream(spark, f"{base}/events"))
        ev.run_batches(pred, recent.recent_sink(out), ck)
    m = spark.read.parquet(f"{out}/metrics")
    return m.select("batch_id", "requests_total", R("avg_prob").alias("avg_prob"), R("avg_latency_ms").alias("avg_latency_ms"))
