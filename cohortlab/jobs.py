"""Command-line Spark jobs: the reference's entry points as cluster jobs.

    python -m cohortlab.jobs train    --input T --out DIR [--quick]
    python -m cohortlab.jobs audit    --input T --out DIR
    python -m cohortlab.jobs evaluate --input T --bundle DIR/bundle --out DIR
    python -m cohortlab.jobs validate --input T --bundle DIR/bundle [--max-drop 0.10]
    python -m cohortlab.jobs score    --input T --bundle DIR/bundle --out DIR
    python -m cohortlab.jobs drift    --reference T --new T --out DIR [--features a,b]
    python -m cohortlab.jobs stream   --events DIR --out DIR [--processing-time "1 minute"]
    python -m cohortlab.jobs stream-score --input DIR --bundle DIR/bundle --out DIR [--processing-time "1 minute"]
    python -m cohortlab.jobs stream-drift --input DIR --reference T --out DIR [--features a,b] [--source s]
                                          [--window "1 day"] [--delay "1 hour"] [--processing-time "1 minute"]
    python -m cohortlab.jobs metrics  --input T --out DIR [--label y --score p]

``T`` is a parquet table (a ``.csv`` path is read with a header), or
``tpch:<dir>`` for the cohort fixture built from TPC-H-like tables. Every
output is a table under ``--out``; intermediates go to the session's
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clean, drift, features, metrics, models, profile, score
from .plans.training import (TrainConfig, base_validation_metrics, load_bundle,
                             prepare_training_frame, save_bundle, train)
from .session import get_spark, temporary_tables
from .sources import io
from .sources.cohort import cohort


def read_input(spark: SparkSession, path: str) -> DataFrame:
    if path.startswith("tpch:"):
        return cohort(spark, path[5:])
    if path.endswith(".csv"):
        # text first, then the measures by name: no pass over the data to guess types
        df = io.read_cohort_csv(spark, path)
        text = {"sex", "segment", "site", "event_type"}
        return clean.nan_to_null(clean.coerce_numeric(df, [c for c in df.columns if c not in text and c != "ts"]))
    return clean.nan_to_null(clean.canonicalize(spark.read.parquet(path)))


def _key(df: DataFrame, key: str) -> str:
    if key not in df.columns:
        raise ValueError(f"key column {key!r} not found; pass --key")
    return key


def job_train(spark, a):
    prepared = clean.prepare(read_input(spark, a.input))
    cfg = TrainConfig.quick() if a.quick else TrainConfig()
    cfg.key = _key(prepared, a.key)
    bundle, val = train(prepared, cfg)
    save_bundle(bundle, spark, f"{a.out}/bundle")
    run = io.new_run_id()
    data = prepare_training_frame(prepared, cfg, bundle.state.input_fills)
    from .operators import prep
    x = models.assemble(prep.apply_prep(data.filter("split = 'validation'"), bundle.state,
                                        keep=[cfg.key, cfg.label]), bundle.state.selected)
    io.append_metrics(base_validation_metrics(bundle, x, cfg.label), f"{a.out}/base_metrics", run)
    io.append_metrics(metrics.evaluate(val, cfg.label, "p_cal", t=bundle.threshold)
                      .withColumn("model", F.lit("stack_calibrated")), f"{a.out}/metrics", run)
    document = spark.createDataFrame([(run, k, float(v)) for k, v in {
        **{f"validation_{m}": v for m, v in bundle.validation.items()},
        **{f"threshold_{n}": v for n, v in bundle.thresholds.items()}}.items() if v is not None],
        "run_id string, name string, value double")
    io.write_document(document, f"{a.out}/metrics_document")
    return {"run_id": run, "thresholds": bundle.thresholds, "best_c": bundle.meta.best_c,
            "calibration": bundle.calibrator.method}


def job_audit(spark, a):
    df = clean.prepare(read_input(spark, a.input), drop_construction=False)
    eng = features.engineer(df)
    key = [a.key] if a.key in eng.columns else []
    out = {
        "missingness": profile.missingness(eng),
        "label_distribution": profile.label_distribution(eng),
        "label_correlation": profile.label_correlation(eng, key=key),
    }
    corr = out["label_correlation"]
    out["leakage"] = profile.leakage_report(corr, profile.AUDIT_LEAKAGE_CORR)
    for name, d in out.items():
        d.write.mode("overwrite").parquet(f"{a.out}/audit/{name}")
    if key:
        cols = [c for c in profile.numeric_columns(eng, exclude=[*key, clean.LABEL, "homa_ir",
                                                                 "homa_ir_log"])]
        imp, auc = models.rf_importance(eng, clean.LABEL, cols, a.key)
        imp.write.mode("overwrite").parquet(f"{a.out}/audit/rf_importance")
        return {"rf_holdout_auc": auc, "leakage_rows": out["leakage"].count()}
    return {"leakage_rows": out["leakage"].count()}


def job_evaluate(spark, a):
    bundle = load_bundle(spark, a.bundle)
    cfg = TrainConfig(key=a.key)
    data = prepare_training_frame(clean.prepare(read_input(spark, a.input)), cfg, bundle.state.input_fills)
    te = bundle.score(data.filter("split = 'test'").drop("split")).select(cfg.label, "probability")
    ev = metrics.evaluate(te, cfg.label, "probability", t=bundle.threshold)
    ev.write.mode("overwrite").parquet(f"{a.out}/test_metrics")
    metrics.confusion(te, cfg.label, "probability", bundle.threshold) \
        .write.mode("overwrite").parquet(f"{a.out}/confusion")
    metrics.class_report(te, cfg.label, "probability", bundle.threshold) \
        .write.mode("overwrite").parquet(f"{a.out}/class_report")
    return {r["metric"]: r["value"] for r in ev.collect()}


def job_validate(spark, a):
    bundle = load_bundle(spark, a.bundle)
    raw = clean.harmonise_names(read_input(spark, a.input))
    if clean.LABEL not in raw.columns:
        raise ValueError(f"the external cohort has no {clean.LABEL} column")
    # every row stays: no age filter, no derived label
    df = features.engineer(clean.clip_labs(raw), bundle.state.input_fills)
    s = bundle.score(df).select(F.col(clean.LABEL).cast("int").alias(clean.LABEL), "probability")
    baseline = a.baseline_auc if a.baseline_auc is not None else bundle.validation.get("roc_auc")
    if baseline is None:
        raise ValueError("no baseline AUC: the bundle's manifest has none and --baseline-auc is not given")
    out = metrics.validate_external(s, baseline, clean.LABEL, "probability",
                                    bundle.threshold, a.max_drop, raise_on_fail=True)
    return out.collect()[0].asDict()


def job_score(spark, a):
    bundle = load_bundle(spark, a.bundle)
    raw = read_input(spark, a.input)
    eng = features.engineer(clean.harmonise_names(raw), bundle.state.input_fills)
    allr = score.score_all(eng, bundle.score, _key(eng, a.key), threshold=bundle.threshold,
                           model_version=bundle.model_version,
                           ts=a.ts if a.ts in eng.columns else None,
                           features=bundle.state.selected)
    score.write_scored(allr, f"{a.out}/scored", mode="overwrite")
    return score.batch_outcome(spark.read.parquet(f"{a.out}/scored")).collect()[0].asDict()


def job_drift(spark, a):
    ref, new = read_input(spark, a.reference), read_input(spark, a.new)
    feats = a.features.split(",") if a.features else profile.numeric_columns(ref, exclude=[a.key])
    ks = drift.ks_drift(ref, new, feats)
    ks.write.mode("overwrite").parquet(f"{a.out}/ks")
    alerts = drift.drift_alerts(spark.read.parquet(f"{a.out}/ks"))
    io.append_alerts(alerts, f"{a.out}/alerts")
    return {"drifted": [r["feature"] for r in spark.read.parquet(f"{a.out}/ks").filter("drifted").collect()]}


def job_metrics(spark, a):
    """Validation metrics, thresholds, reliability and ROC points for any score table."""
    from .operators import curves
    df = read_input(spark, a.input).select(F.col(a.label).cast("int").alias("y"),
                                           F.col(a.score).cast("double").alias("p"))
    ev = metrics.evaluate(df, "y", "p")
    ev.write.mode("overwrite").parquet(f"{a.out}/metrics")
    grid = curves.threshold_grid(df, "y", "p")
    f1 = curves.f1_threshold(grid).withColumn("strategy", F.lit("f1_max"))
    sens = curves.sensitivity_first(grid).select(
        "threshold", F.col("specificity").alias("value"), F.lit("sensitivity_first").alias("strategy"))
    yj = curves.youden(curves.score_curve(df, "y", "p")).select(
        "threshold", F.col("j_score").alias("value"), F.lit("youden").alias("strategy"))
    f1.select("threshold", F.col("f1").alias("value"), "strategy").unionByName(yj).unionByName(sens) \
        .write.mode("overwrite").parquet(f"{a.out}/thresholds")
    metrics.reliability_bins(df, "y", "p").write.mode("overwrite").parquet(f"{a.out}/reliability")
    curves.roc_points(curves.score_curve(df, "y", "p")).write.mode("overwrite").parquet(f"{a.out}/roc")
    return {r["metric"]: r["value"] for r in spark.read.parquet(f"{a.out}/metrics").collect()}


def job_stream(spark, a):
    from .streaming import events as ev
    if a.processing_time:
        q1 = ev.run_to_table(ev.to_predictions(ev.read_event_stream(spark, a.events)), f"{a.out}/events",
                             f"{a.out}/_checkpoints/events", processing_time=a.processing_time)
        q2 = ev.run_to_table(ev.windowed_metrics(ev.to_predictions(ev.read_event_stream(spark, a.events))),
                             f"{a.out}/windows", f"{a.out}/_checkpoints/windows",
                             processing_time=a.processing_time)
        spark.streams.awaitAnyTermination()
        return {"stopped": [q1.id, q2.id]}
    src = ev.read_event_stream(spark, a.events)
    pred = ev.to_predictions(src)
    ev.run_to_table(pred, f"{a.out}/events", f"{a.out}/_checkpoints/events")
    ev.run_to_table(ev.windowed_metrics(ev.to_predictions(ev.read_event_stream(spark, a.events))),
                    f"{a.out}/windows", f"{a.out}/_checkpoints/windows")
    return {"events": spark.read.parquet(f"{a.out}/events").count(),
            "closed_windows": spark.read.parquet(f"{a.out}/windows").count()}


def _row_stream(spark, folder: str) -> DataFrame:
    """Stream of the Parquet files of a folder; the files that are there now give the columns."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def job_stream_score(spark, a):
    """Patient rows scored by a bundle as they arrive, with the running metrics of the newest scores.

    ``--input`` is a folder of Parquet files. Output: ``scored/batch_id=/status=`` and, beside it,
    ``recent`` and ``metrics`` of the newest 500 scored rows after each batch.
    """
    from .streaming import events as ev
    from .streaming.recent import recent_sink
    bundle = load_bundle(spark, a.bundle)
    rows = _row_stream(spark, a.input)
    ts = a.ts if a.ts in clean.canonicalize(rows).columns else None

    def prepare(batch):
        raw = clean.nan_to_null(clean.canonicalize(batch))
        return features.engineer(clean.harmonise_names(raw), bundle.state.input_fills)

    sink = ev.scored_sink(prepare, bundle.score, f"{a.out}/scored", a.key, then=[recent_sink(a.out)], threshold=bundle.threshold,
                          model_version=bundle.model_version, ts=ts, features=bundle.state.selected)
    q = ev.run_batches(rows, sink, f"{a.out}/_checkpoints/scored", a.processing_time)
    if q is not None:
        q.awaitTermination()
    return score.batch_outcome(spark.read.parquet(f"{a.out}/scored")).collect()[0].asDict()


def job_stream_drift(spark, a):
    """Rows tested for drift as they arrive, against a reference that is counted once and stored.

    Windows of event time are tested when closed (``ks``, ``alerts``); with ``--source`` the last rows of
    each source are tested row by row instead (``ring_alerts``). ``--input`` is a folder of Parquet files.
    """
    from .streaming import events as ev, ring
    reference = read_input(spark, a.reference)
    rows = clean.canonicalize(_row_stream(spark, a.input))
    feats = a.features.split(",") if a.features else [f for f in profile.numeric_columns(reference, exclude=[a.key])
                                                      if f in rows.columns]
    if a.source:
        stream = ring.ring_alerts(rows, a.source, a.ts, _key(rows, a.key), ring.reference_values(reference, a.key, feats))
        q = ring.run_ring(stream, f"{a.out}/ring_alerts", f"{a.out}/_checkpoints/ring", a.processing_time)
        alerts, schema = f"{a.out}/ring_alerts", ring.ALERTS
    else:
        drift.value_counts(reference, feats).write.mode("overwrite").parquet(f"{a.out}/reference")
        stored = spark.read.parquet(f"{a.out}/reference")
        counts = ev.window_counts(rows.withColumn("ts", F.col(a.ts).cast("timestamp")), feats, a.window, a.delay)
        q = ev.run_batches(counts, ev.drift_sink(stored, a.out), f"{a.out}/_checkpoints/drift", a.processing_time)
        alerts, schema = f"{a.out}/alerts", None
    if q is not None:
        q.awaitTermination()
    found = spark.read.schema(schema).parquet(alerts) if schema else spark.read.parquet(alerts)
    return {"alerts": found.count()}


JOBS = {"stream-score": job_stream_score, "stream-drift": job_stream_drift, "train": job_train, "audit": job_audit, "evaluate": job_evaluate, "validate": job_validate,
        "score": job_score, "drift": job_drift, "stream": job_stream, "metrics": job_metrics}


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="cohortlab.jobs")
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("--input")
    p.add_argument("--reference")
    p.add_argument("--new")
    p.add_argument("--events")
    p.add_argument("--bundle")
    p.add_argument("--out", required=True)
    p.add_argument("--key", default="patient_id")
    p.add_argument("--ts", default="ts")
    p.add_argument("--features")
    p.add_argument("--baseline-auc", type=float)
    p.add_argument("--max-drop", type=float, default=0.10)
    p.add_argument("--quick", action="store_true")
    p.add_argument("--label", default="y")
    p.add_argument("--score", default="p")
    p.add_argument("--processing-time")
    p.add_argument("--source")
    p.add_argument("--window", default="1 day")
    p.add_argument("--delay", default="1 hour")
    p.add_argument("--master")
    a = p.parse_args(argv)
    spark = get_spark(a.master)
    with temporary_tables(spark):
        result = JOBS[a.job](spark, a)
    print(json.dumps(result, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
