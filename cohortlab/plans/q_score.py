"""Registered queries: drift, feature selection, encoders and batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_out
from ..operators import drift, features, neighbours, prep, profile, score, select, split
from ..operators.drift import KS_TERMS
from ..session import materialise
from ..sources.cohort import cohort
from . import frames
from .registry import query
from .training import TrainConfig, fit_input_fills, prepare_training_frame
from .sql_text import LABELLED, MEDIANS, PREPARED, SCORES, engineered_cte, split_hash, with_ctes

R = round_out
DRIFT_CUT = "1998-04-25"
DRIFT_FEATURES = ("age", "fasting_glucose", "fasting_insulin", "bmi", "triglycerides",
                  "hdl_cholesterol", "waist_circumference", "hip_circumference")


def drift_frames(spark, sf_dir):
    c = cohort(spark, sf_dir)
    ref = c.filter(F.col("ts") < F.lit(DRIFT_CUT).cast("timestamp_ntz"))
    new = (c.filter(F.col("ts") >= F.lit(DRIFT_CUT).cast("timestamp_ntz"))
            .withColumn("bmi", F.col("bmi") + 1))
    return ref, new


def _ks_sql():
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {s} AS side FROM {t}"
        for t, s in (("ref", 0), ("new", 1)) for f in DRIFT_FEATURES)
    lam = "(d * sqrt(n_ref * n_new / (n_ref + n_new)))"
    series = " + ".join(f"{2.0 * (-1) ** (k - 1)!r} * exp({-2.0 * k * k!r} * {lam} * {lam})"
                        for k in range(1, KS_TERMS + 1))
    p = f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(greatest({series}, 0.0), 1.0) END"
    return f"""
ref AS (SELECT * FROM cohort WHERE ts < TIMESTAMP '{DRIFT_CUT}'),
new AS (SELECT * REPLACE (bmi + 1 AS bmi) FROM cohort WHERE ts >= TIMESTAMP '{DRIFT_CUT}'),
long AS ({long}),
cnt AS (SELECT feature, value, count(CASE WHEN side = 0 THEN 1 END) AS c_ref,
          count(CASE WHEN side = 1 THEN 1 END) AS c_new
        FROM long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY feature, value),
cum AS (SELECT feature, sum(c_ref) OVER w AS cr, sum(c_new) OVER w AS cn,
          sum(c_ref) OVER (PARTITION BY feature) AS nr, sum(c_new) OVER (PARTITION BY feature) AS nn
        FROM cnt WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks0 AS (SELECT feature, max(abs(cr / nr - cn / nn)) AS d, CAST(max(nr) AS BIGINT) AS n_ref,
          CAST(max(nn) AS BIGINT) AS n_new FROM cum GROUP BY feature
        HAVING max(nr) > 0 AND max(nn) > 0),
ks AS (SELECT feature, d, n_ref, n_new, {p} AS p_value FROM ks0)"""


def _ks(spark, sf_dir):
    ref, new = drift_frames(spark, sf_dir)
    return drift.ks_drift(ref, new, DRIFT_FEATURES)


@query("ks_drift", with_ctes(_ks_sql(), body=(
    "SELECT feature, d, n_ref, n_new, round(p_value, 6) AS p_value, p_value < 0.01 AS drifted FROM ks")))
def ks_drift(spark, sf_dir):
    k = _ks(spark, sf_dir)
    return k.select("feature", "d", "n_ref", "n_new", R("p_value").alias("p_value"), "drifted")


BUFFER = 200                  # rows of the buffered check, on both sides here
EXACT_FEATURES = ("hdl_cholesterol", "hip_circumference")      # without nulls: samples of equal size


def _ks_exact_sql():
    """Equal sizes have a closed form: P(D >= k/n) = 2 sum (-1)^(i+1) C(2n, n - ik) / C(2n, n)."""
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {s} AS side FROM {t}"
                              for t, s in (("few_ref", 0), ("few_new", 1)) for f in EXACT_FEATURES)
    h = split_hash(salt="reference")
    return f"""
ref AS (SELECT * FROM cohort WHERE ts < TIMESTAMP '{DRIFT_CUT}'),
new AS (SELECT * FROM cohort WHERE ts >= TIMESTAMP '{DRIFT_CUT}'),
size AS (SELECT least({BUFFER}, (SELECT count(*) FROM new), (SELECT count(*) FROM ref)) AS n),
few_ref AS (SELECT * FROM ref ORDER BY {h}, patient_id LIMIT (SELECT n FROM size)),
few_new AS (SELECT * FROM new ORDER BY {h}, patient_id LIMIT (SELECT n FROM size)),
long AS ({long}),
cnt AS (SELECT feature, value, sum(1 - side) AS c_ref, sum(side) AS c_new FROM long GROUP BY feature, value),
cum AS (SELECT feature, sum(c_ref) OVER w - sum(c_new) OVER w AS gap FROM cnt
        WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
top AS (SELECT feature, max(abs(gap)) AS k, any_value(n) AS n FROM cum CROSS JOIN size GROUP BY feature),
terms AS (SELECT feature, k, n, i, 2 * lgamma(n + 1) - lgamma(n - i * k + 1) - lgamma(n + i * k + 1) AS e
          FROM top, generate_series(1, {BUFFER}) g(i) WHERE k > 0 AND i * k <= n),
ks AS (SELECT t.feature, CAST(t.k AS DOUBLE) / t.n AS d, CAST(t.n AS BIGINT) AS n_ref, CAST(t.n AS BIGINT) AS n_new,
              CASE WHEN t.k = 0 THEN 1.0 ELSE least(2 * (SELECT sum(CASE WHEN i % 2 = 1 THEN exp(e) ELSE -exp(e) END) FROM terms s
                                                         WHERE s.feature = t.feature), 1.0) END AS p_value FROM top t)"""


@query("ks_exact", with_ctes(_ks_exact_sql(), body=(
    "SELECT feature, round(d, 6) AS d, n_ref, n_new, round(p_value, 6) AS p_value, p_value < 0.01 AS drifted FROM ks")))
def ks_exact(spark, sf_dir):
    """Exact small-sample p-values and flags: a buffer of new rows against a reference sample of the same size."""
    c = cohort(spark, sf_dir)
    ref = c.filter(F.col("ts") < F.lit(DRIFT_CUT).cast("timestamp_ntz"))
    new = c.filter(F.col("ts") >= F.lit(DRIFT_CUT).cast("timestamp_ntz"))
    few = split.reference_sample(new, "patient_id", BUFFER)
    n = min(few.count(), ref.count())
    k = drift.with_exact_p(drift.ks_drift(split.reference_sample(ref, "patient_id", n), few.limit(n), EXACT_FEATURES))
    return k.select("feature", R("d").alias("d"), "n_ref", "n_new", R("p_value").alias("p_value"), "drifted")


@query("drift_alerts", with_ctes(_ks_sql(), body=(
    "SELECT list(feature ORDER BY feature) AS drift_features, count(*) AS n_drifted,"
    " (SELECT max(ts) FROM new) AS alert_ts FROM ks WHERE p_value < 0.01 HAVING count(*) > 0")))
def drift_alerts(spark, sf_dir):
    ref, new = drift_frames(spark, sf_dir)
    at = new.agg(F.max("ts")).collect()[0][0]
    return drift.drift_alerts(drift.ks_drift(ref, new, DRIFT_FEATURES),
                              F.lit(at).cast("timestamp_ntz"))


# ---------------------------------------------------------------- selection

MI_FEATURES = ("age", "bmi", "triglycerides", "hdl_cholesterol", "waist_circumference",
               "hip_circumference", "tg_hdl_ratio", "waist_hip_ratio", "age_bmi", "triglycerides_log")


def _mi_sql(bins=20, src="engineered", feats=MI_FEATURES):
    long = " UNION ALL ".join(
        f"SELECT ir_label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src}"
        for f in feats)
    return f"""
long AS ({long}),
vc AS (SELECT feature, value, ir_label, count(*) AS c FROM long GROUP BY feature, value, ir_label),
vv AS (SELECT feature, value, sum(c) AS c FROM vc WHERE value IS NOT NULL GROUP BY feature, value),
bins AS (SELECT feature, value, CAST(floor({bins} * (sum(c) OVER (PARTITION BY feature ORDER BY value
           ROWS UNBOUNDED PRECEDING) - c) / sum(c) OVER (PARTITION BY feature)) AS INTEGER) AS bin
         FROM vv),
cells AS (SELECT vc.feature, coalesce(b.bin, -1) AS bin, vc.ir_label, sum(vc.c) AS n_xy
          FROM vc LEFT JOIN bins b ON vc.feature = b.feature AND vc.value = b.value
          GROUP BY vc.feature, coalesce(b.bin, -1), vc.ir_label),
m AS (SELECT *, sum(n_xy) OVER (PARTITION BY feature, bin) AS n_x,
        sum(n_xy) OVER (PARTITION BY feature, ir_label) AS n_y,
        sum(n_xy) OVER (PARTITION BY feature) AS n FROM cells),
mi0 AS (SELECT feature, sum(n_xy / n * ln(n_xy * n / (n_x * n_y))) AS mi_plugin, max(n) AS n,
          count(*) AS k_xy, count(DISTINCT bin) AS k_x, count(DISTINCT ir_label) AS k_y
        FROM m GROUP BY feature),
mi AS (SELECT feature, mi_plugin, mi_plugin - (k_xy - k_x - k_y + 1) / (2.0 * n) AS mi,
         CAST(n AS BIGINT) AS n FROM mi0)"""


def _mi(spark, sf_dir):
    df = frames.engineered(spark, sf_dir, fill=False)
    return select.binned_mi(df, "ir_label", MI_FEATURES)


@query("mi_binned", with_ctes(PREPARED, engineered_cte(), _mi_sql(), body=(
    "SELECT feature, round(mi_plugin, 6) AS mi_plugin, round(mi, 6) AS mi, n,"
    " mi >= 0.001 AS selected FROM mi")))
def mi_binned(spark, sf_dir):
    m = _mi(spark, sf_dir)
    return m.select("feature", R("mi_plugin").alias("mi_plugin"), R("mi").alias("mi"), "n", "selected")


@query("mi_top_n", with_ctes(PREPARED, engineered_cte(), _mi_sql(), body=(
    "SELECT feature, round(mi, 6) AS mi FROM mi ORDER BY mi DESC, feature LIMIT 30")))
def mi_top_n(spark, sf_dir):
    """Top 30 features by MI (the reference's N)."""
    return select.top_by_mi(_mi(spark, sf_dir), 30).select("feature", R("mi").alias("mi"))


@query("mi_top_5", with_ctes(PREPARED, engineered_cte(), _mi_sql(), body=(
    "SELECT feature, round(mi, 6) AS mi FROM mi ORDER BY mi DESC, feature LIMIT 5")))
def mi_top_5(spark, sf_dir):
    """A top-N cut that binds: five of ten features."""
    return select.top_by_mi(_mi(spark, sf_dir), 5).select("feature", R("mi").alias("mi"))


KNN = neighbours.NEIGHBOURS


def _psi_sql(n):
    x = f"({n} + 6.0)"
    return (f"(ln({x}) - 0.5 / {x} - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) + 1 / (240 * {x} ** 8)"
            + "".join(f" - 1.0 / ({n} + {j}.0)" for j in range(6)) + ")")


def _knn_sql(k=KNN, src="engineered", feats=MI_FEATURES):
    """Points one by one in whole-label windows, counts inside the distances by as-of joins."""
    long = " UNION ALL ".join(
        f"SELECT ir_label, '{f}' AS feature, coalesce(CAST({f} AS DOUBLE), (SELECT median(CAST({f} AS DOUBLE)) FROM {src}))"
        f" AS value FROM {src}" for f in feats)
    near = ", ".join(f"{s}(value, {i}) OVER w" for s in ("lag", "lead") for i in range(1, k + 1))
    inside = "list_filter(vs, lambda x: abs(x - value) <= r)"
    return f"""
long AS ({long}),
pts AS (SELECT feature, ir_label, value, list_filter([{near}], lambda x: x IS NOT NULL) AS vs,
          count(*) OVER (PARTITION BY feature, ir_label) AS ny FROM long WHERE value IS NOT NULL
        WINDOW w AS (PARTITION BY feature, ir_label ORDER BY value)),
reach AS (SELECT *, list_sort(list_transform(vs, lambda x: abs(x - value)))[least({k}, ny - 1)] AS r FROM pts WHERE ny > 1),
ends AS (SELECT feature, ir_label, value, ny, least(value - r, list_min({inside})) AS lo,
           greatest(value + r, list_max({inside})) AS hi FROM reach),
alls AS (SELECT feature, value, sum(count(*)) OVER (PARTITION BY feature ORDER BY value) AS cum FROM ends
         GROUP BY feature, value),
own AS (SELECT feature, ir_label, value, sum(count(*)) OVER (PARTITION BY feature, ir_label ORDER BY value) AS cum FROM ends
        GROUP BY feature, ir_label, value),
counted AS (SELECT e.feature, e.ny, ah.cum - coalesce(al.cum, 0) - 1 AS m, oh.cum - coalesce(ol.cum, 0) - 1 AS k FROM ends e
  ASOF JOIN alls ah ON e.feature = ah.feature AND e.hi >= ah.value
  ASOF LEFT JOIN alls al ON e.feature = al.feature AND e.lo > al.value
  ASOF JOIN own oh ON e.feature = oh.feature AND e.ir_label = oh.ir_label AND e.hi >= oh.value
  ASOF LEFT JOIN own ol ON e.feature = ol.feature AND e.ir_label = ol.ir_label AND e.lo > ol.value),
mi AS (SELECT feature, count(*) AS n, greatest(0.0, {_psi_sql('count(*)')} + avg({_psi_sql('k')} - {_psi_sql('ny')}
         - {_psi_sql('m')})) AS mi FROM counted GROUP BY feature)"""


@query("mi_neighbours", with_ctes(PREPARED, engineered_cte(), _knn_sql(), body=(
    "SELECT feature, round(mi, 6) AS mi, n, mi >= 0.001 AS selected FROM mi")))
def mi_neighbours(spark, sf_dir):
    """Nearest-neighbour MI (k = 3) of the median-filled features with the label."""
    # read twice: by the medians and by the estimate
    df = materialise(frames.engineered(spark, sf_dir, fill=False).select("ir_label", *MI_FEATURES), "mi-input")
    m = neighbours.neighbour_mi(df, "ir_label", MI_FEATURES, profile.column_medians(df, MI_FEATURES))
    return m.select("feature", R("mi").alias("mi"), "n", "selected")


# ---------------------------------------------------------------- encoders

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
TRAIN_SQL = f"{split_hash()} >= 0.3"


def _train(df):
    return split.hash_split(df, "patient_id").filter("split = 'train'").drop("split")


@query("one_hot", with_ctes(PREPARED, body=(
    "SELECT patient_id, " + ", ".join(
        [f"CASE WHEN sex = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sex_{v}" for v in ("F", "M")]
        + [f"CASE WHEN segment = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS segment_{v}"
           for v in SEGMENTS])
    + " FROM prepared")))
def one_hot(spark, sf_dir):
    df = frames.prepared(spark, sf_dir).select("patient_id", "sex", "segment")
    cats = prep.one_hot_categories(_train(df), ["sex", "segment"])
    return prep.one_hot(df, cats)


@query("ordinal", with_ctes(PREPARED, f"""
dict AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS idx
         FROM (SELECT DISTINCT site FROM prepared WHERE {TRAIN_SQL} AND site IS NOT NULL))""", body=(
    "SELECT p.patient_id, CAST(coalesce(d.idx, -1) AS DOUBLE) AS site FROM prepared p"
    " LEFT JOIN dict d ON p.site = d.site")))
def ordinal(spark, sf_dir):
    df = frames.prepared(spark, sf_dir).select("patient_id", "site")
    d = prep.ordinal_dictionary(_train(df), "site")
    return prep.ordinal(df, "site", d)


PREP_NUMERIC = ("age", "bmi", "triglycerides", "hdl_cholesterol", "waist_circumference",
                "hip_circumference", "tg_hdl_ratio", "waist_hip_ratio", "age_bmi", "triglycerides_log")


def _prep_sql():
    h = split_hash()
    meds = ", ".join(f"median({c}) AS t_{c}" for c in PREP_NUMERIC)
    fills = ", ".join(f"coalesce(x.{c}, t.t_{c}) AS {c}" for c in PREP_NUMERIC)
    num_rows = " UNION ALL ".join(
        f"SELECT patient_id, ir_label, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM filled"
        for c in PREP_NUMERIC)
    train_medians = MEDIANS.replace("FROM prepared", f"FROM prepared WHERE {h} >= 0.3")
    return with_ctes(PREPARED, train_medians, engineered_cte(fill_from="medians"), f"""
x AS (SELECT patient_id, ir_label, {", ".join(PREP_NUMERIC)}, sex, segment, site,
        {h} >= 0.3 AS is_train FROM engineered),
tmed AS (SELECT {meds} FROM x WHERE is_train),
filled AS (SELECT x.patient_id, x.ir_label, x.is_train, {fills}, x.sex, x.segment, x.site
           FROM x CROSS JOIN tmed t),
mi_src AS (SELECT * FROM filled WHERE is_train),
{_mi_sql(20, "mi_src", PREP_NUMERIC).strip()},
sel AS (SELECT feature FROM mi WHERE mi >= 0.001),
numeric_rows AS ({num_rows}),
cats AS (SELECT DISTINCT 'sex' AS col, sex AS v FROM x WHERE is_train AND sex IS NOT NULL
         UNION ALL SELECT DISTINCT 'segment', segment FROM x WHERE is_train AND segment IS NOT NULL),
dict AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS idx
         FROM (SELECT DISTINCT site FROM x WHERE is_train AND site IS NOT NULL))""", body="""
SELECT n.patient_id, n.ir_label, n.feature,
       CASE WHEN n.feature = 'triglycerides_log' THEN round(n.value, 6) ELSE n.value END AS value
FROM numeric_rows n JOIN sel ON n.feature = sel.feature
UNION ALL
SELECT f.patient_id, f.ir_label, c.col || '_' || c.v AS feature,
       CASE WHEN (CASE WHEN c.col = 'sex' THEN f.sex ELSE f.segment END) = c.v
            THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
FROM filled f CROSS JOIN cats c
UNION ALL
SELECT f.patient_id, f.ir_label, 'site' AS feature, CAST(coalesce(d.idx, -1) AS DOUBLE) AS value
FROM filled f LEFT JOIN dict d ON f.site = d.site""")


@query("prep_transform", _prep_sql())
def prep_transform(spark, sf_dir):
    """Fit on the train split (exact medians, the engineered inputs' included, encoders, MI selection), apply to every row.

    Long output (patient_id, ir_label, feature, value) over the selected columns,
    so the data-dependent selection is part of the checked result."""
    rows = materialise(frames.prepared(spark, sf_dir), "prepared")      # one join of the three tables
    cfg = TrainConfig()
    df = prepare_training_frame(rows, cfg, fit_input_fills(rows, cfg))
    state = prep.fit_prep(df.filter("split = 'train'").drop("split"), "ir_label",
                          key=["patient_id"], exact=True, include_categoricals=True)
    wide = prep.apply_prep(df.drop("split"), state, keep=["patient_id", "ir_label"])
    cols = [c for c in wide.columns if c not in ("patient_id", "ir_label")]
    long = wide.unpivot(["patient_id", "ir_label"], [F.col(c).cast("double").alias(c) for c in cols],
                        "feature", "value")
    return long.withColumn("value", F.when(F.col("feature") == "triglycerides_log",
                                           F.round("value", 6)).otherwise(F.col("value")))


# ---------------------------------------------------------------- scoring

SCORER = score.LinearScorer({"bmi": 0.25}, intercept=-6.5)


def _hash_sql(cols):
    parts = ", ".join(
        f"coalesce(CAST(CAST(floor(CAST({c} AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS VARCHAR), '')"
        for c in cols)
    return f"sha1(concat_ws('|', {parts}))"


_REASON_SQL = ("CASE WHEN age IS NULL THEN 'missing_age' WHEN fasting_glucose IS NULL THEN"
               " 'missing_fasting_glucose' WHEN fasting_insulin IS NULL THEN 'missing_fasting_insulin'"
               " WHEN bmi IS NULL THEN 'missing_bmi' WHEN age < 0 OR age > 150 THEN 'age_out_of_range'"
               " END")

_SCORED_SQL = f"""
flagged AS (SELECT *, {_REASON_SQL} AS reason, {SCORER.sql()} AS probability FROM cohort),
scored AS (SELECT patient_id, CASE WHEN reason IS NULL THEN 'scored' ELSE 'quarantined' END AS status,
  reason, CASE WHEN reason IS NULL THEN probability END AS probability,
  CASE WHEN reason IS NULL THEN CAST(probability >= 0.5 AS INTEGER) END AS prediction,
  CASE WHEN reason IS NULL THEN (CASE WHEN probability < 0.33 THEN 'low' WHEN probability < 0.67
    THEN 'medium' ELSE 'high' END) END AS risk_level,
  md5(concat('v1:', CAST(patient_id AS VARCHAR))) AS trace_id,
  CASE WHEN reason IS NULL THEN {_hash_sql(score.REQUIRED)} END AS features_hash FROM flagged)"""


def _score_all(spark, sf_dir):
    return score.score_all(cohort(spark, sf_dir), SCORER, "patient_id", threshold=0.5,
                           model_version="v1", ts="ts")


@query("scored_batch", with_ctes(_SCORED_SQL, body=(
    "SELECT patient_id, status, reason, round(probability, 6) AS probability, prediction, risk_level,"
    " trace_id, features_hash, CAST(0.5 AS DOUBLE) AS threshold_used, 'v1' AS model_version, s.ts"
    " FROM scored JOIN (SELECT patient_id, ts FROM cohort) s USING (patient_id)")))
def scored_batch(spark, sf_dir):
    s = _score_all(spark, sf_dir)
    return s.select("patient_id", "status", "reason", R("probability").alias("probability"),
                    "prediction", "risk_level", "trace_id", "features_hash", "threshold_used", "model_version",
                    F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("quarantine", with_ctes(_SCORED_SQL, body=(
    "SELECT status, reason, count(*) AS n FROM scored GROUP BY status, reason")))
def quarantine(spark, sf_dir):
    return score.quarantine_counts(_score_all(spark, sf_dir))


@query("batch_outcome", with_ctes(_SCORED_SQL, body=(
    "SELECT count(*) AS total_records, count(CASE WHEN status = 'scored' THEN 1 END) AS successful,"
    " count(CASE WHEN status = 'quarantined' THEN 1 END) AS failed FROM scored")))
def batch_outcome(spark, sf_dir):
    return score.batch_outcome(_score_all(spark, sf_dir))


@query("risk_levels", with_ctes(LABELLED, SCORES, body=(
    "SELECT patient_id, CAST(p >= 0.5 AS INTEGER) AS prediction, CASE WHEN p < 0.33 THEN 'low'"
    " WHEN p < 0.67 THEN 'medium' ELSE 'high' END AS risk_level FROM scores")))
def risk_levels(spark, sf_dir):
    from ..functions.columns import risk_level
    s = frames.scores(spark, sf_dir)
    return s.select("patient_id", (F.col("p") >= 0.5).cast("int").alias("prediction"),
                    risk_level("p").alias("risk_level"))


@query("feature_hash", with_ctes(PREPARED, body=(
    f"SELECT patient_id, {_hash_sql(('age', 'fasting_glucose', 'fasting_insulin', 'bmi'))}"
    " AS features_hash FROM prepared")))
def feature_hash(spark, sf_dir):
    from ..functions.columns import feature_hash as fh
    df = frames.prepared(spark, sf_dir)
    return df.select("patient_id", fh("age", "fasting_glucose", "fasting_insulin", "bmi")
                     .alias("features_hash"))

