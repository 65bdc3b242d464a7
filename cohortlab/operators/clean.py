"""Cleaning and labelling (scan-side projections and filters)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, null_safe_true

LABEL = "ir_label"
GLUCOSE = "fasting_glucose"
INSULIN = "fasting_insulin"

# fixed values: label construction and clinical bounds
HOMA_DIVISOR = 405.0
HOMA_CUTOFF = 2.5
AGE_MIN, AGE_MAX = 0, 150
GLUCOSE_MIN, GLUCOSE_MAX = 40, 600
INSULIN_MIN = 0.1

# fixed values: per-column input ranges (min, max) checked by the range-rule job
RANGE_RULES = [
    ("age", 18, 90),
    ("bmi", 15.0, 50.0),
    ("blood_pressure", 60.0, 180.0),
    ("skin_thickness", 5.0, 100.0),
    ("pregnancies", 0, 17),
    ("diabetes_pedigree", 0.05, 2.5),
    ("hba1c", 4.0, 14.0),
    ("stress_level", 1, 10),
    ("stresslevel", 1, 10),
    ("alcohol", 0.0, 20.0),
    ("smoking", 0, 40),
    ("exercisehours", 0.0, 20.0),
    ("exercise_hours_week", 0.0, 20.0),
    ("sleep_hours", 3.0, 12.0),
    ("sleepquality", 1, 10),
    ("dietscore", 0, 100),
    ("health_literacy", 0, 100),
    ("nutrition_quality", 0, 100),
    ("educationyears", 0, 25),
    ("healthcareaccess", 0, 100),
    ("healthcare_access", 0, 100),
    ("healthcare_spend_usd", 0, 10000),
    ("internetaccess", 0, 100),
    ("electricityaccess", 0, 100),
    ("mobilephone", 0, 100),
    ("medical_equipment_index", 0, 100),
    ("prevention_access", 0, 100),
    ("specialist_availability", 0, 100),
    ("diabetesprevalence", 0.0, 30.0),
    ("diabetes_risk_factor", 0.0, 10.0),
    ("outcome", 0, 1),
    ("source_index", 0, 10),
]


def canonical_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def canonicalize(df: DataFrame) -> DataFrame:
    """Lower-case names, space and '-' to '_'; two columns may not collide."""
    names = [canonical_name(c) for c in df.columns]
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise ValueError(f"column names collide after canonicalisation: {dupes}")
    return df.toDF(*names)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing: float and double columns get NULL instead (one projection at the scan)."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`")
                       for c in df.columns])


def harmonise_names(df: DataFrame) -> DataFrame:
    """glucose -> fasting_glucose and insulin -> fasting_insulin, only if the target is absent."""
    df = canonicalize(df)
    for src, dst in (("glucose", GLUCOSE), ("insulin", INSULIN)):
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    return df


def derive_label(df: DataFrame, drop_construction: bool = True) -> DataFrame:
    """HOMA-IR label, computed only when the table has none.

    Rows missing glucose or insulin are dropped; ``glucose*insulin/405 > 2.5``
    (strict) becomes 1. ``homa_ir`` is dropped inside this branch only.
    """
    if LABEL in df.columns:
        return df
    df = df.dropna(subset=[GLUCOSE, INSULIN])
    homa = F.col(GLUCOSE) * F.col(INSULIN) / HOMA_DIVISOR
    df = df.withColumn(LABEL, (homa > HOMA_CUTOFF).cast("int"))
    if drop_construction and "homa_ir" in df.columns:
        df = df.drop("homa_ir")
    return df


def age_range_filter(df: DataFrame) -> DataFrame:
    """Drop rows with age < 0 or > 150; a NULL age is kept."""
    if "age" not in df.columns:
        return df
    bad = null_safe_true((F.col("age") < AGE_MIN) | (F.col("age") > AGE_MAX))
    return df.filter(~bad)


def clip_labs(df: DataFrame) -> DataFrame:
    """Glucose into [40, 600], insulin to at least 0.1; NULL stays NULL."""
    if GLUCOSE in df.columns:
        df = df.withColumn(GLUCOSE, clip(GLUCOSE, GLUCOSE_MIN, GLUCOSE_MAX))
    if INSULIN in df.columns:
        df = df.withColumn(INSULIN, clip(INSULIN, lo=INSULIN_MIN))
    return df


def prepare(df: DataFrame, drop_construction: bool = True) -> DataFrame:
    """Names -> label -> age filter -> clip, in that order (label before clipping)."""
    df = harmonise_names(df)
    df = derive_label(df, drop_construction)
    df = age_range_filter(df)
    return clip_labs(df)


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Non-numeric text becomes NULL (``try_cast``), never an error."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    return df


def range_rule_violations(df: DataFrame, rules: Sequence[tuple] = RANGE_RULES) -> DataFrame:
    """One pass of conditional counts, unpivoted to (column, n_checked, n_below, n_above)."""
    present = [(c, lo, hi) for c, lo, hi in rules if c in df.columns]
    if not present:
        raise ValueError("no rule column is present")
    aggs = []
    for i, (c, lo, hi) in enumerate(present):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count(F.when(v < float(lo), 1)).alias(f"b{i}"),
                 F.count(F.when(v > float(hi), 1)).alias(f"a{i}")]
    wide = df.agg(*aggs)
    rows = ", ".join(
        f"'{c}', CAST({float(lo)} AS DOUBLE), CAST({float(hi)} AS DOUBLE), n{i}, b{i}, a{i}"
        for i, (c, lo, hi) in enumerate(present))
    return wide.selectExpr(
        f"stack({len(present)}, {rows}) AS (column_name, rule_min, rule_max, n_checked, n_below, n_above)")
