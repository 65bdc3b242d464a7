"""Derived ratio, interaction and log features (one projection)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, safe_div
from .clean import GLUCOSE, INSULIN, LABEL

ENGINEERED = ("quicki", "tg_hdl_ratio", "waist_hip_ratio", "age_bmi",
              "fasting_glucose_log", "fasting_insulin_log", "triglycerides_log")

# inputs of the filled features (the log features are never filled)
FILL_INPUTS = ("fasting_glucose", "fasting_insulin", "triglycerides", "hdl_cholesterol",
               "waist_circumference", "hip_circumference", "age", "bmi")

# label and label-construction columns removed before preprocessing
LEAKAGE_INPUTS = (LABEL, GLUCOSE, INSULIN, "fasting_glucose_log", "fasting_insulin_log", "quicki")

MISSING_CATEGORY = "__missing__"


def engineer(df: DataFrame, medians: Mapping[str, float] | None = None) -> DataFrame:
    """Add the engineered columns that the present inputs allow.

    ``medians=None`` propagates NULLs (serving path); a dict fills the
    inputs of quicki / ratios / age_bmi with those medians (training path).
    Division by zero gives NULL instead of inf.
    """
    cols = set(df.columns)

    def inp(name: str) -> Column:
        c = F.col(name)
        if medians is not None and name in medians and medians[name] is not None:
            c = F.coalesce(c, F.lit(float(medians[name])))
        return c

    new: dict[str, Column] = {}
    if {GLUCOSE, INSULIN} <= cols:
        denom = F.ln(clip(inp(INSULIN), lo=1)) + F.ln(clip(inp(GLUCOSE), lo=1))
        new["quicki"] = safe_div(F.lit(1.0), denom)
    if {"triglycerides", "hdl_cholesterol"} <= cols:
        new["tg_hdl_ratio"] = safe_div(inp("triglycerides"), clip(inp("hdl_cholesterol"), lo=0.1))
    if {"waist_circumference", "hip_circumference"} <= cols:
        new["waist_hip_ratio"] = safe_div(inp("waist_circumference"),
                                          clip(inp("hip_circumference"), lo=0.1))
    if {"age", "bmi"} <= cols:
        new["age_bmi"] = inp("age") * inp("bmi")
    for src in (GLUCOSE, INSULIN, "triglycerides"):
        if src in cols:
            new[f"{src}_log"] = F.log1p(F.col(src))
    keep = [c for c in df.columns if c not in new]
    return df.select(*keep, *[c.alias(n) for n, c in new.items()])


def drop_leakage_inputs(df: DataFrame, extra: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Remove the label and label-construction columns (``keep`` spares some, e.g. the label)."""
    return df.drop(*[c for c in (*LEAKAGE_INPUTS, *extra) if c in df.columns and c not in keep])


def align_schema(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                 selected: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Add absent numeric columns as NULL, categorical as '__missing__'; optionally select."""
    for c in numeric:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    for c in categorical:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(MISSING_CATEGORY))
    if selected is not None:
        df = df.select(*keep, *[c for c in selected if c in df.columns and c not in keep])
    return df
