"""DuckDB SQL text of the shared pipeline stages, for the oracle queries.

Each stage is a CTE chained after the ``cohort`` CTE, so every oracle
string is self-contained. These mirror the DataFrame operators' semantics
(null-keeping clips, NULL on division by zero, pairwise deletion).
"""

from __future__ import annotations

from ..functions.columns import hash_unit_sql
from ..sources.cohort import COHORT_SQL

MEASURE_COLS = ("age", "bmi", "triglycerides", "hdl_cholesterol",
                "waist_circumference", "hip_circumference")

PREPARED = """
prepared AS (
  SELECT patient_id, ts, age,
    CASE WHEN fasting_glucose < 40 THEN 40.0 WHEN fasting_glucose > 600 THEN 600.0
         ELSE fasting_glucose END AS fasting_glucose,
    CASE WHEN fasting_insulin < 0.1 THEN 0.1 ELSE fasting_insulin END AS fasting_insulin,
    bmi, triglycerides, hdl_cholesterol, waist_circumference, hip_circumference,
    sex, segment, site,
    CAST(fasting_glucose * fasting_insulin / 405.0 > 2.5 AS INTEGER) AS ir_label
  FROM cohort
  WHERE fasting_glucose IS NOT NULL AND fasting_insulin IS NOT NULL
    AND NOT coalesce(age < 0 OR age > 150, false)
)"""


def _lo(x: str, lo: float) -> str:
    return f"(CASE WHEN {x} < {lo} THEN {lo} ELSE {x} END)"


def engineered_cte(name: str = "engineered", src: str = "prepared",
                   fill_from: str | None = None) -> str:
    """Engineered features; ``fill_from`` names a one-row CTE of medians ``m_<col>``."""
    def inp(c: str) -> str:
        return f"coalesce({c}, med.m_{c})" if fill_from else c
    join = f" CROSS JOIN {fill_from} med" if fill_from else ""
    return f"""
{name} AS (
  SELECT s.*,
    1.0 / NULLIF(ln({_lo(inp('fasting_insulin'), 1.0)}) + ln({_lo(inp('fasting_glucose'), 1.0)}), 0)
      AS quicki,
    {inp('triglycerides')} / {_lo(inp('hdl_cholesterol'), 0.1)} AS tg_hdl_ratio,
    {inp('waist_circumference')} / {_lo(inp('hip_circumference'), 0.1)} AS waist_hip_ratio,
    {inp('age')} * {inp('bmi')} AS age_bmi,
    ln(1 + fasting_glucose) AS fasting_glucose_log,
    ln(1 + fasting_insulin) AS fasting_insulin_log,
    ln(1 + triglycerides) AS triglycerides_log
  FROM {src} s{join}
)"""


MEDIANS = """
medians AS (
  SELECT median(age) AS m_age, median(fasting_glucose) AS m_fasting_glucose,
    median(fasting_insulin) AS m_fasting_insulin, median(bmi) AS m_bmi,
    median(triglycerides) AS m_triglycerides, median(hdl_cholesterol) AS m_hdl_cholesterol,
    median(waist_circumference) AS m_waist_circumference,
    median(hip_circumference) AS m_hip_circumference
  FROM prepared
)"""

LABELLED = """
labelled AS (
  SELECT *, CAST(fasting_glucose * fasting_insulin / 405.0 > 2.5 AS INTEGER) AS ir_label
  FROM cohort WHERE fasting_glucose IS NOT NULL AND fasting_insulin IS NOT NULL
)"""

SCORES = """
scores AS (
  SELECT patient_id, ts, ir_label AS y, bmi,
         1.0 / (1.0 + exp(-0.25 * (bmi - 26.0))) AS p
  FROM labelled WHERE bmi IS NOT NULL
)"""


def split_hash(key: str = "patient_id", salt: str | int = 42) -> str:
    return hash_unit_sql(key, salt)


def with_ctes(*ctes: str, body: str) -> str:
    """``WITH cohort AS (...), <ctes> <body>``."""
    parts = [f"cohort AS ({COHORT_SQL})", *[c.strip() for c in ctes]]
    return "WITH " + ",\n".join(parts) + "\n" + body
