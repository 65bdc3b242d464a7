"""Column expressions shared by the operators.

Everything here is a built-in Catalyst expression, so it stays inside
whole-stage codegen; none of it is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Null-keeping clip: ``greatest(NULL, lo)`` would turn a NULL into ``lo``."""
    c = col(c)
    out = c
    if lo is not None and hi is not None:
        out = F.when(c < lo, F.lit(float(lo))).when(c > hi, F.lit(float(hi))).otherwise(c)
    elif lo is not None:
        out = F.when(c < lo, F.lit(float(lo))).otherwise(c)
    elif hi is not None:
        out = F.when(c > hi, F.lit(float(hi))).otherwise(c)
    return out


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Division that yields NULL instead of raising (ANSI) or giving inf."""
    return F.try_divide(col(a), col(b))


def hash_unit(key: Column | str, salt: str | int = 42) -> Column:
    """Deterministic uniform number in [0, 1) from a row key.

    First 32 bits of md5('<salt>:<key>'); order-free and identical on every
    recomputation, so splits survive executor loss and re-runs.
    """
    text = F.concat(F.lit(f"{salt}:"), col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def hash_unit_sql(key_sql: str, salt: str | int = 42) -> str:
    """DuckDB text of :func:`hash_unit` for oracle queries."""
    return (f"(('0x' || substr(md5(concat('{salt}:', CAST({key_sql} AS VARCHAR))), 1, 8))::BIGINT"
            f" / 4294967296.0)")


def null_safe_true(cond: Column) -> Column:
    """``cond`` with NULL read as False (pandas comparisons on NaN are False)."""
    return F.coalesce(cond, F.lit(False))


def risk_level(p: Column | str) -> Column:
    p = col(p)
    # fixed values: risk cut points 0.33 and 0.67
    return (F.when(p < 0.33, F.lit("low")).when(p < 0.67, F.lit("medium"))
            .otherwise(F.lit("high")))


def feature_hash(*cols: str) -> Column:
    """sha1 over a canonical text of the feature row (6 decimals, NULL -> '')."""
    parts = [F.coalesce(F.floor(F.col(c).cast("double") * 1e6 + 0.5).cast("bigint").cast("string"),
                        F.lit("")) for c in cols]
    return F.sha1(F.concat_ws("|", *parts))


def round_out(c: Column | str, digits: int = 6) -> Column:
    """Round a *final* floating aggregate (never row values mid-pipeline)."""
    return F.round(col(c), digits)
