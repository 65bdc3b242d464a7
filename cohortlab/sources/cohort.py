"""The ``cohort`` view: one row per order with lab-like measures.

The driver tables hold no nulls and lineitem has no unique key, so the
cohort fixture derives a wide measurement table with nulls, outliers,
categories, a unique key and a learnable label from orders, customer and
lineitem. ``COHORT_SQL`` is the same definition as DuckDB SQL text; every
oracle query pastes it in as a CTE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

KEY = "patient_id"
LABEL = "ir_label"

COHORT_SQL = """
WITH li AS (SELECT l_orderkey, CAST(count(*) AS INT) AS n_lines,
                   CAST(sum(l_quantity) AS DOUBLE) AS sum_qty,
                   CAST(max(l_extendedprice) AS DOUBLE) AS max_price
            FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey AS patient_id, o.o_orderdate AS ts,
  CAST(CASE WHEN o.o_orderkey % 97 = 0 THEN 200 WHEN o.o_orderkey % 89 = 0 THEN NULL
            ELSE 18 + o.o_custkey % 73 END AS DOUBLE) AS age,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
       WHEN o.o_orderkey % 101 = 0 THEN CAST(700 AS DOUBLE)
       WHEN o.o_orderkey % 103 = 0 THEN CAST(20 AS DOUBLE)
       ELSE 60 + o.o_totalprice / 4000 END AS fasting_glucose,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE sum_qty / 12 END AS fasting_insulin,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE 16 + n_lines * 2 + c.c_acctbal / 2000 END AS bmi,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE 50 + max_price / 500 END AS triglycerides,
  CAST(CASE WHEN o.o_orderkey % 107 = 0 THEN 0 ELSE 25 + o.o_custkey % 60 END AS DOUBLE) AS hdl_cholesterol,
  CAST(60 + n_lines * 5 + o.o_custkey % 20 AS DOUBLE) AS waist_circumference,
  CAST(80 + o.o_custkey % 50 AS DOUBLE) AS hip_circumference,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL WHEN o.o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  c.c_mktsegment AS segment, c.c_name AS site
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN li ON li.l_orderkey = o.o_orderkey
"""

MEASURES = ("age", "fasting_glucose", "fasting_insulin", "bmi", "triglycerides",
            "hdl_cholesterol", "waist_circumference", "hip_circumference")
CATEGORICALS = ("sex", "segment", "site")


def _every(k: Column, m: int) -> Column:
    return (k % m) == 0


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort DataFrame; the lineitem roll-up shuffles once on the order key."""
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).cast("int").alias("n_lines"),
               F.sum("l_quantity").cast("double").alias("sum_qty"),
               F.max("l_extendedprice").cast("double").alias("max_price")))
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", "c_name")
    j = (o.join(c, o.o_custkey == c.c_custkey, "inner")
          .join(li, li.l_orderkey == o.o_orderkey, "left"))
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    null = F.lit(None).cast("double")
    return j.select(
        k.alias(KEY),
        F.col("o_orderdate").alias("ts"),
        F.when(_every(k, 97), F.lit(200.0)).when(_every(k, 89), null)
         .otherwise((18 + ck % 73).cast("double")).alias("age"),
        F.when(_every(k, 11), null).when(_every(k, 101), F.lit(700.0))
         .when(_every(k, 103), F.lit(20.0))
         .otherwise(60 + F.col("o_totalprice") / 4000).alias("fasting_glucose"),
        F.when(_every(k, 7), null).otherwise(F.col("sum_qty") / 12).alias("fasting_insulin"),
        F.when(_every(k, 13), null)
         .otherwise(16 + F.col("n_lines") * 2 + F.col("c_acctbal") / 2000).alias("bmi"),
        F.when(_every(k, 17), null).otherwise(50 + F.col("max_price") / 500).alias("triglycerides"),
        F.when(_every(k, 107), F.lit(0.0)).otherwise((25 + ck % 60).cast("double"))
         .alias("hdl_cholesterol"),
        (60 + F.col("n_lines") * 5 + ck % 20).cast("double").alias("waist_circumference"),
        (80 + ck % 50).cast("double").alias("hip_circumference"),
        F.when(_every(k, 19), F.lit(None).cast("string"))
         .when(ck % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("sex"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_name").alias("site"),
    )


def with_cohort(sql_body: str) -> str:
    """Prefix an oracle query with the cohort CTE."""
    return f"WITH cohort AS ({COHORT_SQL})\n{sql_body}"
