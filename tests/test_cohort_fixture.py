"""The cohort view reproduces the facts FIXTURES.md states for sf0.01."""

from pyspark.sql import functions as F

from cohortlab.operators import clean
from cohortlab.sources.cohort import cohort

from conftest import SF_ORACLE


def test_cohort_counts_at_sf001(spark):
    c = cohort(spark, SF_ORACLE)
    r = c.agg(F.count(F.lit(1)).alias("n"), F.count("age").alias("age"),
              F.count("fasting_glucose").alias("glu"), F.count("fasting_insulin").alias("ins"),
              F.count("bmi").alias("bmi"), F.count("sex").alias("sex"),
              F.countDistinct("patient_id").alias("keys")).collect()[0]
    assert (r.n, r.age, r.glu, r.ins, r.bmi, r.sex, r.keys) == \
        (15000, 14833, 13636, 12636, 13615, 14210, 15000)
    lab = clean.derive_label(c).groupBy("ir_label").count().collect()
    assert sorted((x.ir_label, x["count"]) for x in lab) == [(0, 6330), (1, 5162)]
