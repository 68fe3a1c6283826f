"""Cohort queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import cohort as C
from tablewright.plans.registry import query
from tablewright.sources import warehouse as W

BASE = """base AS (SELECT s.stay_id, s.hadm_id, s.subject_id, s.intime, s.outtime, gender, anchor_age, dod, admittime, insurance, race,
  epoch(s.outtime - s.intime) / 86400.0 AS los, anchor_age AS "Age", race AS ethnicity
  FROM stays s LEFT JOIN patients p ON p.subject_id = s.subject_id LEFT JOIN admissions a ON a.hadm_id = s.hadm_id)"""


def base(spark, d):
    return C.visit_base(W.stays(spark, d), W.patients(spark, d), W.admissions(spark, d))


@query("visit_base", W.sql(BASE + " SELECT * FROM base"))
def visit_base(spark, d):
    return base(spark, d)


@query("visit_los", W.sql("SELECT stay_id, epoch(outtime - intime) / 86400.0 AS los FROM stays"))
def visit_los(spark, d):
    return C.with_length_of_stay(W.stays(spark, d)).select("stay_id", "los")


@query("dedupe_grain", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS r FROM lineitem) WHERE r = 1")
def dedupe_grain(spark, d):
    rows = W.table(spark, d, "lineitem")
    return C.dedupe(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("label_event_in_window", W.sql(BASE + " SELECT stay_id, CASE WHEN dod BETWEEN intime AND outtime THEN 1 ELSE 0 END AS label FROM base"))
def label_event_in_window(spark, d):
    return C.label_event_in_window(base(spark, d), "dod", "intime", "outtime").select("stay_id", "label")


READMISSION = """labelled AS (SELECT *, CASE WHEN gap > 0 AND gap <= 30 * 86400 THEN 1 ELSE 0 END AS label FROM
  (SELECT *, epoch(lead(intime) OVER (PARTITION BY subject_id ORDER BY intime, stay_id) - outtime) AS gap FROM base))"""


@query("label_readmission", W.sql(f"{BASE}, {READMISSION} SELECT stay_id, label FROM labelled"))
def label_readmission(spark, d):
    return C.label_readmission(base(spark, d), "stay_id").select("stay_id", "label")


@query("label_long_stay", W.sql(BASE + " SELECT stay_id, CASE WHEN los > 60 THEN 1 ELSE 0 END AS label FROM base"))
def label_long_stay(spark, d):
    return C.label_long_stay(base(spark, d), 60).select("stay_id", "label")


@query("label_constant", W.sql("SELECT stay_id, 1 AS label FROM stays"))
def label_constant(spark, d):
    return C.label_constant(W.stays(spark, d)).select("stay_id", "label")


@query("label_distribution", W.sql(f"{BASE}, {READMISSION} SELECT label, count(*) AS n FROM labelled GROUP BY 1"))
def label_distribution(spark, d):
    return C.label_distribution(C.label_readmission(base(spark, d), "stay_id"))


@query("case_key_filter", W.sql("SELECT stay_id, hadm_id FROM stays WHERE hadm_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')"))
def case_key_filter(spark, d):
    keys = W.table(spark, d, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("hadm_id"))
    return C.case_key_filter(W.stays(spark, d), keys, "case_id").select("stay_id", "hadm_id")


@query(
    "resolve_code_terms",
    W.sql("""f AS (SELECT *, substr(replace(upper(icd_code), '.', ''), 1, 3) AS prefix FROM code_dictionary WHERE lower(long_title) LIKE '%red%' OR lower(long_title) LIKE '%gear%'),
  g AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY icd_code, icd_version, long_title) AS r FROM f),
  h AS (SELECT prefix, count(*) AS n, string_agg(icd_code, '|' ORDER BY icd_code) FILTER (r <= 3) AS examples FROM g GROUP BY 1 ORDER BY n DESC, prefix LIMIT 25)
  SELECT *, row_number() OVER (ORDER BY n DESC, prefix) <= 5 AS selected FROM h"""),
)
def resolve_code_terms(spark, d):
    return C.resolve_code_terms(W.code_dictionary(spark, d), ["Red", "gear"])


@query("filter_code_cohort", W.sql("SELECT stay_id FROM stays WHERE hadm_id IN (SELECT hadm_id FROM diagnoses WHERE seq_num::INT = 1 AND (starts_with(replace(upper(icd_code), '.', ''), 'B1') OR starts_with(replace(upper(icd_code), '.', ''), 'B203')))"))
def filter_code_cohort(spark, d):
    return C.filter_code_cohort(W.stays(spark, d), W.diagnoses(spark, d), ["b1", "b.20.3"], primary_only=True).select("stay_id")
