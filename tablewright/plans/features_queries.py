"""Feature queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import cohort as C
from tablewright.operators import features as X
from tablewright.plans.registry import query
from tablewright.plans.cohort_queries import BASE, READMISSION, base
from tablewright.sources import warehouse as W

CLEAN = "replace(upper(coalesce(icd_code, '')), '.', '')"


@query("event_semi_scan", "SELECT event_id, user_id, event_type, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def event_semi_scan(spark, d):
    keys = W.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return X.semi_scan(W.table(spark, d, "events"), keys, "user_id").select("event_id", "user_id", "event_type", "value")


@query("event_semi_filtered", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def event_semi_filtered(spark, d):
    keys = W.table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return X.semi_scan_filtered(W.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), keys, "l_orderkey")


@query("enrich_dictionary", W.sql("SELECT hadm_id, seq_num, icd_code, icd_version, long_title FROM diagnoses LEFT JOIN code_dictionary USING (icd_code, icd_version)"))
def enrich_dictionary(spark, d):
    return X.enrich(W.diagnoses(spark, d), W.code_dictionary(spark, d), ["icd_code", "icd_version"]).select("hadm_id", "seq_num", "icd_code", "icd_version", "long_title")


def _flags(key: str, column: str, prefix: str, n: int, source: str) -> str:
    """Top flags in long form: (key, value, 1) for the n most frequent values."""
    return f"""t_{prefix} AS (SELECT {column} AS v FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {n}),
  k_{prefix} AS (SELECT DISTINCT {key}, {column} AS v FROM {source} WHERE {column} IN (SELECT v FROM t_{prefix}))"""


def _long(df, key: str, prefix: str, names: list[str]):
    """Flag columns of a wide table in long form, so that SQL need not know their names."""
    wide = [c for c in df.columns if c.startswith(prefix) and c not in names]
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("on")) for c in wide])).alias("f")).select(key, "f.flag", "f.on").where("on is not null")


def _long_sql(key: str, prefix: str, name: str) -> str:
    return f"""SELECT w.{key}, '{name}' || v AS flag, max(CASE WHEN k.v = t.v THEN 1 ELSE 0 END)::INT AS "on"
  FROM (SELECT DISTINCT {key} FROM k_{prefix}) w CROSS JOIN t_{prefix} t LEFT JOIN (SELECT {key}, v FROM k_{prefix}) k USING ({key}, v) GROUP BY ALL"""


@query("top_flag_pivot", W.sql(f"c AS (SELECT hadm_id, substr({CLEAN}, 1, 3) AS root FROM diagnoses), {_flags('hadm_id', 'root', 'dx', 12, 'c')} {_long_sql('hadm_id', 'dx', 'dx_')}"))
def top_flag_pivot(spark, d):
    from tablewright.functions.cells import code_prefix

    rows = W.diagnoses(spark, d).withColumn("root", code_prefix(F.col("icd_code")))
    return _long(X.top_flags(rows, "hadm_id", "root", "dx_", 12), "hadm_id", "dx_", [])


@query(
    "diagnosis_features",
    W.sql(f"""c AS (SELECT hadm_id, {CLEAN} AS code FROM diagnoses) SELECT hadm_id, count(*) AS dx_count, count(DISTINCT code) AS dx_distinct,
  coalesce(string_agg(DISTINCT code, '|' ORDER BY code) FILTER (trim(code) <> ''), '') AS dx_codes FROM c GROUP BY 1"""),
)
def diagnosis_features(spark, d):
    return X.code_features(W.diagnoses(spark, d), "hadm_id", "dx").select("hadm_id", "dx_count", "dx_distinct", "dx_codes")


@query(
    "primary_code",
    W.sql(f"""j AS (SELECT hadm_id, seq_num::INT AS s, icd_code, icd_version, long_title, row_number() OVER (PARTITION BY hadm_id ORDER BY seq_num::INT, icd_code, icd_version, long_title) AS r
  FROM diagnoses LEFT JOIN code_dictionary USING (icd_code, icd_version)) SELECT hadm_id, icd_code AS primary_code, substr({CLEAN}, 1, 3) AS primary_prefix, long_title AS primary_title FROM j WHERE r = 1"""),
)
def primary_code(spark, d):
    return X.primary_code(X.enrich(W.diagnoses(spark, d), W.code_dictionary(spark, d), ["icd_code", "icd_version"]))


@query(
    "procedure_features",
    W.sql(f"""c AS (SELECT hadm_id, {CLEAN} AS code, long_title FROM diagnoses LEFT JOIN code_dictionary USING (icd_code, icd_version))
  SELECT hadm_id, count(*) AS px_count, count(DISTINCT code) AS px_distinct, string_agg(DISTINCT code, '|' ORDER BY code) AS px_codes,
  coalesce(string_agg(DISTINCT long_title, '|' ORDER BY long_title), '') AS px_titles FROM c GROUP BY 1"""),
)
def procedure_features(spark, d):
    rows = X.enrich(W.diagnoses(spark, d), W.code_dictionary(spark, d), ["icd_code", "icd_version"])
    return X.code_features(rows, "hadm_id", "px", titles=True).select("hadm_id", "px_count", "px_distinct", "px_codes", "px_titles")


@query("medication_features", W.sql(r"""c AS (SELECT hadm_id, trim(regexp_replace(upper(trim(drug)), '[^A-Z0-9]+', '_', 'g'), '_') AS name FROM prescriptions),
  """ + _flags("hadm_id", "name", "med", 30, "c") + """ SELECT hadm_id, count(*) AS med_count, count(DISTINCT name) AS med_distinct,
  (SELECT count(*) FROM k_med k WHERE k.hadm_id = c.hadm_id) AS med_flags FROM c GROUP BY hadm_id"""))
def medication_features(spark, d):
    f = X.medication_features(W.prescriptions(spark, d), "hadm_id")
    flags = [c for c in f.columns if c.startswith("med_") and c not in ("med_count", "med_distinct")]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in flags), F.lit(0))
    return f.select("hadm_id", "med_count", "med_distinct", total.cast("long").alias("med_flags"))


MEASURES = """m AS (SELECT hadm_id, itemid, coalesce(label, itemid::VARCHAR) AS item, try_cast(valuenum AS DOUBLE) AS v FROM measures LEFT JOIN item_dictionary USING (itemid)),
  t AS (SELECT item FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
  a AS (SELECT hadm_id, count(*) AS lab_events, count(DISTINCT itemid) AS lab_items FROM m GROUP BY 1),
  s AS (SELECT hadm_id, item, count(v) AS n, avg(v) AS mean, min(v) AS lo, max(v) AS hi FROM m WHERE item IN (SELECT item FROM t) GROUP BY 1, 2)"""


@query("measure_features", W.sql(MEASURES + " SELECT a.*, sum(coalesce(n, 0))::BIGINT AS numbers, round(sum(coalesce(mean, 0)), 6) AS means, min(lo) AS lo, max(hi) AS hi FROM a LEFT JOIN s USING (hadm_id) GROUP BY ALL"))
def measure_features(spark, d):
    f = X.measure_features(W.measures(spark, d), W.item_dictionary(spark, d), "hadm_id", "lab", 10)
    every = lambda end: [F.col(f"`{c}`") for c in f.columns if c.endswith(end)]
    total = lambda cs: sum((F.coalesce(c, F.lit(0)) for c in cs), F.lit(0))
    return f.select("hadm_id", "lab_events", "lab_items", total(every("_count")).cast("long").alias("numbers"), F.round(total(every("_mean")), 6).alias("means"), F.least(*every("_min")).alias("lo"), F.greatest(*every("_max")).alias("hi"))


@query(
    "stay_event_features",
    W.sql("""l AS (SELECT *, epoch(outtime - intime) / 86400.0 AS los FROM stays), o AS (SELECT hadm_id, count(DISTINCT stay_id) AS icu_stays, avg(los) AS icu_los_mean, max(los) AS icu_los_max FROM l GROUP BY 1),
  e AS (SELECT s.hadm_id, itemid FROM measures m JOIN stays s ON s.hadm_id = m.hadm_id) SELECT o.*, n AS chart_events, k AS chart_items FROM o LEFT JOIN (SELECT hadm_id, count(*) AS n, count(DISTINCT itemid) AS k FROM e GROUP BY 1) USING (hadm_id)"""),
)
def stay_event_features(spark, d):
    stays = C.with_length_of_stay(W.stays(spark, d))
    events = W.measures(spark, d).withColumn("stay_id", F.col("hadm_id") * 10 + 3).drop("hadm_id")
    return X.stay_event_features(stays, events, "hadm_id").select("hadm_id", "icu_stays", "icu_los_mean", "icu_los_max", "chart_events", "chart_items")


@query("feature_empty_fallback", W.sql("SELECT DISTINCT hadm_id FROM stays"))
def feature_empty_fallback(spark, d):
    return X.empty_features(W.stays(spark, d), "hadm_id")


@query(
    "features_wide",
    W.sql(f"""{BASE}, {READMISSION}, c AS (SELECT hadm_id, {CLEAN} AS code FROM diagnoses),
  dx AS (SELECT hadm_id, count(*) AS dx_count, count(DISTINCT code) AS dx_distinct FROM c GROUP BY 1),
  lab AS (SELECT hadm_id, count(*) AS lab_events, count(DISTINCT itemid) AS lab_items FROM measures GROUP BY 1),
  med AS (SELECT hadm_id, count(*) AS med_count FROM prescriptions GROUP BY 1)
  SELECT hadm_id, stay_id, subject_id, label, "Age", gender, los, dx_count, dx_distinct, lab_events, lab_items, med_count
  FROM labelled LEFT JOIN dx USING (hadm_id) LEFT JOIN lab USING (hadm_id) LEFT JOIN med USING (hadm_id)"""),
)
def features_wide(spark, d):
    cohort = C.label_readmission(base(spark, d), "stay_id")
    dx = X.code_features(W.diagnoses(spark, d), "hadm_id", "dx")
    lab = X.measure_features(W.measures(spark, d), W.item_dictionary(spark, d), "hadm_id", "lab", 10)
    med = X.medication_features(W.prescriptions(spark, d), "hadm_id", 10)
    wide = X.assemble(cohort, [dx, lab, med], "hadm_id", grouped=True)
    return wide.select("hadm_id", "stay_id", "subject_id", "label", "Age", "gender", "los", "dx_count", "dx_distinct", "lab_events", "lab_items", "med_count")


@query("promote_numeric", W.sql("""SELECT 'valuenum' AS "column", count(valuenum) AS present, count(try_cast(valuenum AS DOUBLE)) AS parsed, count(try_cast(valuenum AS DOUBLE)) >= 0.8 * count(valuenum) AS promoted FROM measures
  UNION ALL SELECT 'drug', count(drug), count(try_cast(drug AS DOUBLE)), count(try_cast(drug AS DOUBLE)) >= 0.8 * count(drug) FROM prescriptions"""))
def promote_numeric(spark, d):
    return X.numeric_columns(W.measures(spark, d), ["hadm_id"]).unionByName(X.numeric_columns(W.prescriptions(spark, d), []))
