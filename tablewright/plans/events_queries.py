"""Event-package queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import cohort as C
from tablewright.operators import events as E
from tablewright.plans.cohort_queries import BASE, base
from tablewright.plans.registry import query
from tablewright.sources import warehouse as W

DIED = 'died AS (SELECT *, CASE WHEN dod BETWEEN intime AND outtime THEN 1 ELSE 0 END AS label FROM base)'
CONTRACT = f"""{BASE}, {DIED}, cohort AS (SELECT subject_id, stay_id, intime, outtime, "Age", gender, ethnicity, insurance, label, dod, hadm_id FROM died WHERE "Age" >= 18)"""


def cohort(spark, d):
    return E.cohort_contract(C.label_event_in_window(base(spark, d), "dod", "intime", "outtime"))


@query("cohort_contract", W.sql(CONTRACT + " SELECT * FROM cohort"))
def cohort_contract(spark, d):
    return cohort(spark, d)


@query(
    "event_bucket_window",
    W.sql("""a AS (SELECT stay_id, itemid, valuenum, epoch(charttime - intime) AS since FROM measures JOIN stays USING (hadm_id))
  SELECT stay_id, itemid, floor(since / 7200)::BIGINT AS bucket, count(*) AS n, avg(try_cast(valuenum AS DOUBLE)) AS value FROM a WHERE since >= 0 AND since < 1440 * 3600 GROUP BY ALL"""),
)
def event_bucket_window(spark, d):
    return E.bucket_events(W.measures(spark, d), W.stays(spark, d), "hadm_id", 1440, 2)


@query(
    "map_code_system",
    W.sql("""m AS (SELECT DISTINCT icd_code, 'N' || substr(icd_code, 3) AS new_icd_code FROM code_dictionary WHERE icd_version = 9)
  SELECT DISTINCT hadm_id, new_icd_code, substr(new_icd_code, 1, 3) AS root_icd_code FROM diagnoses JOIN m USING (icd_code)"""),
)
def map_code_system(spark, d):
    mapping = W.code_dictionary(spark, d).where("icd_version = 9").select("icd_code", F.expr("concat('N', substr(icd_code, 3))").alias("new_icd_code")).distinct()
    return E.map_codes(W.diagnoses(spark, d), mapping)


@query("item_summary", W.sql("SELECT itemid, count(*) AS total_count, count(DISTINCT hadm_id) AS visits, round(sum(CASE WHEN try_cast(valuenum AS DOUBLE) IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS missing_rate FROM measures GROUP BY 1"))
def item_summary(spark, d):
    return E.item_summary(W.measures(spark, d))


FAMILY = """SELECT '{0}' AS family, {1}::VARCHAR AS item, count(*) AS n, count(DISTINCT hadm_id) AS visits, count({2}) AS filled FROM {3} GROUP BY 2"""


@query(
    "summary_tables",
    W.sql("f AS (" + " UNION ALL ".join(FAMILY.format(*x) for x in (("chart", "itemid", "try_cast(valuenum AS DOUBLE)", "measures"), ("diag", "icd_code", "icd_code", "diagnoses"), ("med", "drug", "drug", "prescriptions"))) + """)
  SELECT family || '_summary' AS name, item, n AS total_count, visits, round(1 - filled / n, 6) AS missing_rate FROM f WHERE item IS NOT NULL UNION ALL
  SELECT family || '_features', item, filled, visits, round(1 - filled / n, 6) FROM f WHERE item IS NOT NULL AND filled > 0"""),
)
def summary_tables(spark, d):
    return E.summary_tables({"chart": (W.measures(spark, d), "itemid", "valuenum"), "diag": (W.diagnoses(spark, d), "icd_code", None), "med": (W.prescriptions(spark, d), "drug", None)})


FAMILIES = (
    ("chart", "itemid", "try_cast(valuenum AS DOUBLE)", "measures"), ("diag", "icd_code", "icd_code", "diagnoses"), ("med", "drug", "drug", "prescriptions"),
    ("out", "event_type", "CASE WHEN value > 20 THEN value END", "(SELECT *, user_id AS hadm_id FROM events)"), ("proc", "l_suppkey", "CASE WHEN l_suppkey % 3 = 0 THEN 1 END", "diagnoses"),
)


@query(
    "summary_families",
    W.sql("f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS family, {i}::VARCHAR AS item, hadm_id AS visit, {v} IS NOT NULL AS filled FROM {t}" for n, i, v, t in FAMILIES) + """),
  g AS (SELECT family, CASE WHEN grouping(item) = 1 THEN '*' ELSE item END AS item, count(*) AS n, count(DISTINCT visit) AS visits, count(*) FILTER (filled) AS filled FROM f WHERE item IS NOT NULL GROUP BY GROUPING SETS ((family, item), (family)))
  SELECT family || '_summary' AS name, item, n AS total_count, visits, round(1 - filled / n, 6) AS missing_rate FROM g UNION ALL
  SELECT family || '_features', item, filled, visits, round(1 - filled / n, 6) FROM g WHERE filled > 0"""),
)
def summary_families(spark, d):
    c = F.col
    lines = {"chart": (c("itemid"), c("valuenum").try_cast("double")), "diag": (c("icd_code"), c("icd_code")), "proc": (c("l_suppkey"), F.when(c("l_suppkey") % 3 == 0, 1))}
    out = {"out": (c("event_type"), F.when(c("value") > 20, c("value")))}
    sources = [(W.coded_measures(spark, d), c("hadm_id"), lines), (W.prescriptions(spark, d), c("hadm_id"), {"med": (c("drug"), c("drug"))}), (W.table(spark, d, "events"), c("user_id"), out)]
    return E.family_tables(sources, W.table(spark, d, "lineitem"))


@query("stay_demo", W.sql(CONTRACT + ' SELECT stay_id, "Age", gender, ethnicity, insurance FROM cohort'))
def stay_demo(spark, d):
    return E.stay_demo(cohort(spark, d))


@query("stay_static", W.sql("""m AS (SELECT DISTINCT icd_code, 'N' || substr(icd_code, 3) AS new_icd_code FROM code_dictionary WHERE icd_version = 9)
  SELECT DISTINCT stay_id, substr(new_icd_code, 1, 3) AS root, 1 AS value FROM stays JOIN diagnoses USING (hadm_id) JOIN m USING (icd_code)"""))
def stay_static(spark, d):
    return E.stay_static(W.stays(spark, d), map_code_system(spark, d), "hadm_id")


@query("label_eligible", W.sql("SELECT stay_id, hours FROM (SELECT stay_id, floor(epoch(outtime - intime) / 3600)::BIGINT AS hours FROM stays) WHERE hours >= 74"))
def label_eligible(spark, d):
    return E.label_eligible(W.stays(spark, d)).select("stay_id", "hours")


@query(
    "stay_dynamic",
    W.sql("""a AS (SELECT stay_id, itemid, valuenum, epoch(charttime - intime) AS since FROM measures JOIN stays USING (hadm_id))
  SELECT stay_id, bucket, count(*) AS items, round(sum(value), 6) AS total FROM (SELECT stay_id, itemid, floor(since / 86400)::BIGINT AS bucket, avg(try_cast(valuenum AS DOUBLE)) AS value FROM a WHERE since >= 0 AND since < 2400 * 3600 GROUP BY ALL) GROUP BY ALL"""),
)
def stay_dynamic(spark, d):
    b = E.bucket_events(W.measures(spark, d), W.stays(spark, d), "hadm_id", 2400, 24)
    return b.groupBy("stay_id", "bucket").agg(F.count("*").alias("items"), F.round(F.sum("value"), 6).alias("total"))


@query("vocab_index", W.sql("SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx FROM (SELECT DISTINCT drug AS value FROM prescriptions)"))
def vocab_index(spark, d):
    return E.vocabulary(W.prescriptions(spark, d), "drug")


CHECK = "SELECT '{0}' AS name, {1} = 0 AS passed, ({1})::BIGINT AS observed, 0::BIGINT AS expected FROM {2}"


@query(
    "package_checks",
    W.sql(
        CONTRACT
        + ", labels_ AS (SELECT stay_id, epoch(outtime - intime) AS s FROM stays WHERE floor(epoch(outtime - intime) / 3600) >= 74), known AS (SELECT stay_id, floor(epoch(outtime - intime) / 3600) AS h FROM cohort), j AS (SELECT l.stay_id, h FROM labels_ l LEFT JOIN known USING (stay_id)) "
        + " UNION ALL ".join(
            CHECK.format(*x)
            for x in (
                ("cohort_not_empty", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", "cohort"),
                ("adults", 'coalesce(sum(CASE WHEN "Age" < 18 THEN 1 ELSE 0 END), 0)', "cohort"),
                ("label_domain", "coalesce(sum(CASE WHEN label NOT IN (0, 1) THEN 1 ELSE 0 END), 0)", "cohort"),
                ("stay_not_null", "count(*) - count(stay_id)", "cohort"),
                ("stay_unique", "count(stay_id) - count(DISTINCT stay_id)", "cohort"),
                ("times_in_order", "coalesce(sum(CASE WHEN outtime < intime THEN 1 ELSE 0 END), 0)", "cohort"),
                ("label_rule", "coalesce(sum(CASE WHEN label <> (CASE WHEN dod BETWEEN intime AND outtime THEN 1 ELSE 0 END) THEN 1 ELSE 0 END), 0)", "cohort"),
                ("labels_subset", "coalesce(sum(CASE WHEN h IS NULL THEN 1 ELSE 0 END), 0)", "j"),
                ("label_window", "coalesce(sum(CASE WHEN h < 74 THEN 1 ELSE 0 END), 0)", "j"),
                ("labels_unique", "count(*) - count(DISTINCT stay_id)", "j"),
                ("chart_subset", "count(*)", "(SELECT DISTINCT stay_id FROM stays WHERE stay_id NOT IN (SELECT stay_id FROM cohort))"),
            )
        )
    ),
)
def package_checks(spark, d):
    stays = W.stays(spark, d)
    return E.package_checks(cohort(spark, d), E.label_eligible(stays), {"chart": stays.select("stay_id")})


FEATURE_FILES = ["preproc_chart_icu.csv.gz", "preproc_diag_icu.csv.gz", "preproc_med_icu.csv.gz", "preproc_out_icu.csv.gz", "preproc_proc_icu.csv.gz"]
INVENTORY = {"cohort_exists": ("cohort/", ["cohort.csv.gz"], False), "five_feature_files": ("features/", FEATURE_FILES, False), "labels_exists": ("csv/", ["labels.csv"], False), "dictionary_inventory": ("dict/", [f"d{i}" for i in range(6)], False), "summary_inventory": ("summary/", [f"s{i}.csv" for i in range(10)], True), "gold_candidate_inventory": ("", ["cohort/cohort.csv.gz", *[f"features/{f}" for f in FEATURE_FILES], "csv/labels.csv", *[f"summary/s{i}.csv" for i in range(10)]], False)}
LISTED = """files AS (SELECT DISTINCT 'cohort/cohort.csv.gz' AS path FROM part UNION SELECT 'csv/labels.csv' FROM part UNION SELECT 'features/preproc_' || ['chart', 'diag', 'med', 'out', 'other'][p_size % 5 + 1] || '_icu.csv.gz' FROM part
  UNION SELECT 'dict/d' || (p_size % 6) FROM part UNION SELECT 'summary/s' || (p_size % 11) || '.csv' FROM part UNION SELECT 'models/' || lower(p_brand[7:]) || '.PT' FROM part WHERE p_size = 7)"""


def listed(spark, d):
    p = W.table(spark, d, "part")
    kind = F.get(F.array(*map(F.lit, ("chart", "diag", "med", "out", "other"))), (F.col("p_size") % 5).cast("int"))
    text = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    own = F.array(F.lit("cohort/cohort.csv.gz"), F.lit("csv/labels.csv"), text("features/preproc_", kind, "_icu.csv.gz"), text("dict/d", (F.col("p_size") % 6).cast("string")), text("summary/s", (F.col("p_size") % 11).cast("string"), ".csv"))
    models = F.when(F.col("p_size") == 7, F.array(text("models/", F.lower(F.substring("p_brand", 7, 9)), ".PT"))).otherwise(F.array().cast("array<string>"))
    return p.select(F.explode(F.concat(own, models)).alias("path")).distinct()


def _told(name: str, wrong: dict[str, str], source: str, details: str = "''") -> str:
    n = ", ".join(f"({v})::BIGINT AS {k}" for k, v in wrong.items())
    json = " || ',' || ".join(f"""'"{k}":' || {k}""" for k in wrong)
    return f"SELECT '{name}' AS name, {' AND '.join(f'{k} = 0' for k in wrong)} AS passed, '{{' || {json} || '}}' AS observed, {details} AS details FROM (SELECT {n} FROM {source})"


def _inventory_sql() -> str:
    parts = []
    for k, (folder, paths, only) in INVENTORY.items():
        want = "SELECT unnest([" + ", ".join(f"'{folder}{p}'" for p in paths) + "]) AS path"
        more = f" UNION ALL SELECT path, 0, 1 FROM files WHERE path LIKE '{folder}%' AND path NOT IN ({want})" if only else ""
        rows = f"(SELECT path, (path NOT IN (SELECT path FROM files))::INT AS m, 0 AS e FROM ({want}){more})"
        parts.append(f"""SELECT '{k}' AS name, m + e = 0 AS passed, '{{"missing":' || m || ',"extra":' || e || '}}' AS observed, bad AS details FROM (SELECT sum(m)::BIGINT AS m, sum(e)::BIGINT AS e, coalesce(string_agg(path, ',' ORDER BY path) FILTER (m + e > 0), '') AS bad FROM {rows})""")
    return " UNION ALL ".join(parts)


@query(
    "validation_report",
    W.sql(
        CONTRACT + ", labels_ AS (SELECT stay_id, (stay_id % 3)::INT AS label FROM stays), known AS (SELECT stay_id, floor(epoch(outtime - intime) / 3600) AS h FROM cohort), j AS (SELECT l.*, h, k.stay_id IS NOT NULL AS here FROM labels_ l LEFT JOIN known k USING (stay_id)), " + LISTED
        + ", short AS (SELECT DISTINCT stay_id FROM j WHERE here AND (h IS NULL OR h < 74)), few AS (SELECT stay_id FROM short ORDER BY 1 LIMIT 20), demo AS (SELECT stay_id FROM cohort) "
        + " UNION ALL ".join((
            _told("cohort_schema", {"differs": "count(*) * 0"}, "cohort"), _told("labels_schema", {"differs": "count(*) * 0"}, "labels_"), _told("diagnosis_schema", {"differs": "(count(*) > 0)::INT"}, "diagnoses", "'hadm_id,icd_code'"), _told("original_data_untouched", {"differs": "count(*) * 0"}, "cohort"),
            _told("cohort_adults", {"under_age": 'count(*) FILTER (coalesce("Age" < 18, true))'}, "cohort"), _told("cohort_label_domain", {"outside": "count(*) FILTER (label NOT IN (0, 1))"}, "cohort"), _told("cohort_stay_keys", {"duplicates": "count(stay_id) - count(DISTINCT stay_id)", "missing": "count(*) - count(stay_id)"}, "cohort"),
            _told("cohort_mortality_rule", {"mismatches": "count(*) FILTER (label IS DISTINCT FROM coalesce((dod BETWEEN intime AND outtime)::INT, 0))"}, "cohort"), _told("labels_keys_and_domain", {"outside_cohort": "count(DISTINCT CASE WHEN NOT here THEN stay_id END)", "outside_domain": "count(*) FILTER (label NOT IN (0, 1))"}, "j"),
            _told("labels_observation_window", {"short_stays": "(SELECT count(*) FROM short)", "duplicate_label_rows": "count(*) - count(DISTINCT stay_id)"}, "j", "(SELECT coalesce(string_agg(stay_id::VARCHAR, ',' ORDER BY stay_id), '') FROM few)"),
            _told("feature_stays_in_cohort", {"outside": "count(*)"}, "(SELECT DISTINCT stay_id FROM stays WHERE stay_id NOT IN (SELECT stay_id FROM cohort))", "CASE WHEN outside > 0 THEN 'chart' ELSE '' END"),
            _told("stay_csv_completeness", {"missing": "(SELECT count(*) FROM labels_ WHERE stay_id NOT IN (SELECT stay_id FROM demo))", "extra": "(SELECT count(*) FROM demo WHERE stay_id NOT IN (SELECT stay_id FROM labels_))"}, "(SELECT 1)"),
            _told("no_model_artifacts", {"files": "count(*) FILTER (regexp_matches(path, '(?i)\\.(pt|pth|onnx)$'))"}, "files"), _inventory_sql(),
        ))
    ),
)
def validation_report(spark, d):
    s, c = W.stays(spark, d), cohort(spark, d)
    labels = s.select("stay_id", (F.col("stay_id") % 3).cast("int").alias("label"))
    return E.validation_report(c, labels, {"chart": s.select("stay_id")}, (["hadm_id", "icd_code"], ["stay_id", "new_icd_code", "root_icd_code"]), {"demo": E.stay_demo(c), "static": s.select("stay_id")}, listed(spark, d), INVENTORY, ("same", "same"))


def _absent(name: str, *what: str) -> str:
    return f"""SELECT '{name}' AS name, false AS passed, '{{"absent":{len(what)}}}' AS observed, 'absent: {",".join(what)}' AS details"""


@query(
    "validation_report_absent",
    W.sql(
        CONTRACT + ", labels_ AS (SELECT stay_id, (stay_id % 3)::INT AS label FROM stays), " + LISTED
        + ", r AS (" + " UNION ALL ".join((
            _told("cohort_schema", {"differs": "(count(*) > 0)::INT"}, "cohort", "'subject_id,stay_id,intime,gender,ethnicity,insurance,label,hadm_id'"), _told("labels_schema", {"differs": "(count(*) = 0)::INT"}, "labels_"), _told("diagnosis_schema", {"differs": "(count(*) > 0)::INT"}, "diagnoses", "'hadm_id,icd_code'"),
            _told("original_data_untouched", {"differs": "(count(*) > 0)::INT"}, "cohort"), _absent("cohort_adults", "cohort.Age"), _told("cohort_label_domain", {"outside": "count(*) FILTER (label NOT IN (0, 1))"}, "cohort"),
            _told("cohort_stay_keys", {"duplicates": "count(stay_id) - count(DISTINCT stay_id)", "missing": "count(*) - count(stay_id)"}, "cohort"), _absent("cohort_mortality_rule", "cohort.dod", "cohort.outtime"),
            _absent("labels_keys_and_domain", "cohort.outtime"), _absent("labels_observation_window", "cohort.outtime"), _absent("feature_stays_in_cohort", "cohort.outtime", "chart", "med.stay_id"),
            _absent("stay_csv_completeness", "static"), _told("no_model_artifacts", {"files": "count(*) FILTER (regexp_matches(path, '(?i)\\.(pt|pth|onnx)$'))"}, "files"), _inventory_sql(),
        )) + ") SELECT *, regexp_replace(observed, ':-?[0-9]+', ':0', 'g') AS expected FROM r"
    ),
)
def validation_report_absent(spark, d):
    s, c = W.stays(spark, d), cohort(spark, d).drop("Age", "dod", "outtime")
    labels = s.select("stay_id", (F.col("stay_id") % 3).cast("int").alias("label"))
    report = E.validation_report(c, labels, {"chart": None, "med": W.prescriptions(spark, d)}, (["hadm_id", "icd_code"], ["stay_id", "new_icd_code", "root_icd_code"]), {"demo": c, "static": None}, listed(spark, d), INVENTORY, ("before", "after"))
    return E.with_expected(report)
