"""Injection, repair, evaluation and search queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import inject as I
from tablewright.operators import repair as R
from tablewright.operators import search as X
from tablewright.operators.windows import in_windows
from tablewright.plans.registry import query
from tablewright.sources.lineage import shelved
from tablewright.sources.warehouse import patients, stays, table

# ---------------------------------------------------------------- raw tables of texts with row numbers

RAW = """l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS part, min(l_quantity)::INT AS qty, min(l_shipdate) AS ship FROM lineitem GROUP BY 1, 2),
st AS (SELECT o_orderkey AS hadm, o_custkey AS subject, o_orderkey * 10 + 3 AS stay, o_orderdate AS intime, max(l_shipdate) AS outtime FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
first_stay AS (SELECT subject, min(stay) AS stay FROM st GROUP BY 1), hadms AS (SELECT DISTINCT hadm FROM st ORDER BY hadm LIMIT 2),
ctx AS (SELECT stay::VARCHAR AS _stay, hadm, strftime(intime - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS before_in, strftime(outtime + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS after_out,
  CASE WHEN hadm = (SELECT min(hadm) FROM hadms) THEN (SELECT max(hadm) FROM hadms) ELSE (SELECT min(hadm) FROM hadms) END::VARCHAR AS other FROM st),
ts AS (SELECT *, strftime(ship, '%Y-%m-%d %H:%M:%S') AS t FROM l),
patients AS (SELECT c_custkey AS _row_index, f.stay::VARCHAR AS _stay, c_mktsegment AS gender, (10 + c_custkey % 70)::VARCHAR AS anchor_age, CASE WHEN c_custkey % 3 = 0 THEN strftime(timestamp '1995-06-01 00:00:00' + to_days((c_custkey * 7 % 2300)::INT), '%Y-%m-%d') END AS dod FROM customer JOIN first_stay f ON f.subject = c_custkey),
admissions AS (SELECT o_orderkey AS _row_index, st.stay::VARCHAR AS _stay, o_orderpriority AS insurance FROM orders JOIN st ON hadm = o_orderkey),
icustays AS (SELECT hadm AS _row_index, stay::VARCHAR AS _stay, strftime(outtime, '%Y-%m-%d %H:%M:%S') AS outtime FROM st),
chartevents AS (SELECT o * 8 + n AS _row_index, (o * 10 + 3)::VARCHAR AS _stay, (o * 10 + 3)::VARCHAR AS stay_id, (part % 40 + 200)::VARCHAR AS itemid, qty::VARCHAR AS valuenum, t AS charttime FROM ts),
inputevents AS (SELECT o * 8 + n AS _row_index, (o * 10 + 3)::VARCHAR AS _stay, o::VARCHAR AS hadm_id, (part % 30 + 500)::VARCHAR AS itemid, qty::VARCHAR AS amount, t AS starttime, strftime(ship + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS endtime FROM ts WHERE n <= 4),
outputevents AS (SELECT o * 8 + n AS _row_index, (o * 10 + 3)::VARCHAR AS _stay, t AS charttime FROM ts WHERE n >= 2),
diagnoses_icd AS (SELECT o * 8 + n AS _row_index, (o * 10 + 3)::VARCHAR AS _stay, 'B' || (part % 97) AS icd_code FROM ts)"""
STEP = 23
SUBTYPES = list(I.SUBTYPES)


def line_rows(spark, d) -> DataFrame:
    """One row an order and line, its time as text too: four raw tables are made of it."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("part"), F.min("l_quantity").cast("int").alias("qty"), F.min("l_shipdate").alias("ship"))
    return li.withColumn("t", F.date_format("ship", I.TIME))


def raw(spark, d, li=None, own=None) -> dict[str, DataFrame]:
    """The raw tables; li and own are line_rows() and stays() where these are shelved."""
    text = lambda c: F.date_format(c, I.TIME)
    li, own = li or line_rows(spark, d), own or stays(spark, d)
    stay = (F.col("o") * 10 + 3).cast("string").alias("stay_id")
    row, item = (F.col("o") * 8 + F.col("n")).alias("_row_index"), lambda m, base: (F.col("part") % m + base).cast("string").alias("itemid")
    value = F.col("qty").cast("string")
    o = table(spark, d, "orders")
    return {
        "patients": patients(spark, d).select(F.col("subject_id").alias("_row_index"), F.col("subject_id").cast("string").alias("subject_id"), "gender", F.col("anchor_age").cast("string").alias("anchor_age"), F.date_format("dod", "yyyy-MM-dd").alias("dod")),
        "admissions": o.select(F.col("o_orderkey").alias("_row_index"), F.col("o_orderkey").cast("string").alias("hadm_id"), F.col("o_orderpriority").alias("insurance")),
        "icustays": own.select(F.col("hadm_id").alias("_row_index"), F.col("stay_id").cast("string").alias("stay_id"), text("intime").alias("intime"), text("outtime").alias("outtime")),
        "chartevents": li.select(row, stay, item(40, 200), value.alias("valuenum"), F.col("t").alias("charttime")),
        "inputevents": li.where("n <= 4").select(row, stay, F.col("o").cast("string").alias("hadm_id"), item(30, 500), value.alias("amount"), F.col("t").alias("starttime"), text(F.expr("ship + interval 2 hours")).alias("endtime")),
        "outputevents": li.where("n >= 2").select(row, stay, F.col("t").alias("charttime")),
        "diagnoses_icd": li.select(row, F.col("o").cast("string").alias("hadm_id"), F.concat(F.lit("B"), (F.col("part") % 97).cast("string")).alias("icd_code")),
    }


def requests(spark, d, own=None) -> DataFrame:
    """One request for a share of the stays, two for some: the second sees what the first left."""
    s = F.col("hadm_id") % STEP
    kinds = F.when(s == 6, F.array(F.lit(6), F.lit(7))).when(s < len(SUBTYPES), F.array(s.cast("int"))).otherwise(F.array().cast("array<int>"))
    r = (own or stays(spark, d)).select("hadm_id", F.col("stay_id").alias("canonical_stay_id"), F.explode(kinds).alias("k"))
    name = F.get(F.array(*map(F.lit, SUBTYPES)), F.col("k"))
    return r.select((F.col("hadm_id") * 100 + F.col("k")).alias("source_error_id"), "canonical_stay_id", F.concat(F.lit("class_"), (F.col("k") % 4).cast("string")).alias("error_class"), name.alias("error_subtype"))


def wanted_sql(k: int) -> str:
    """Requests of one subtype."""
    more = f" OR stay_hadm % {STEP} = 6" if k == 7 else ""
    return f"(SELECT stay::VARCHAR AS _stay, hadm AS stay_hadm FROM st) w WHERE (stay_hadm % {STEP} = {k}{more})"


CHANGES = {
    "schema_range_violation": ("anchor_age", "'999'"), "enum_violation": ("gender", "'UNKNOWN_GENDER_CODE'"), "unexpected_missingness": ("insurance", "''"), "temporal_order_violation": ("outtime", "before_in"),
    "med_end_before_start": ("endtime", "starttime"), "sentinel_or_negative_med_amount": ("amount", "'-999'"), "sentinel_chart_value": ("valuenum", "'-999'"),
    "unit_scale_error": (f"CASE WHEN hadm % {STEP} = 6 THEN '-999' ELSE valuenum END", f"((CASE WHEN hadm % {STEP} = 6 THEN '-999' ELSE valuenum END)::DOUBLE * 100)::VARCHAR"), "duplicate_row": ("NULL", "NULL"),
    "implausible_negative_event_time": ("charttime", "before_in"), "chart_itemid_alias_split": ("itemid", "'990045'"), "medication_itemid_alias_split": ("itemid", "'995158'"), "diagnosis_code_alias_split": ("icd_code", "'ALIAS_' || icd_code"),
    "orphan_feature_stay_id": ("stay_id", "'9' || stay_id"), "stay_hadm_mismatch": ("hadm_id", "other"), "label_conflict_with_cohort": ("dod", "'2100-01-01'"), "future_window_leakage": ("charttime", "after_out"), "label_leakage_feature": ("NULL", "NULL"),
}


def log_sql(subtype: str) -> str:
    k = SUBTYPES.index(subtype)
    name, column, kind = I.SUBTYPES[subtype]
    clean, dirty = CHANGES[subtype]
    return f"""SELECT hadm * 100 + {k} AS source_error_id, _stay, _row_index, '{subtype}' AS error_subtype, '{kind}' AS operation, '{column}' AS "column", ({clean})::VARCHAR AS clean_value, ({dirty})::VARCHAR AS dirty_value, '{name}' AS raw_file, 'class_{k % 4}' AS error_class
  FROM {name} JOIN ctx USING (_stay) WHERE _row_index IN (SELECT min(_row_index) FROM {name} GROUP BY _stay) AND _stay IN (SELECT _stay FROM {wanted_sql(k)})"""


COLUMNS = ["source_error_id", "_stay", "_row_index", "error_subtype", "operation", "column", "clean_value", "dirty_value", "raw_file", "error_class"]


OF_LINES = {"chartevents", "inputevents", "outputevents", "diagnoses_icd"}


def logged(spark, d, tables=None, own=None) -> DataFrame:
    """Logs of all tables, or of some; stays (own, where shelved already) and rows that several of them read are made once."""
    own = own or shelved(stays(spark, d), "stays")
    li = shelved(line_rows(spark, d), "lines") if len(OF_LINES & set(tables or OF_LINES)) > 1 else None
    all_, wanted = raw(spark, d, li, own), requests(spark, d, own)
    logs = [I.inject(n, all_[n], own, wanted)[1].select(*COLUMNS) for n in tables or sorted(all_)]
    return reduce(DataFrame.unionByName, logs)


def _register(subtype: str) -> None:
    name = I.SUBTYPES[subtype][0]

    @query(f"inject_{subtype}", f"WITH {RAW} {log_sql(subtype)}")
    def one(spark, d):
        return logged(spark, d, [name]).where(F.col("error_subtype") == subtype)


for _subtype in SUBTYPES:
    _register(_subtype)

ALL_LOGS = " UNION ALL ".join(map(log_sql, SUBTYPES))


@query("inject_log", f"WITH {RAW} {ALL_LOGS}")
def inject_log(spark, d):
    return logged(spark, d)


@query("inject_summary", f"WITH {RAW} SELECT error_class, error_subtype, count(*) AS errors FROM ({ALL_LOGS}) GROUP BY ALL")
def inject_summary(spark, d):
    return I.summary(logged(spark, d), "error_class", "error_subtype")


@query("inject_rollup", f"""WITH {RAW}, logged_ AS (SELECT *, CASE WHEN source_error_id % 5 = 0 THEN 'train' ELSE 'test' END AS split FROM ({ALL_LOGS}))
  SELECT split, error_class, error_subtype, 3 - grouping(split) - grouping(error_class) - grouping(error_subtype) AS level, count(*) AS errors FROM logged_ GROUP BY ROLLUP (split, error_class, error_subtype)""")
def inject_rollup(spark, d):
    log = logged(spark, d).withColumn("split", F.when(F.col("source_error_id") % 5 == 0, "train").otherwise("test"))
    return I.rollup(log, "split", "error_class", "error_subtype")


@query("inject_target_rows", f"WITH {RAW} SELECT _stay, min(_row_index) AS _row_index, (SELECT CASE WHEN hadm % {STEP} = 6 THEN 2 ELSE 1 END FROM ctx x WHERE x._stay = c._stay) AS n_requests FROM chartevents c WHERE _stay IN (SELECT _stay FROM ctx WHERE hadm % {STEP} IN (6, 7, 8, 10, 13, 16, 17)) GROUP BY 1")
def inject_target_rows(spark, d):
    own = [s for s, (t, _, _) in I.SUBTYPES.items() if t == "chartevents"]
    hit = I.targets(raw(spark, d)["chartevents"], stays(spark, d), requests(spark, d).where(F.col("error_subtype").isin(own)))
    return hit.select("_stay", "_row_index", F.size("requests").alias("n_requests"))


@query("inject_dirty_table", f"""WITH {RAW}, f AS (SELECT min(_row_index) AS _row_index FROM chartevents GROUP BY _stay), x AS (SELECT c.*, hadm % {STEP} AS k, after_out, c._row_index IN (SELECT _row_index FROM f) AS hit FROM chartevents c JOIN ctx USING (_stay)),
  u AS (SELECT _row_index, CASE WHEN hit AND k = 13 THEN '9' || stay_id ELSE stay_id END AS stay_id, CASE WHEN hit AND k = 10 THEN '990045' ELSE itemid END AS itemid,
  CASE WHEN hit AND k = 6 THEN '-99900.0' WHEN hit AND k = 7 THEN (valuenum::DOUBLE * 100)::VARCHAR ELSE valuenum END AS valuenum, CASE WHEN hit AND k = 16 THEN after_out ELSE charttime END AS charttime FROM x)
  SELECT * FROM u UNION ALL SELECT _row_index, stay_id, itemid, valuenum, charttime FROM x WHERE hit AND k = 8 UNION ALL SELECT _row_index, stay_id, '999001', '0', charttime FROM x WHERE hit AND k = 17""")
def inject_dirty_table(spark, d):
    return I.inject("chartevents", raw(spark, d)["chartevents"], stays(spark, d), requests(spark, d))[0]


@query("benchmark_checks", f"WITH {RAW} SELECT 'unresolved_requests' AS name, (SELECT count(*) FROM st WHERE hadm % {STEP} < 18) + (SELECT count(*) FROM st WHERE hadm % {STEP} = 6) - (SELECT count(*) FROM ({ALL_LOGS})) AS observed UNION ALL SELECT 'logged_requests', count(*) FROM ({ALL_LOGS})")
def benchmark_checks(spark, d):
    own = shelved(stays(spark, d), "stays")
    log = shelved(logged(spark, d, own=own).select("source_error_id"), "log")
    left = I.unresolved(requests(spark, d, own), log).agg(F.count("*").alias("observed")).select(F.lit("unresolved_requests").alias("name"), "observed")
    return left.unionByName(log.agg(F.count("*").alias("observed")).select(F.lit("logged_requests").alias("name"), "observed"))


# ---------------------------------------------------------------- repairs and their evaluation

NAME = "csv/part"


def packages(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    m = F.col("p_partkey") % 11
    changed = p.select("p_partkey", F.when(m == 1, "").otherwise(F.col("p_name")).alias("p_name"), F.when(m == 0, 999).otherwise(F.col("p_size")).alias("p_size"))
    dirty = changed.unionAll(p.where(m == 2).select(F.col("p_partkey") + 1000000, "p_name", "p_size"))
    k = F.col("p_partkey") % 22
    fixed = p.where("p_partkey % 101 <> 50").select("p_partkey", F.when(k == 1, "zzz").when(k == 12, "").otherwise(F.col("p_name")).alias("p_name"), F.when(k == 11, 999).otherwise(F.col("p_size")).alias("p_size"))
    result = fixed.unionAll(p.where(k == 2).select(F.col("p_partkey") + 1000000, "p_name", "p_size")).unionAll(p.where("p_partkey % 103 = 1").select(F.col("p_partkey") + 9000000, "p_name", "p_size"))
    return p, dirty, result


def log_of(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    h = lambda key, name, size: F.sha2(F.to_json(F.struct(name.alias("p_name"), key.cast("string").alias("p_partkey"), size.cast("string").alias("p_size"))), 256)
    key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    row = lambda k, sub, clean, dirty: p.where(key % 11 == k).select(F.lit(NAME).alias("path"), key.alias("error"), F.concat(F.lit("c"), (key % 2).cast("string")).alias("error_class"), F.lit(sub).alias("error_subtype"), clean.alias("clean_hash"), dirty.alias("dirty_hash"))
    rows = [row(0, "size", h(key, name, size), h(key, name, F.lit(999))), row(1, "name", h(key, name, size), h(key, F.lit(""), size)), row(2, "insert", F.lit(None).cast("string"), h(key + 1000000, name, size))]
    return reduce(DataFrame.unionByName, rows)


def hash_sql(key="k", name="n", size="s") -> str:
    return f"""sha256('{{"p_name":"' || {name} || '","p_partkey":"' || {key} || '","p_size":"' || {size} || '"}}')"""


EVAL = f"""p AS (SELECT p_partkey AS k, p_name AS n, p_size AS s FROM part),
  dirty AS (SELECT k, CASE WHEN k % 11 = 1 THEN '' ELSE n END AS n, CASE WHEN k % 11 = 0 THEN 999 ELSE s END AS s FROM p UNION ALL SELECT k + 1000000, n, s FROM p WHERE k % 11 = 2),
  result AS (SELECT k, CASE WHEN k % 22 = 1 THEN 'zzz' WHEN k % 22 = 12 THEN '' ELSE n END AS n, CASE WHEN k % 22 = 11 THEN 999 ELSE s END AS s FROM p WHERE k % 101 <> 50 UNION ALL SELECT k + 1000000, n, s FROM p WHERE k % 22 = 2 UNION ALL SELECT k + 9000000, n, s FROM p WHERE k % 103 = 1),
  m AS (SELECT h, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d, sum(r)::BIGINT AS r FROM (SELECT {hash_sql()} AS h, 1 AS c, 0 AS d, 0 AS r FROM p UNION ALL SELECT {hash_sql()}, 0, 1, 0 FROM dirty UNION ALL SELECT {hash_sql()}, 0, 0, 1 FROM result) GROUP BY 1),
  lg AS (SELECT '{NAME}' AS path, k AS error, 'c' || (k % 2) AS error_class, CASE k % 11 WHEN 0 THEN 'size' WHEN 1 THEN 'name' ELSE 'insert' END AS error_subtype, CASE WHEN k % 11 < 2 THEN {hash_sql()} END AS clean_hash,
  CASE k % 11 WHEN 0 THEN {hash_sql(size='999')} WHEN 1 THEN {hash_sql(name="''")} ELSE {hash_sql(key='(k + 1000000)')} END AS dirty_hash FROM p WHERE k % 11 < 3),
  st AS (SELECT lg.*, CASE WHEN coalesce(y.r, 0) = coalesce(y.c, 0) AND (clean_hash IS NULL OR coalesce(x.r, 0) = coalesce(x.c, 0)) THEN 'exact' WHEN coalesce(y.r, 0) = coalesce(y.d, 0) AND (clean_hash IS NULL OR coalesce(x.r, 0) = coalesce(x.d, 0)) THEN 'missed' ELSE 'incorrect' END AS status
  FROM lg LEFT JOIN m x ON x.h = clean_hash LEFT JOIN m y ON y.h = dirty_hash)"""
METRICS = """count(*) AS errors, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'missed') AS missed, count(*) FILTER (status = 'incorrect') AS incorrect, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (status = 'exact') / greatest(count(*), 1), 6) END AS recall,
  CASE WHEN count(*) FILTER (clean_hash IS NULL) = 0 THEN 1.0 ELSE round(count(*) FILTER (status = 'exact' AND clean_hash IS NULL) / greatest(count(*) FILTER (clean_hash IS NULL), 1), 6) END AS inserted_deletion_rate"""
KEPT = """k AS (SELECT coalesce(sum(c) FILTER (f), 0)::BIGINT AS unaffected, coalesce(sum(least(c, r)) FILTER (f), 0)::BIGINT AS kept, coalesce(sum(greatest(c - r, 0)) FILTER (f), 0)::BIGINT AS lost, sum(greatest(r - greatest(c, d), 0))::BIGINT AS invented
  FROM (SELECT *, h NOT IN (SELECT clean_hash FROM lg WHERE clean_hash IS NOT NULL) AS f FROM m)), kept_ AS (SELECT *, lost + invented AS collateral, CASE WHEN unaffected = 0 THEN 1.0 ELSE round(kept / greatest(unaffected, 1), 6) END AS preservation_rate FROM k)"""


def counted(spark, d):
    clean, dirty, result = packages(spark, d)
    return R.multiset({NAME: clean}, {NAME: dirty}, {NAME: result})


def statuses(spark, d):
    return R.status(log_of(spark, d), counted(spark, d))


@query("row_hash", f"SELECT k AS p_partkey, {hash_sql()} AS hash FROM (SELECT p_partkey AS k, p_name AS n, p_size AS s FROM part)")
def row_hash(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", R.row_hash(["p_partkey", "p_name", "p_size"]).alias("hash"))


@query("row_multiset_counts", f"WITH {EVAL} SELECT '{NAME}' AS path, h AS hash, c AS clean, d AS dirty, r AS result FROM m")
def row_multiset_counts(spark, d):
    return counted(spark, d)


@query("repair_status", f"WITH {EVAL} SELECT * FROM st")
def repair_status(spark, d):
    return statuses(spark, d)


@query("repair_metrics", f"WITH {EVAL} SELECT {METRICS} FROM st")
def repair_metrics(spark, d):
    return R.metrics(statuses(spark, d))


@query("repair_by_group", f"WITH {EVAL} SELECT error_class, error_subtype, {METRICS} FROM st GROUP BY GROUPING SETS ((error_class), (error_subtype))")
def repair_by_group(spark, d):
    s = statuses(spark, d)
    a, b = R.metrics(s, "error_class").withColumn("error_subtype", F.lit(None).cast("string")), R.metrics(s, "error_subtype").withColumn("error_class", F.lit(None).cast("string"))
    return a.unionByName(b)


@query("repair_preservation", f"WITH {EVAL}, {KEPT} SELECT * FROM kept_")
def repair_preservation(spark, d):
    return R.preservation(counted(spark, d), log_of(spark, d))


@query("repair_f1", f"""WITH {EVAL}, {KEPT}, a AS (SELECT {METRICS} FROM st), q AS (SELECT errors, exact, incorrect, recall, collateral, round(exact / greatest(exact + incorrect + collateral, 1), 6) AS precision FROM a, kept_)
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM q""")
def repair_f1(spark, d):
    rows, log = counted(spark, d), log_of(spark, d)
    return R.quality(R.status(log, rows), R.preservation(rows, log))


ALIAS = "CASE WHEN o_orderstatus = 'F' THEN 'FILLED' WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'OPENED' ELSE o_orderstatus END"
MAPPING = f"""pr AS (SELECT {ALIAS} AS d, o_orderstatus AS c FROM orders), w AS (SELECT d, c, count(*) AS n FROM pr GROUP BY ALL),
  one AS (SELECT d, max(c) AS c, max(n) AS n FROM w GROUP BY 1 HAVING count(*) = 1), map_ AS (SELECT * FROM one WHERE d <> c AND n >= 3)"""


def aliased(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(ALIAS).alias("o_orderstatus"))


def mapping(spark, d):
    return R.learn_values(aliased(spark, d), table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"])


@query("learn_value_map", f"""WITH {MAPPING} SELECT 'o_orderstatus' AS "column", d AS dirty, c AS clean, n FROM map_""")
def learn_value_map(spark, d):
    return mapping(spark, d)


@query("apply_value_map", f"WITH {MAPPING}, x AS (SELECT o_orderkey, {ALIAS} AS s FROM orders) SELECT o_orderkey, coalesce(c, s) AS o_orderstatus FROM x LEFT JOIN map_ ON d = s")
def apply_value_map(spark, d):
    return R.apply_values(aliased(spark, d), mapping(spark, d), "o_orderstatus")


@query("apply_value_map_check", f"""WITH {MAPPING}, x AS (SELECT o_custkey AS k, {ALIAS} AS s FROM orders), y AS (SELECT k, coalesce(c, s) AS s FROM x LEFT JOIN map_ ON d = s)
  SELECT (SELECT count(*) FROM x) AS n_rows, (SELECT count(*) FROM x JOIN map_ ON d = s) AS changed, (SELECT count(*) - count(DISTINCT (k, s)) FROM x) AS duplicates_before, (SELECT count(*) - count(DISTINCT (k, s)) FROM y) AS duplicates_after""")
def apply_value_map_check(spark, d):
    return R.mapping_check(table(spark, d, "orders").select("o_custkey", F.expr(ALIAS).alias("o_orderstatus")), mapping(spark, d), "o_orderstatus")


@query("repair_nullify", "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 400000 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS o_orderstatus FROM orders")
def repair_nullify(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return R.nullify(rows, {"o_totalprice": ~F.col("o_totalprice").between(1000, 400000), "o_orderstatus": ~F.col("o_orderstatus").isin("F", "O")})


@query("repair_exact_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def repair_exact_duplicates(spark, d):
    return R.exact_duplicates(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


ORPHANS = "x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 900000000 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') ELSE 'nobody' END AS name FROM orders)"


def orphans(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.expr("case when o_orderkey % 9 = 0 then o_custkey + 900000000 else o_custkey end").alias("o_custkey"),
        F.expr("case when o_orderkey % 2 = 0 then 'Customer#' || lpad(cast(o_custkey as string), 9, '0') else 'nobody' end").alias("name"),
    )


@query("repair_foreign_key", f"WITH {ORPHANS} SELECT o_orderkey, CASE WHEN x.o_custkey NOT IN (SELECT c_custkey FROM customer) AND c.c_custkey IS NOT NULL THEN c.c_custkey ELSE x.o_custkey END AS o_custkey, name FROM x LEFT JOIN customer c ON c_name = name")
def repair_foreign_key(spark, d):
    return R.restore_parent(orphans(spark, d), "o_custkey", "name", table(spark, d, "customer"), "c_custkey", "c_name")


@query("repair_orphans", f"WITH {ORPHANS} SELECT * FROM x WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def repair_orphans(spark, d):
    return R.drop_orphans(orphans(spark, d), "o_custkey", table(spark, d, "customer"), "c_custkey")


@query("join_cardinality", f"WITH {ORPHANS}, a AS (SELECT o_custkey AS k, count(*) AS n FROM x GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS m FROM customer GROUP BY 1) SELECT coalesce(n, 0) AS children, coalesce(m, 0) AS parents, count(*) AS keys FROM a FULL JOIN b USING (k) GROUP BY ALL")
def join_cardinality(spark, d):
    return R.join_cardinality(orphans(spark, d), "o_custkey", table(spark, d, "customer"), "c_custkey")


@query("repair_window", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 1000 DAY")
def repair_window(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", F.expr("o_orderdate + interval 1000 days").alias("until"))
    return R.inside_window(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), o, "l_orderkey", "l_shipdate", "o_orderdate", "until")


@query(
    "window_join",
    """SELECT e.l_orderkey AS event_order, e.l_linenumber AS event_line, w.o_orderkey AS window_order FROM (SELECT *, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) e
  JOIN orders w ON w.o_custkey = e.o_custkey AND e.l_shipdate BETWEEN w.o_orderdate AND w.o_orderdate + INTERVAL 60 DAY""",
)
def window_join(spark, d):
    """Line items inside the sixty days after any order of their customer: windows of one key overlap."""
    o = table(spark, d, "orders")
    e = table(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", "l_orderkey", "l_linenumber", "l_shipdate")
    w = o.select("o_custkey", "o_orderkey", "o_orderdate", F.expr("o_orderdate + interval 60 days").alias("until"))
    found = in_windows(e, w, ["o_custkey"], "l_shipdate", "o_orderdate", "until", 60 * 86400)
    return found.select(F.col("l_orderkey").alias("event_order"), F.col("l_linenumber").alias("event_line"), F.col("o_orderkey").alias("window_order"))


@query(
    "leakage_probe",
    """WITH e AS (SELECT o_orderkey, o_custkey % 2 AS label, l_partkey % 40 AS item, CASE WHEN l_partkey % 40 = 7 THEN (o_custkey % 2) * 10 ELSE l_quantity::INT END AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  p AS (SELECT item, label, count(DISTINCT value) AS ways, max(value) AS v, count(*) AS n FROM e GROUP BY ALL) SELECT item, sum(n)::BIGINT AS n, count(*) AS labels FROM p GROUP BY 1 HAVING max(ways) = 1 AND count(*) > 1 AND count(DISTINCT v) = count(*) AND sum(n) >= 20""",
)
def leakage_probe(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 2).alias("label"))
    li = table(spark, d, "lineitem").join(o.withColumnRenamed("label", "y"), "l_orderkey")
    events = li.select("l_orderkey", (F.col("l_partkey") % 40).alias("item"), F.when(F.col("l_partkey") % 40 == 7, F.col("y") * 10).otherwise(F.col("l_quantity").cast("int")).alias("value"))
    return R.leakage_probe(events, o, "l_orderkey", "item", "value")


# ---------------------------------------------------------------- text search

PATTERN = "(the|und) +[a-z]{2,4}[ .,]"


@query("text_search_counts", f"SELECT doc_id, len(regexp_extract_all(text, '(?i){PATTERN}'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '(?i){PATTERN}')")
def text_search_counts(spark, d):
    return X.match_counts(table(spark, d, "documents"), "doc_id", "text", PATTERN, True)


@query("text_search_lines", "SELECT doc_id, i::INT AS line, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(content, '[0-9]{3}-[0-9]{4}')")
def text_search_lines(spark, d):
    return X.match_lines(table(spark, d, "documents"), "doc_id", "text", "[0-9]{3}-[0-9]{4}")
