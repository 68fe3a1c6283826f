"""Gate and split queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import gates as G
from tablewright.operators import splits as S
from tablewright.plans.registry import query
from tablewright.sources import warehouse as W
from tablewright.sources.warehouse import table


def package(spark, d):
    o = table(spark, d, "orders")
    return {
        "cohort/orders": o.select(F.col("o_orderkey").alias("stay_id"), "o_orderstatus", "o_orderpriority"),
        "csv/labels": o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("stay_id"), (F.col("o_custkey") % 2).alias("label")),
        "features/lines": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stay_id"), F.col("l_linenumber").alias("itemid"), "l_quantity"),
        "summary/flags": table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("total_count")),
    }


PACKAGE_KEYS = {"cohort/orders": ["stay_id"], "csv/labels": ["stay_id"], "features/lines": ["stay_id", "itemid"], "summary/flags": ["l_returnflag"]}


def broken(spark, d):
    p = package(spark, d)
    o = p["cohort/orders"].where("stay_id % 19 <> 0")
    again = o.where("stay_id % 23 = 0")
    odd = o.where("stay_id % 29 = 0").withColumn("stay_id", F.col("stay_id") + 5000000000)
    return {
        "cohort/orders": o.unionAll(again).unionAll(odd),
        "csv/labels": p["csv/labels"].select("label", "stay_id"),
        "features/lines": p["features/lines"].select("stay_id", "itemid", F.lit(" TODO").alias("l_quantity")),
        "other/extra": p["summary/flags"],
    }


KEYS = "k AS (SELECT DISTINCT o_orderkey AS k FROM orders)"
COHORT = """c0 AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 19 <> 0), c AS (SELECT k FROM c0 UNION ALL SELECT k FROM c0 WHERE k % 23 = 0 UNION ALL SELECT k + 5000000000 FROM c0 WHERE k % 29 = 0)"""
COHORT_ISSUES = """SELECT 'cohort/orders' AS path, 'unknown_keys' AS issue, count(DISTINCT k) AS count FROM c WHERE k NOT IN (SELECT k FROM k) UNION ALL SELECT 'cohort/orders', 'uncovered_keys', count(*) FROM k WHERE k NOT IN (SELECT k FROM c)
  UNION ALL SELECT 'cohort/orders', 'duplicate_keys', count(*) - count(DISTINCT k) FROM c"""
FILE_ISSUES = "SELECT 'summary/flags', 'missing_file', 1 UNION ALL SELECT 'other/extra', 'unexpected_file', 1 UNION ALL SELECT 'csv/labels', 'schema_differs', 1"
LINES_DUP = "SELECT 'features/lines', 'duplicate_business_keys', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem"


@query("gate_business_package", f"WITH {KEYS}, {COHORT} SELECT * FROM ({COHORT_ISSUES} UNION ALL {FILE_ISSUES} UNION ALL {LINES_DUP} UNION ALL SELECT 'cohort/orders', 'duplicate_business_keys', count(*) - count(DISTINCT k) FROM c UNION ALL SELECT 'csv/labels', 'uncovered_keys', count(*) FROM k WHERE k % 2 = 1 UNION ALL SELECT 'features/lines', 'placeholder_only', 1) WHERE count > 0")
def gate_business_package(spark, d):
    keys = table(spark, d, "orders").select("o_orderkey")
    return G.business_gate(package(spark, d), broken(spark, d), PACKAGE_KEYS, keys, "stay_id")


@query("gate_test_package", f"WITH {KEYS}, {COHORT} SELECT * FROM ({COHORT_ISSUES} UNION ALL {FILE_ISSUES} UNION ALL {LINES_DUP} UNION ALL SELECT 'cohort/orders', 'duplicate_business_keys', count(*) - count(DISTINCT k) FROM c UNION ALL SELECT 'features/lines', 'placeholder_only', 1) WHERE count > 0")
def gate_test_package(spark, d):
    keys = table(spark, d, "orders").select("o_orderkey")
    return G.business_gate(package(spark, d), broken(spark, d), PACKAGE_KEYS, keys, "stay_id", labels_cover=False)


@query("gate_correction_package", f"WITH {KEYS}, {COHORT} SELECT * FROM ({COHORT_ISSUES} UNION ALL {FILE_ISSUES}) WHERE count > 0")
def gate_correction_package(spark, d):
    return G.correction_gate(package(spark, d), broken(spark, d), table(spark, d, "orders").select("o_orderkey"), "stay_id")


@query("gate_placeholder", "SELECT count(*) AS n_rows, max((lower(trim(coalesce(l_returnflag, ''))) NOT IN ('', 'placeholder', 'todo', 'unknown', 'n/a', 'not available'))::INT) = 0 AS placeholder_only FROM lineitem")
def gate_placeholder(spark, d):
    return G.placeholder_only(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey"])


@query("gate_duplicate_keys", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def gate_duplicate_keys(spark, d):
    return G.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("gate_self_check", f"""WITH {COHORT}, n AS (SELECT count(*) AS n FROM orders) SELECT * FROM (SELECT 'summary/flags' AS path, 'declared_but_missing' AS issue, 1 AS count UNION ALL SELECT 'cohort/orders', 'row_count_differs', (count(*) <> 7)::BIGINT FROM c
  UNION ALL SELECT 'cohort/orders', 'duplicate_keys', count(*) - count(DISTINCT k) FROM c UNION ALL SELECT 'csv/labels', 'low_coverage', (count(*) < 0.5 * (SELECT count(*) FROM lineitem))::BIGINT FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 'cohort/orders', 'low_coverage', (count(DISTINCT k) < 0.5 * (SELECT count(*) FROM lineitem))::BIGINT FROM c UNION ALL SELECT 'features/lines', 'low_coverage', (count(DISTINCT l_orderkey) < 0.5 * (SELECT count(*) FROM lineitem))::BIGINT FROM lineitem) WHERE count > 0""")
def gate_self_check(spark, d):
    b = broken(spark, d)
    n = table(spark, d, "lineitem").count()
    return G.self_check({k: b[k] for k in ("cohort/orders", "csv/labels", "features/lines")}, {"cohort/orders": 7, "summary/flags": 3}, "stay_id", n)


def prints(spark, d, changed=False):
    p = table(spark, d, "part").select(F.concat(F.lit("f/"), "p_brand").alias("path"), "p_partkey", F.when((F.col("p_partkey") % 31 == 0) & F.lit(changed), "x").otherwise(F.col("p_name")).alias("v"))
    return p.groupBy("path").agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col("p_partkey").cast("string"), "v"))), ",")).alias("digest"))


PRINTS = """a AS (SELECT 'f/' || p_brand AS path, md5(string_agg(p_partkey || ':' || p_name, ',' ORDER BY p_partkey || ':' || p_name)) AS da FROM part GROUP BY 1),
  b AS (SELECT 'f/' || p_brand AS path, md5(string_agg(p_partkey || ':' || CASE WHEN p_partkey % 31 = 0 THEN 'x' ELSE p_name END, ',' ORDER BY p_partkey || ':' || CASE WHEN p_partkey % 31 = 0 THEN 'x' ELSE p_name END)) AS db FROM part GROUP BY 1)"""


@query("gate_changed_tables", f"WITH {PRINTS} SELECT path, CASE WHEN path LIKE '%1%' THEN 'changed' ELSE 'changed_outside_targets' END AS issue FROM a FULL JOIN b USING (path) WHERE da IS DISTINCT FROM db")
def gate_changed_tables(spark, d):
    before = prints(spark, d)
    return G.changed_tables(before, prints(spark, d, True), before.where("path like '%1%'").select("path"))


@query("fingerprint_diff", f"WITH {PRINTS} SELECT path, CASE WHEN da IS NULL THEN 'extra' WHEN db IS NULL THEN 'missing' ELSE 'mismatched' END AS status FROM (SELECT * FROM a WHERE path NOT LIKE '%3') FULL JOIN (SELECT * FROM b WHERE path NOT LIKE '%4') USING (path) WHERE da IS DISTINCT FROM db")
def fingerprint_diff(spark, d):
    from tablewright.sources.packages import fingerprint_diff as diff

    return diff(prints(spark, d).where("path not like '%3'"), prints(spark, d, True).where("path not like '%4'"))


@query("gate_shared_asset", "SELECT 'summary/lines' AS path, issue, 1::BIGINT AS count FROM (VALUES ('patient_column:hadm_id'), ('differs_from_source')) t(issue) WHERE (SELECT count(*) FROM lineitem) > 0")
def gate_shared_asset(spark, d):
    from tablewright.sources.packages import table_digest

    li = table(spark, d, "lineitem")
    asset = li.select(F.col("l_orderkey").alias("hadm_id"), "l_quantity")
    source, own = table_digest(li.select("l_orderkey", "l_quantity")).first(), table_digest(asset.where("hadm_id % 5 <> 0")).first()
    return G.shared_asset(asset, str(source), str(own), "summary/lines")


def _digest(key: str, seed: str) -> str:
    return f"md5('{seed}|' || {key}::VARCHAR)"


@query(
    "split_by_ratio",
    f"""WITH a AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_digest('o_orderkey', 's1')}, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
  b AS (SELECT *, CASE WHEN n >= 3 THEN greatest(floor(n * 0.7 + 0.5), 1) ELSE 1 END AS t, CASE WHEN n >= 3 THEN greatest(floor(n * 0.15 + 0.5), 1) WHEN n = 2 THEN 1 ELSE 0 END AS v FROM a)
  SELECT o_orderkey, CASE WHEN i <= t THEN 'train' WHEN i <= t + v THEN 'validation' ELSE 'test' END AS split FROM b""",
)
def split_by_ratio(spark, d):
    return S.by_ratio(table(spark, d, "orders"), "o_orderkey", 0.7, 0.15, "s1", "o_orderpriority")


def _quota(source: str, count: int, out: str) -> str:
    return f"""{out}0 AS (SELECT s, n, floor(n * {count} / (SELECT sum(n) FROM {source}))::BIGINT AS q, (n * {count}) % (SELECT sum(n) FROM {source}) AS f FROM {source}),
  {out} AS (SELECT s, q + (row_number() OVER (ORDER BY f DESC, n DESC, s) <= {count} - (SELECT sum(q) FROM {out}0))::INT AS quota FROM {out}0)"""


COUNTED = f"""p AS (SELECT o_orderkey, o_orderpriority AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_digest('o_orderkey', 's2')}, o_orderkey) AS i FROM orders),
  z AS (SELECT s, count(*) AS n FROM p GROUP BY 1), {_quota('z', 201, 'qa')}, z2 AS (SELECT s, n - quota AS n FROM z JOIN qa USING (s)), {_quota('z2', 102, 'qb')},
  split_ AS (SELECT o_orderkey, CASE WHEN i <= qa.quota THEN 'train' WHEN i <= qa.quota + qb.quota THEN 'validation' ELSE 'test' END AS split FROM p JOIN qa USING (s) JOIN qb USING (s))"""


def counted(spark, d):
    return S.by_count(table(spark, d, "orders"), "o_orderkey", 201, 102, None, "s2", "o_orderpriority")


@query("split_by_count", f"WITH {COUNTED} SELECT * FROM split_")
def split_by_count(spark, d):
    return counted(spark, d)


@query("split_manifest", f"WITH {COUNTED} SELECT split, count(*) AS n_keys FROM split_ GROUP BY 1")
def split_manifest(spark, d):
    return S.manifest(counted(spark, d))


@query("split_nested_prefix", f"SELECT o_orderkey FROM (SELECT DISTINCT o_orderkey FROM orders) ORDER BY {_digest('o_orderkey', 's3')}, o_orderkey LIMIT 500")
def split_nested_prefix(spark, d):
    return S.nested_prefix(table(spark, d, "orders"), "o_orderkey", 500, "s3")


CLOSURE = """w AS (SELECT * FROM stays WHERE subject_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
  closure AS (SELECT DISTINCT kind, id FROM (SELECT 'stay_id' AS kind, stay_id AS id FROM w UNION ALL SELECT 'hadm_id', hadm_id FROM w UNION ALL SELECT 'subject_id', subject_id FROM w))"""


def closure(spark, d):
    keys = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("subject_id"))
    return S.id_closure(W.stays(spark, d), keys, "subject_id")


@query("id_closure", W.sql(f"{CLOSURE} SELECT * FROM closure"))
def id_closure(spark, d):
    return closure(spark, d)


@query("subset_raw_tables", W.sql(f"""{CLOSURE} SELECT 'hosp/admissions' AS path, 'filtered_by_hadm_id' AS mode, count(*) AS n_rows FROM admissions WHERE hadm_id IN (SELECT id FROM closure WHERE kind = 'hadm_id') UNION ALL
  SELECT 'hosp/d_codes', 'copied', count(*) FROM code_dictionary UNION ALL SELECT 'hosp/patients', 'filtered_by_subject_id', count(*) FROM patients WHERE subject_id IN (SELECT id FROM closure WHERE kind = 'subject_id') UNION ALL
  SELECT 'icu/icustays', 'filtered_by_stay_id', count(*) FROM w UNION ALL SELECT 'other/nation', 'skipped', 0"""))
def subset_raw_tables(spark, d):
    raw = {"hosp/admissions": W.admissions(spark, d), "hosp/patients": W.patients(spark, d), "hosp/d_codes": W.code_dictionary(spark, d), "icu/icustays": W.stays(spark, d), "other/nation": table(spark, d, "nation")}
    return S.subset_raw(raw, closure(spark, d))[1]


SUBSET = "SELECT 'a/admissions' AS path, count(*) AS n_rows FROM admissions WHERE hadm_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'b/nation', count(*) FROM nation"


@query("subset_generic", W.sql(SUBSET))
def subset_generic(spark, d):
    keys = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("hadm_id"))
    return S.counts(S.subset_generic({"a/admissions": W.admissions(spark, d), "b/nation": table(spark, d, "nation")}, keys, "hadm_id"))


@query("subset_package", f"SELECT path, count(*) AS n_rows FROM (SELECT 'cohort/orders' AS path, o_orderkey AS k FROM orders UNION ALL SELECT 'csv/labels', o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'features/lines', l_orderkey FROM lineitem) WHERE k IN (SELECT o_orderkey FROM orders WHERE {_digest('o_orderkey', 's4')} < '4') GROUP BY 1 UNION ALL SELECT 'summary/flags', count(DISTINCT l_returnflag) FROM lineitem")
def subset_package(spark, d):
    keys = table(spark, d, "orders").where(S.order_key("s4", "o_orderkey") < "4").select(F.col("o_orderkey").alias("stay_id"))
    return S.counts(S.subset_generic(package(spark, d), keys, "stay_id"))


@query("split_records", f"WITH {COUNTED}, t AS (SELECT 'cohort/orders' AS path, o_orderkey AS k FROM orders UNION ALL SELECT 'features/lines', l_orderkey FROM lineitem) SELECT split, path, count(*) AS n_rows FROM t JOIN split_ ON k = o_orderkey GROUP BY ALL")
def split_records(spark, d):
    p, split = package(spark, d), counted(spark, d).withColumnRenamed("o_orderkey", "stay_id")
    rows = [p[n].select("stay_id").join(split, "stay_id").groupBy("split").agg(F.count("*").alias("n_rows")).select("split", F.lit(n).alias("path"), "n_rows") for n in ("cohort/orders", "features/lines")]
    return rows[0].unionByName(rows[1])


@query(
    "split_preparation",
    W.sql(f"""{COUNTED}, s AS (SELECT o_orderkey AS hadm_id, split FROM split_), names AS (SELECT DISTINCT split FROM s)
  SELECT split, 'keys' AS part, 'keys' AS path, count(*) AS n_rows FROM s GROUP BY 1 UNION ALL SELECT split, 'raw', 'hosp/admissions', count(*) FROM admissions JOIN (SELECT DISTINCT hadm_id, split FROM stays JOIN s USING (hadm_id)) USING (hadm_id) GROUP BY 1
  UNION ALL SELECT split, 'raw', 'icu/icustays', count(*) FROM stays JOIN s USING (hadm_id) GROUP BY 1 UNION ALL SELECT split, 'raw', 'hosp/d_codes', (SELECT count(*) FROM code_dictionary) FROM names
  UNION ALL SELECT split, 'reference', 'cohort/orders', count(*) FROM orders JOIN s ON o_orderkey = hadm_id GROUP BY 1 UNION ALL SELECT split, 'reference', 'features/lines', count(*) FROM lineitem JOIN s ON l_orderkey = hadm_id GROUP BY 1"""),
)
def split_preparation(spark, d):
    raw = {"hosp/admissions": W.admissions(spark, d), "hosp/d_codes": W.code_dictionary(spark, d), "icu/icustays": W.stays(spark, d)}
    reference = {n: df.withColumnRenamed("stay_id", "hadm_id") for n, df in package(spark, d).items() if n in ("cohort/orders", "features/lines")}
    return S.prepare(raw, reference, counted(spark, d).withColumnRenamed("o_orderkey", "hadm_id"), "hadm_id", W.stays(spark, d))[1]


def errors(spark, d):
    return error_rows(table(spark, d, "lineitem"))


def error_rows(li):
    return li.select(F.col("l_orderkey").alias("stay_id"), F.concat(F.lit("c"), (F.col("l_suppkey") % 4).cast("string")).alias("error_class"), F.concat(F.lit("s"), (F.col("l_suppkey") % 18).cast("string")).alias("error_subtype"))


COVERAGE = """WITH RECURSIVE e AS (SELECT l_orderkey AS stay_id, 'c' || l_suppkey % 4 AS error_class, 's' || l_suppkey % 18 AS error_subtype FROM lineitem),
  own AS (SELECT stay_id, list(DISTINCT error_subtype) AS subs, list(DISTINCT error_class) AS classes, count(*) AS n, md5('s5|' || stay_id) AS h FROM e GROUP BY 1),
  g AS (SELECT 0::BIGINT AS place, 0::BIGINT AS stay_id, []::VARCHAR[] AS subs, []::VARCHAR[] AS classes, []::BIGINT[] AS picked UNION ALL
    SELECT * FROM (SELECT g.place + 1, o.stay_id, list_distinct(list_concat(g.subs, o.subs)), list_distinct(list_concat(g.classes, o.classes)), list_append(g.picked, o.stay_id) FROM g, own o
      WHERE g.place < {0} AND NOT list_contains(g.picked, o.stay_id)
      ORDER BY len(o.subs) - len(list_intersect(o.subs, g.subs)) DESC, len(o.classes) - len(list_intersect(o.classes, g.classes)) DESC, o.n DESC, o.h, o.stay_id LIMIT 1))
  SELECT stay_id, place FROM g WHERE place > 0"""


@query("coverage_select", COVERAGE.format(8))
def coverage_select(spark, d):
    return S.coverage_select(errors(spark, d), "stay_id", 8, "s5")


@query("coverage_fill", COVERAGE.format(30))
def coverage_fill(spark, d):
    """More keys than cover anything new: the rest are filled by order."""
    return S.coverage_select(errors(spark, d), "stay_id", 30, "s5")


@query("split_correction", f"""WITH s AS (SELECT o_orderkey AS k, CASE WHEN {_digest('o_orderkey', 's6')} < '8' THEN 'train' ELSE 'test' END AS split FROM orders),
  r AS (SELECT p_partkey AS _row_index, (p_partkey * 3) % 200 AS stay_id FROM part), o AS (SELECT *, CASE WHEN _row_index % 10 = 0 THEN stay_id + 7 ELSE stay_id END AS k FROM r) SELECT _row_index, stay_id, split FROM o JOIN s USING (k)""")
def split_correction(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("_row_index"), ((F.col("p_partkey") * 3) % 200).alias("stay_id"))
    override = rows.where("_row_index % 10 = 0").select("_row_index", (F.col("stay_id") + 7).alias("stay_id"))
    split = table(spark, d, "orders").select(F.col("o_orderkey").alias("stay_id"), F.when(S.order_key("s6", "o_orderkey") < "8", "train").otherwise("test").alias("split"))
    return S.route_rows(rows, override, split, "stay_id")


@query("split_modification_log", f"""SELECT l_orderkey AS stay_id, 'c' || (l_suppkey % 4) AS error_class, 's' || (l_suppkey % 18) AS error_subtype, CASE WHEN {_digest('l_orderkey', 's6')} < '8' THEN 'train' ELSE 'test' END AS side,
  '{{"error_class":"c' || (l_suppkey % 4) || '","error_subtype":"s' || (l_suppkey % 18) || '"}}' AS row_json FROM lineitem""")
def split_modification_log(spark, d):
    train = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stay_id")).where(S.order_key("s6", "stay_id") < "8")
    return S.split_log(error_rows(table(spark, d, "lineitem")), train, "stay_id")


@query("split_checks", f"WITH {COUNTED} SELECT 'overlapping_keys' AS name, count(*) AS observed FROM (SELECT o_orderkey FROM split_ GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'uncovered_keys', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM split_)) UNION ALL SELECT 'unknown_keys', count(*) FROM split_ WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def split_checks(spark, d):
    return S.split_checks(counted(spark, d), "o_orderkey", table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")))
