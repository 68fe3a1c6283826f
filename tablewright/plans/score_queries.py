"""Scoring queries and their SQL.

The gold package is made of the orders (cohort), the parts (features), the customers
(labels) and counts by item (summary); the result package changes cells by digests of
keys, drops and repeats rows, and leaves the summary out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.cells import normal_cell
from tablewright.operators import score as S
from tablewright.plans.registry import query
from tablewright.sources.warehouse import table

KEYS = {"cohort/orders": ["o_orderkey"], "features/parts": ["p_partkey"], "csv/labels": ["c_custkey"], "summary/flags": ["l_returnflag"]}


def gold(spark, d):
    return {
        "cohort/orders": table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
        "features/parts": table(spark, d, "part").select("p_partkey", "p_brand", "p_size"),
        "csv/labels": table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 2).alias("label")),
        "summary/flags": table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("total_count")),
    }


def result(spark, d):
    g = gold(spark, d)
    orders = g["cohort/orders"].withColumn("h", F.md5(F.col("o_orderkey").cast("string"))).where("h not like '0%'")
    orders = orders.select("o_orderkey", "o_custkey", F.expr("case when h like '1%' then 'Z' else lower(o_orderstatus) end").alias("o_orderstatus"), F.expr("case when h like '2%' then '' else '  ' || o_orderpriority end").alias("o_orderpriority"))
    return {
        "cohort/orders": orders,
        "features/parts": g["features/parts"].select("p_partkey", "p_brand"),
        "csv/labels": g["csv/labels"].select("c_custkey", F.concat(F.col("label").cast("string"), F.lit(".000")).alias("label")),
    }


NORMAL = "CASE WHEN lower({0}) IN ('', 'nan', 'nat', 'none', 'null') THEN '' ELSE regexp_replace(lower({0}), '\\s+', ' ', 'g') END"
G = """g AS (SELECT o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS c, lower(o_orderstatus) AS s, lower(o_orderpriority) AS p FROM orders),
  r AS (SELECT o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS c, CASE WHEN h LIKE '1%' THEN 'z' ELSE lower(o_orderstatus) END AS s, CASE WHEN h LIKE '2%' THEN '' ELSE lower(o_orderpriority) END AS p
  FROM (SELECT *, md5(o_orderkey::VARCHAR) AS h FROM orders) WHERE h NOT LIKE '0%'),
  j AS (SELECT g.k, r.k AS rk, (g.c = r.c)::INT AS mc, (g.s = r.s)::INT AS ms, (g.p = r.p)::INT AS mp FROM g LEFT JOIN r USING (k)),
  n AS (SELECT (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM r) AS nr, count(rk) AS mk, sum(coalesce(mc, 0)) AS mc, sum(coalesce(ms, 0)) AS ms, sum(coalesce(mp, 0)) AS mp, count(*) FILTER (mc + ms + mp = 3) AS mx FROM j)"""


def f1_sql(m: str, r: str = "nr", g: str = "ng") -> str:
    return f"CASE WHEN {r} + {g} = 0 THEN 1.0 ELSE round(2 * ({m})::DOUBLE / ({r} + {g}), 6) END"


@query("normalize_cells", rf"""WITH v AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_retailprice::VARCHAR WHEN 1 THEN '  ' || upper(p_name) || '   X ' WHEN 2 THEN 'NaN' WHEN 3 THEN (p_partkey % 30)::VARCHAR || ' days 02:30:00'
  WHEN 4 THEN '-0.00' WHEN 5 THEN (p_size * 100)::VARCHAR WHEN 6 THEN NULL WHEN 7 THEN '1e3' ELSE p_size::VARCHAR || '.5000000' END AS value FROM part),
  t AS (SELECT p_partkey, trim(coalesce(value, '')) AS t, lower(trim(coalesce(value, ''))) AS l FROM v),
  n AS (SELECT *, CASE WHEN regexp_matches(l, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$') THEN try_cast(l AS DECIMAL(38,6)) END AS num, regexp_extract(l, '^([0-9]+) days? ([0-9]+):([0-9]+):([0-9]+)$', ['d', 'h', 'm', 's']) AS u FROM t),
  o AS (SELECT *, CASE WHEN u.d <> '' THEN (try_cast(u.d AS INT) * 24 + try_cast(u.h AS INT) + try_cast(u.m AS DOUBLE) / 60 + try_cast(u.s AS DOUBLE) / 3600)::DECIMAL(38,6) ELSE num END AS x FROM n)
  SELECT p_partkey, CASE WHEN l IN ('', 'nan', 'nat', 'none', 'null') THEN '' WHEN x IS NOT NULL THEN rtrim(rtrim(x::VARCHAR, '0'), '.') ELSE regexp_replace(l, '\s+', ' ', 'g') END AS cell FROM o""")
def normalize_cells(spark, d):
    value = F.expr("""case p_partkey % 9 when 0 then cast(p_retailprice as string) when 1 then '  ' || upper(p_name) || '   X ' when 2 then 'NaN' when 3 then cast(p_partkey % 30 as string) || ' days 02:30:00'
      when 4 then '-0.00' when 5 then cast(p_size * 100 as string) when 6 then null when 7 then '1e3' else cast(p_size as string) || '.5000000' end""")
    return table(spark, d, "part").select("p_partkey", normal_cell(value).alias("cell"))


@query("score_schema", """SELECT 'p_partkey' AS "column", count(p_partkey) AS gold_cells, count(p_partkey) AS result_cells, round(2 / 3, 6) AS recall, 1.0 AS precision, round(4 / 5, 6) AS f1 FROM part
  UNION ALL SELECT 'p_brand', count(nullif(p_brand, '')), count(nullif(p_brand, '')), round(2 / 3, 6), 1.0, round(4 / 5, 6) FROM part UNION ALL SELECT 'p_size', count(p_size), 0, round(2 / 3, 6), 1.0, round(4 / 5, 6) FROM part""")
def score_schema(spark, d):
    return S.schema_report(gold(spark, d)["features/parts"], result(spark, d)["features/parts"])


BRANDS = """f AS (SELECT DISTINCT CASE p_size % 9 WHEN 0 THEN 'Cohort/' WHEN 1 THEN 'csv/labels.csv' WHEN 2 THEN 'features/preproc_chart_icu.csv' WHEN 3 THEN 'features/preproc_med_icu.csv' WHEN 4 THEN 'summary/diag_' WHEN 5 THEN 'summary/' WHEN 6 THEN 'x/labels.csv' ELSE 'other/' END
  || CASE WHEN p_size % 9 IN (0, 4, 5, 7, 8) THEN lower(replace(p_brand, '#', '_')) || '.csv' ELSE '' END AS path, CASE WHEN p_size % 9 = 7 THEN ['note', 'hadm_id', 'itemid'] WHEN p_brand LIKE '%1' THEN ['case_id', 'stay_id'] WHEN p_brand LIKE '%2' THEN ['note'] ELSE ['itemid', 'subject_id'] END AS columns FROM part)"""


@query("key_contract", f"""WITH {BRANDS} SELECT path, array_to_string(columns, ',') AS columns, array_to_string(CASE WHEN lower(path) LIKE 'cohort/%' OR lower(path) LIKE '%/labels.csv' THEN ['stay_id'] WHEN path = 'features/preproc_chart_icu.csv' THEN ['stay_id', 'itemid', 'event_time_from_admit']
  WHEN path = 'features/preproc_med_icu.csv' THEN ['subject_id', 'hadm_id', 'stay_id', 'itemid', 'starttime', 'endtime', 'orderid'] WHEN path LIKE 'summary/diag_%' THEN ['new_icd_code'] WHEN path LIKE 'summary/%' THEN ['itemid'] WHEN list_contains(columns, 'case_id') THEN ['case_id']
  WHEN list_contains(columns, 'hadm_id') THEN ['hadm_id'] WHEN list_contains(columns, 'subject_id') THEN ['subject_id'] ELSE [] END, ',') AS keys FROM f""")
def key_contract(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_size") % 9)
    name = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".csv"))
    of = ["Cohort/", "csv/labels.csv", "features/preproc_chart_icu.csv", "features/preproc_med_icu.csv", "summary/diag_", "summary/", "x/labels.csv", "other/", "other/"]
    path = F.concat(F.get(F.array(*map(F.lit, of)), F.col("k").cast("int")), F.when(F.col("k").isin(0, 4, 5, 7, 8), name).otherwise(""))
    list_ = lambda *c: F.array(*map(F.lit, c))
    columns = F.when(F.col("k") == 7, list_("note", "hadm_id", "itemid")).when(F.col("p_brand").endswith("1"), list_("case_id", "stay_id")).when(F.col("p_brand").endswith("2"), list_("note")).otherwise(list_("itemid", "subject_id"))
    out = S.key_contract(p.select(path.alias("path"), columns.alias("columns")).distinct(), "case_id")
    return out.select("path", F.array_join("columns", ",").alias("columns"), F.array_join("keys", ",").alias("keys"))


@query("score_key_structure", f"WITH {G} SELECT mk AS matched, ng AS gold_rows, nr AS result_rows, {f1_sql('mk')} AS key_f1 FROM n")
def score_key_structure(spark, d):
    return S.key_structure(gold(spark, d)["cohort/orders"], result(spark, d)["cohort/orders"], ["o_orderkey"])


@query("score_cells", f"""WITH {G} SELECT 'o_orderkey' AS "column", mk AS matched FROM n UNION ALL SELECT 'o_custkey', mc::BIGINT FROM n UNION ALL SELECT 'o_orderstatus', ms::BIGINT FROM n UNION ALL SELECT 'o_orderpriority', mp::BIGINT FROM n""")
def score_cells(spark, d):
    g = gold(spark, d)["cohort/orders"]
    return S.cells_unique(g, result(spark, d)["cohort/orders"], ["o_orderkey"], g.columns)


PER_COLUMN = f"""pc AS (SELECT 'o_orderkey' AS "column", mk AS matched FROM n UNION ALL SELECT 'o_custkey', mc::BIGINT FROM n UNION ALL SELECT 'o_orderstatus', ms::BIGINT FROM n UNION ALL SELECT 'o_orderpriority', mp::BIGINT FROM n),
  cs AS (SELECT "column", 'matched' AS status, matched, ng AS gold_cells, nr AS result_cells, round(matched / greatest(nr, 1), 6) AS precision, round(matched / greatest(ng, 1), 6) AS recall, {f1_sql('matched')} AS column_f1 FROM pc, n UNION ALL
  SELECT 'o_note', 'missing_column', 0, ng, nr, 0.0, 0.0, 0.0 FROM n)"""


@query("score_columns", f"WITH {G}, {PER_COLUMN} SELECT * FROM cs")
def score_columns(spark, d):
    g = gold(spark, d)["cohort/orders"].withColumn("o_note", F.lit("n"))
    return S.column_scores(g, result(spark, d)["cohort/orders"], ["o_orderkey"])


@query("low_column_targets", f"WITH {G}, {PER_COLUMN} SELECT 'cohort/orders' AS path, 'low_column_f1' AS target, \"column\" AS detail FROM cs WHERE column_f1 < 0.98")
def low_column_targets(spark, d):
    g, r = gold(spark, d)["cohort/orders"].withColumn("o_note", F.lit("n")), result(spark, d)["cohort/orders"]
    columns = S.column_scores(g, r, ["o_orderkey"]).withColumn("path", F.lit("cohort/orders"))
    return S.repair_targets(files(spark, d), columns).where("target = 'low_column_f1'")


LINES = """g AS (SELECT l_orderkey::VARCHAR AS a, l_linenumber::VARCHAR AS b, lower(l_returnflag) AS c FROM lineitem),
  r AS (SELECT l_orderkey::VARCHAR AS a, l_linenumber::VARCHAR AS b, CASE WHEN l_suppkey % 9 = 0 THEN 'x' ELSE lower(l_returnflag) END AS c FROM lineitem WHERE l_partkey % 50 <> 0),
  m AS (SELECT sum(x) AS x, sum(y) AS y FROM (SELECT a, b, c, 1 AS x, 0 AS y FROM g UNION ALL SELECT a, b, c, 0, 1 FROM r) GROUP BY a, b, c)"""


def lines(spark, d):
    li = table(spark, d, "lineitem")
    g = li.select("l_orderkey", "l_linenumber", "l_returnflag")
    return g, li.where("l_partkey % 50 <> 0").select("l_orderkey", "l_linenumber", F.expr("case when l_suppkey % 9 = 0 then 'X' else l_returnflag end").alias("l_returnflag"))


@query("score_exact_rows", f"WITH {LINES} SELECT sum(least(x, y))::BIGINT AS matched, sum(x)::BIGINT AS gold_rows, sum(y)::BIGINT AS result_rows, {f1_sql('sum(least(x, y))', 'sum(y)', 'sum(x)')} AS exact_f1 FROM m")
def score_exact_rows(spark, d):
    return S.exact_rows(*lines(spark, d), ["l_orderkey", "l_linenumber", "l_returnflag"])


# with one column beside the key the best assignment matches as many cells as equal rows
@query("score_cells_duplicates", f"""WITH {LINES}, k AS (SELECT sum(least(x, y))::BIGINT AS n FROM (SELECT a, b, sum(x) AS x, sum(y) AS y FROM (SELECT a, b, 1 AS x, 0 AS y FROM g UNION ALL SELECT a, b, 0, 1 FROM r) GROUP BY a, b))
  SELECT 'l_returnflag' AS "column", sum(least(x, y))::BIGINT AS matched FROM m UNION ALL SELECT 'l_orderkey', n FROM k""")
def score_cells_duplicates(spark, d):
    return S.cells(*lines(spark, d), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_returnflag"])


# two rows a key on either side: the better of the two ways to pair them, cell by cell
@query(
    "score_cells_assignment",
    """WITH p AS (SELECT p_partkey // 2 AS k, p_partkey % 2 AS i, lower(p_brand) AS b, p_size::VARCHAR AS s, lower(p_type) AS t, md5(p_partkey::VARCHAR) AS h FROM part),
  r AS (SELECT k, i, CASE WHEN h LIKE '_1%' THEN 'x' ELSE b END AS b, CASE WHEN h LIKE '_2%' THEN '0' ELSE s END AS s, CASE WHEN h < '8' THEN 'y' ELSE t END AS t FROM p WHERE h NOT LIKE '0%'),
  w AS (SELECT k, p.i * 2 + r.i AS which, (p.b = r.b)::INT + (p.s = r.s)::INT + (p.t = r.t)::INT AS n FROM p JOIN r USING (k)),
  m AS (SELECT k, max(n) FILTER (which = 0) AS a, max(n) FILTER (which = 3) AS d, max(n) FILTER (which = 1) AS b, max(n) FILTER (which = 2) AS c FROM w GROUP BY 1)
  SELECT sum(greatest(coalesce(a, 0) + coalesce(d, 0), coalesce(b, 0) + coalesce(c, 0)))::BIGINT AS matched FROM m""",
)
def score_cells_assignment(spark, d):
    p = table(spark, d, "part").withColumn("h", F.md5(F.col("p_partkey").cast("string"))).withColumn("k", F.floor(F.col("p_partkey") / 2))
    g = p.select("k", F.col("p_brand").alias("b"), F.col("p_size").alias("s"), F.col("p_type").alias("t"))
    r = p.where("h not like '0%'").select("k", F.expr("case when h like '_1%' then 'X' else p_brand end").alias("b"), F.expr("case when h like '_2%' then 0 else p_size end").alias("s"), F.expr("case when h < '8' then 'Y' else p_type end").alias("t"))
    return S.cells(g, r, ["k"], ["b", "s", "t"]).agg(F.sum("matched").alias("matched"))


ORDERS = f"SELECT 1.0 AS schema_f1, {f1_sql('mk')} AS key_f1, round(2 * (mk + mc + ms + mp)::DOUBLE / (ng + nr) / 4, 6) AS cell_f1, {f1_sql('mx')} AS exact_f1, ng AS gold_rows, nr AS result_rows FROM n"
SCORED = "SELECT schema_f1, key_f1, cell_f1, exact_f1, round(0.1 * schema_f1 + 0.2 * key_f1 + 0.4 * cell_f1 + 0.3 * exact_f1, 6) AS score, gold_rows, result_rows"


@query("score_file", f"WITH {G}, f AS ({ORDERS}) {SCORED} FROM f")
def score_file(spark, d):
    return S.file_score(gold(spark, d)["cohort/orders"], result(spark, d)["cohort/orders"], ["o_orderkey"])


FILES = f"""{G}, f AS (SELECT 'cohort/orders' AS path, 'scored' AS status, * FROM ({ORDERS}) UNION ALL
  SELECT 'features/parts', 'scored', 0.8, 1.0, round(2 / 3, 6), 0.0, count(*), count(*) FROM part UNION ALL SELECT 'csv/labels', 'scored', 1.0, 1.0, 1.0, 1.0, count(*), count(*) FROM customer UNION ALL
  SELECT 'summary/flags', 'missing', 0.0, 0.0, 0.0, 0.0, count(DISTINCT l_returnflag), 0 FROM lineitem),
  files AS (SELECT path, status, schema_f1, key_f1, cell_f1, exact_f1, round(0.1 * schema_f1 + 0.2 * key_f1 + 0.4 * cell_f1 + 0.3 * exact_f1, 6) AS score, gold_rows, result_rows FROM f)"""


def files(spark, d):
    return S.package_files(gold(spark, d), result(spark, d), KEYS, unique=True)


@query("score_package_files", f"WITH {FILES} SELECT * FROM files")
def score_package_files(spark, d):
    return files(spark, d)


BALANCED = """w AS (SELECT *, CASE split_part(path, '/', 1) WHEN 'cohort' THEN 0.15 WHEN 'csv' THEN 0.05 WHEN 'features' THEN 0.12 ELSE 0.02 END::DOUBLE AS w, CASE split_part(path, '/', 1) WHEN 'features' THEN 'feature' WHEN 'summary' THEN 'summary' ELSE 'core' END AS part FROM files)
  SELECT part, round(sum(w * score) / sum(w), 6) AS score, round(avg((status = 'scored')::INT), 6) AS coverage FROM (SELECT part, w, score, status FROM w UNION ALL SELECT 'package', w, score, status FROM w) GROUP BY 1"""


@query("score_package_balanced", f"WITH {FILES}, {BALANCED}")
def score_package_balanced(spark, d):
    return S.balanced(files(spark, d))


@query("score_package_equal", f"WITH {FILES} SELECT count(*) AS files, round(avg(score), 6) AS score FROM files")
def score_package_equal(spark, d):
    return S.equal_weight(files(spark, d))


PATHS = "gp AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'features/' ELSE 'summary/' END || replace(p_name, ' ', '_') AS path FROM part), rp AS (SELECT CASE WHEN p_size % 3 <> 1 THEN 'features/' ELSE 'other/' END || replace(p_name, ' ', '_') AS path FROM part WHERE p_size % 2 = 0)"


@query(
    "match_package_files",
    f"""WITH {PATHS}, g AS (SELECT DISTINCT path AS gold_path FROM gp), r AS (SELECT DISTINCT path AS result_path FROM rp), e AS (SELECT * FROM g JOIN r ON gold_path = result_path),
  g2 AS (SELECT gold_path, split_part(gold_path, '/', 2) AS b FROM g WHERE gold_path NOT IN (SELECT gold_path FROM e)), r2 AS (SELECT result_path, split_part(result_path, '/', 2) AS b FROM r WHERE result_path NOT IN (SELECT result_path FROM e)),
  c AS (SELECT gold_path, (SELECT count(*) FROM r2 WHERE r2.b = g2.b) AS n, (SELECT count(*) FROM g2 x WHERE x.b = g2.b) AS m, (SELECT min(result_path) FROM r2 WHERE r2.b = g2.b) AS rp FROM g2),
  f AS (SELECT gold_path, result_path, 'path' AS status FROM e UNION ALL SELECT gold_path, CASE WHEN n = 1 AND m = 1 THEN rp END, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 AND m = 1 THEN 'base_name' ELSE 'ambiguous' END FROM c)
  SELECT * FROM f UNION ALL SELECT NULL, result_path, 'extra' FROM r WHERE result_path NOT IN (SELECT result_path FROM f WHERE result_path IS NOT NULL)""",
)
def match_package_files(spark, d):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    p = table(spark, d, "part")
    g = p.select(F.concat(F.when(F.col("p_size") % 3 == 0, "features/").otherwise("summary/"), name).alias("path"))
    r = p.where("p_size % 2 = 0").select(F.concat(F.when(F.col("p_size") % 3 != 1, "features/").otherwise("other/"), name).alias("path"))
    return S.match_files(g, r)


@query(
    "manifest_issues",
    """WITH c AS (SELECT DISTINCT 'f/' || p_brand AS path, p_type AS col FROM part), m AS (SELECT DISTINCT 'f/' || p_brand AS path, CASE WHEN p_brand LIKE '%1' THEN [] ELSE ['PROMO', 'NONE'] END AS keys FROM part WHERE p_brand NOT LIKE '%2' UNION ALL SELECT 'f/unknown', ['PROMO'])
  SELECT path, 'unknown_file' AS issue FROM m WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT DISTINCT path, 'no_entry' FROM c WHERE path NOT IN (SELECT path FROM m) UNION ALL SELECT path, 'no_keys' FROM m WHERE len(keys) = 0
  UNION ALL SELECT path, 'missing_key:' || k FROM (SELECT path, unnest(keys) AS k FROM m WHERE path IN (SELECT path FROM c)) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = x.path AND c.col = x.k)""",
)
def manifest_issues(spark, d):
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("f/"), "p_brand"))
    columns = p.select("path", F.col("p_type").alias("column")).distinct()
    entry = F.when(F.col("p_brand").endswith("1"), F.array().cast("array<string>")).otherwise(F.array(F.lit("PROMO"), F.lit("NONE")))
    m = p.where("p_brand not like '%2'").select("path", entry.alias("keys")).distinct()
    return S.manifest_issues(m.unionAll(spark.range(1).select(F.lit("f/unknown"), F.array(F.lit("PROMO")))), columns)


TARGETS = """targets AS (SELECT path, 'missing_file' AS target, '' AS detail FROM files WHERE status = 'missing' UNION ALL SELECT path, 'missing_columns', '' FROM files WHERE status = 'scored' AND schema_f1 < 1
  UNION ALL SELECT path, 'key_structure_mismatch', '' FROM files WHERE status = 'scored' AND key_f1 < 0.98 UNION ALL SELECT path, 'low_exact_row_f1', '' FROM files WHERE status = 'scored' AND exact_f1 < 0.98)"""


@query("repair_targets", f"WITH {FILES}, {TARGETS} SELECT * FROM targets")
def repair_targets(spark, d):
    return S.repair_targets(files(spark, d))


@query("feedback_rows", f"WITH {FILES} SELECT split_part(path, '/', 2) AS file, score, gold_rows, result_rows, status FROM files")
def feedback_rows(spark, d):
    return S.feedback(files(spark, d))


@query("regression_report", f"WITH {FILES} SELECT path, status = 'scored' AND gold_rows = result_rows AND schema_f1 = 1 AND key_f1 = 1 AND cell_f1 = 1 AND exact_f1 = 1 AS passed FROM files")
def regression_report(spark, d):
    return S.regression(files(spark, d))


@query(
    "score_recall",
    f"""WITH {G}, gc AS (SELECT k, unnest([1, 2, 3]) AS i, unnest([c, s, p]) AS v FROM g), rc AS (SELECT k, unnest([1, 2, 3]) AS i, unnest([c, s, p]) AS v FROM r),
  x AS (SELECT (SELECT count(*) FROM gc WHERE v <> '') AS g, (SELECT count(*) FROM rc WHERE v <> '') AS r, (SELECT count(*) FROM gc JOIN rc USING (k, i, v) WHERE v <> '') AS m),
  o AS (SELECT round(mx / ng, 6) AS row_recall, round(mk / ng, 6) AS key_recall, round(m / x.g, 6) AS cell_recall, round(m / x.r, 6) AS cell_precision, 1.0 AS column_recall FROM n, x)
  SELECT *, round(0.1 + 0.2 * column_recall + 0.2 * row_recall + 0.4 * cell_recall + 0.1 * cell_precision, 6) AS composite FROM o""",
)
def score_recall(spark, d):
    return S.recall(gold(spark, d)["cohort/orders"], result(spark, d)["cohort/orders"], ["o_orderkey"])


UNIQUE = f"""{G}, u AS (SELECT 'o_custkey' AS "column", ng AS cells, mc::BIGINT AS matched FROM n UNION ALL SELECT 'o_orderstatus', ng, ms::BIGINT FROM n UNION ALL SELECT 'o_orderpriority', ng, mp::BIGINT FROM n)"""


@query("score_unique_recall", f"""WITH {UNIQUE} SELECT *, round(matched / greatest(cells, 1), 6) AS recall FROM u""")
def score_unique_recall(spark, d):
    return S.unique_recall(gold(spark, d)["cohort/orders"], result(spark, d)["cohort/orders"], ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("recall_targets", f"""WITH {UNIQUE} SELECT * FROM (SELECT 'missing_reference_rows' AS target, '' AS detail, (ng - mk)::DOUBLE AS value FROM n UNION ALL SELECT 'over_extraction', '', (nr - mk)::DOUBLE FROM n) WHERE value > 0
  UNION ALL SELECT 'low_column_recall', "column", round(matched / greatest(cells, 1), 6) FROM u WHERE round(matched / greatest(cells, 1), 6) < 0.98""")
def recall_targets(spark, d):
    return S.recall_targets(gold(spark, d)["cohort/orders"], result(spark, d)["cohort/orders"], ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("score_rowset_recall", f"WITH {LINES} SELECT sum(x)::BIGINT AS gold_rows, sum(CASE WHEN y > 0 THEN x ELSE 0 END)::BIGINT AS matched, round(sum(CASE WHEN y > 0 THEN x ELSE 0 END) / greatest(sum(x), 1), 6) AS recall FROM m")
def score_rowset_recall(spark, d):
    return S.rowset_recall(*lines(spark, d), ["l_orderkey", "l_linenumber", "l_returnflag"])


@query("repair_target_ids", f"WITH {FILES}, {TARGETS} SELECT *, substr(sha256(target || '|' || path || '|' || detail), 1, 10) AS target_id FROM targets")
def repair_target_ids(spark, d):
    return S.target_ids(S.repair_targets(files(spark, d)))


@query("targets_from_issues", f"WITH {FILES}, {TARGETS} SELECT DISTINCT 'features/' || replace(p_name, ' ', '_') AS path, 'reported_issue' AS target FROM part UNION SELECT 'cohort/' || p_brand[7:], 'reported_issue' FROM part WHERE p_size % 5 = 0")
def targets_from_issues(spark, d):
    more = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" or cohort/"), F.substring("p_brand", 7, 9))).otherwise("")
    texts = table(spark, d, "part").select(F.concat(F.lit("see features/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(" and features/parts"), more).alias("text"))
    return S.targets_from_issues(texts, S.repair_targets(files(spark, d)))


@query(
    "score_file_unaligned",
    """WITH r AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'), g AS (SELECT count(*) AS n FROM orders) SELECT "case", schema_f1, 0.0::DOUBLE AS key_f1, 0.0::DOUBLE AS cell_f1, 0.0::DOUBLE AS exact_f1, round(0.1 * schema_f1, 6) AS score, g.n AS gold_rows, r.n AS result_rows
  FROM r, g, (SELECT 'key column missing' AS "case", round(2 * 2 / (3 + 2), 6)::DOUBLE AS schema_f1 UNION ALL SELECT 'no key', 1.0)""",
)
def score_file_unaligned(spark, d):
    """Scores of a result without the gold table's key column, and of a table without a known key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    r = o.where("o_orderstatus <> 'F'")
    missing = S.file_score(o, r.drop("o_orderkey"), ["o_orderkey"]).select(F.lit("key column missing").alias("case"), "*")
    return missing.unionByName(S.file_score(o, r, []).select(F.lit("no key").alias("case"), "*"))


@query(
    "score_columns_unaligned",
    """SELECT "column", CASE WHEN "column" = 'o_orderkey' THEN 'missing_column' ELSE 'matched' END AS status, 0::BIGINT AS matched, (SELECT count(*) FROM orders) AS gold_cells, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS result_cells,
  0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 0.0::DOUBLE AS column_f1 FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus']) AS "column")""",
)
def score_columns_unaligned(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return S.column_scores(o, o.where("o_orderstatus <> 'F'").drop("o_orderkey"), ["o_orderkey"])


@query(
    "score_unreadable",
    """SELECT 'cohort/orders' AS path, 'missing' AS status, 0.0::DOUBLE AS score, count(*) AS gold_rows, 0::BIGINT AS result_rows FROM orders UNION ALL SELECT 'csv/labels', 'unreadable', 0.0, count(*), 0 FROM customer
  UNION ALL SELECT 'features/parts', 'scored', 1.0, count(*), count(*) FROM part UNION ALL SELECT 'summary/flags', 'missing', 0.0, count(DISTINCT l_returnflag), 0 FROM lineitem""",
)
def score_unreadable(spark, d):
    """Files that are missing or cannot be read score zero and keep their gold rows."""
    g = gold(spark, d)
    files = S.package_files(g, {"csv/labels": None, "features/parts": g["features/parts"]}, KEYS)
    return files.select("path", "status", "score", "gold_rows", "result_rows")
