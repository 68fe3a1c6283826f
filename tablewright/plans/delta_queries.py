"""Delta and comparison queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import delta as D
from tablewright.plans.registry import query
from tablewright.sources.warehouse import table

BEFORE = "before_ AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders)"
AFTER = """after_ AS (SELECT CASE WHEN h LIKE '2%' THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
  CASE WHEN h LIKE '3%' THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN h LIKE '1%' OR h LIKE '3%' THEN upper(o_orderpriority) || '!' ELSE o_orderpriority END AS o_orderpriority
  FROM (SELECT *, md5(o_orderkey::VARCHAR) AS h FROM orders) WHERE h NOT LIKE '0%')"""
LINES = "x AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem)"
CHANGED = "y AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 9 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_partkey % 50 <> 0)"


def before(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def after(spark, d):
    o = table(spark, d, "orders").withColumn("h", F.md5(F.col("o_orderkey").cast("string"))).where("h not like '0%'")
    return o.select(
        F.expr("case when h like '2%' then o_orderkey + 1000000000 else o_orderkey end").alias("o_orderkey"),
        "o_custkey",
        F.expr("case when h not like '3%' then o_orderstatus end").alias("o_orderstatus"),
        F.expr("case when h like '1%' or h like '3%' then upper(o_orderpriority) || '!' else o_orderpriority end").alias("o_orderpriority"),
    )


def lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")


def changed_lines(spark, d):
    li = table(spark, d, "lineitem").where("l_partkey % 50 <> 0")
    return li.select("l_orderkey", "l_linenumber", F.expr("case when l_suppkey % 9 = 0 then 'X' else l_returnflag end").alias("l_returnflag"))


PAIRS = f"WITH {BEFORE}, {AFTER}, p AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, (a.o_custkey IS DISTINCT FROM b.o_custkey)::INT AS c1, (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus)::INT AS c2, (a.o_orderpriority IS DISTINCT FROM b.o_orderpriority)::INT AS c3, a.o_orderstatus AS s1, b.o_orderstatus AS s2, a.o_orderpriority AS p1, b.o_orderpriority AS p2 FROM before_ a FULL JOIN after_ b ON a.o_orderkey = b.o_orderkey)"


@query("delta_keyed", PAIRS + " SELECT count(*) FILTER (ka IS NULL) AS inserted_rows, count(*) FILTER (kb IS NULL) AS deleted_rows, count(*) FILTER (ka = kb AND c1 + c2 + c3 > 0) AS changed_rows, sum(CASE WHEN ka = kb THEN c1 + c2 + c3 ELSE 0 END)::BIGINT AS changed_cells FROM p")
def delta_keyed(spark, d):
    return D.keyed(before(spark, d), after(spark, d), ["o_orderkey"])


@query("delta_by_column", PAIRS + """ SELECT 'o_custkey' AS "column", sum(c1) FILTER (ka = kb)::BIGINT AS changed_cells FROM p UNION ALL SELECT 'o_orderstatus', sum(c2) FILTER (ka = kb)::BIGINT FROM p UNION ALL SELECT 'o_orderpriority', sum(c3) FILTER (ka = kb)::BIGINT FROM p""")
def delta_by_column(spark, d):
    return D.by_column(before(spark, d), after(spark, d), ["o_orderkey"])


@query("delta_examples", PAIRS + """ SELECT * FROM (SELECT ka AS o_orderkey, 'o_orderstatus' AS "column", s1 AS before, s2 AS after FROM p WHERE ka = kb AND c2 = 1 UNION ALL SELECT ka, 'o_orderpriority', p1, p2 FROM p WHERE ka = kb AND c3 = 1) ORDER BY o_orderkey, "column" LIMIT 20""")
def delta_examples(spark, d):
    return D.examples(before(spark, d), after(spark, d), ["o_orderkey"])


COUNTS = f"WITH {LINES}, {CHANGED}, r AS (SELECT l_orderkey, l_linenumber, l_returnflag, sum(a) AS a, sum(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM x UNION ALL SELECT *, 0, 1 FROM y) GROUP BY ALL)"


@query(
    "delta_duplicate_groups",
    COUNTS + """, g AS (SELECT sum(a) AS a, sum(b) AS b, sum(greatest(b - a, 0)) AS i, sum(greatest(a - b, 0)) AS e FROM r GROUP BY l_orderkey, l_linenumber HAVING sum(a) > 1 OR sum(b) > 1)
  SELECT count(*) AS duplicate_groups, count(*) FILTER (i + e > 0) AS ambiguous_groups, sum(i)::BIGINT AS inserted_rows, sum(e)::BIGINT AS deleted_rows FROM g""",
)
def delta_duplicate_groups(spark, d):
    return D.duplicate_groups(lines(spark, d), changed_lines(spark, d), ["l_orderkey", "l_linenumber"])


MULTISET = "SELECT sum(greatest(b - a, 0))::BIGINT AS inserted_rows, sum(greatest(a - b, 0))::BIGINT AS deleted_rows FROM r"


@query("delta_multiset", f"{COUNTS} {MULTISET}")
def delta_multiset(spark, d):
    return D.multiset(lines(spark, d), changed_lines(spark, d))


@query("delta_package", f"{COUNTS} SELECT 'csv/lines' AS path, 'compared' AS status, * FROM ({MULTISET}) UNION ALL SELECT 'csv/nation', 'deleted_file', 0, count(*) FROM nation UNION ALL SELECT 'csv/part', 'inserted_file', count(*), 0 FROM part")
def delta_package(spark, d):
    return D.package({"csv/lines": lines(spark, d), "csv/nation": table(spark, d, "nation")}, {"csv/lines": changed_lines(spark, d), "csv/part": table(spark, d, "part")})


@query("delta_schema", """SELECT 2::BIGINT AS place, 'l_returnflag' AS "column", 'removed' AS change, count(l_returnflag) AS cells FROM lineitem UNION ALL SELECT 2, 'l_flag', 'added', count(*) FILTER (l_returnflag <> 'R') FROM lineitem UNION ALL SELECT 3, 'l_tax', 'added', count(l_tax) FROM lineitem""")
def delta_schema(spark, d):
    new = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("l_flag"), "l_tax")
    return D.schema_delta(lines(spark, d), new)


COMPARE = f"""{BEFORE}, changed AS (SELECT o_orderkey, (o_custkey + CASE WHEN o_custkey % 3 = 0 THEN 1 WHEN o_custkey % 3 = 1 THEN 5 ELSE 0 END) AS o_custkey,
  CASE WHEN o_orderkey % 13 = 0 THEN 'None' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 17 <> 0),
  c AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, abs(a.o_custkey - b.o_custkey) > 2 AS u1, a.o_orderstatus <> CASE WHEN b.o_orderstatus = 'None' THEN '' ELSE b.o_orderstatus END AS u2 FROM before_ a FULL JOIN changed b USING (o_orderkey)),
  n AS (SELECT count(*) FILTER (ka = kb) AS compared, count(*) FILTER (ka = kb AND u1) AS u1, count(*) FILTER (ka = kb AND u2) AS u2, count(*) FILTER (kb IS NULL) AS missing_rows, count(*) FILTER (ka IS NULL) AS extra_rows FROM c),
  rows_ AS (SELECT 'o_orderkey' AS "column", compared, 0::BIGINT AS unequal, missing_rows, extra_rows FROM n UNION ALL SELECT 'o_custkey', compared, u1, missing_rows, extra_rows FROM n UNION ALL SELECT 'o_orderstatus', compared, u2, missing_rows, extra_rows FROM n),
  rates AS (SELECT *, round(1 - unequal / greatest(compared, 1), 6) AS match_rate FROM rows_)"""


def changed(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 17 <> 0")
    return o.select(
        "o_orderkey",
        F.expr("o_custkey + case when o_custkey % 3 = 0 then 1 when o_custkey % 3 = 1 then 5 else 0 end").alias("o_custkey"),
        F.expr("case when o_orderkey % 13 = 0 then 'None' else o_orderstatus end").alias("o_orderstatus"),
    )


@query("compare_tables", f"WITH {COMPARE} SELECT * FROM rates")
def compare_tables(spark, d):
    return D.compare(before(spark, d), changed(spark, d), ["o_orderkey"], 2.0)


@query("compare_packages", f"""WITH {COMPARE} SELECT 'orders' AS path, 'compared' AS status, * FROM rates UNION ALL SELECT 'part', 'missing', NULL, 0, 0, 0, 0, 0.0 UNION ALL SELECT 'region', 'extra', NULL, 0, 0, 0, 0, 0.0""")
def compare_packages(spark, d):
    return D.compare_packages({"orders": before(spark, d), "part": table(spark, d, "part")}, {"orders": changed(spark, d), "region": table(spark, d, "region")}, {"orders": ["o_orderkey"]}, 2.0)
