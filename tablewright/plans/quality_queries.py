"""Profiling and constraint queries and their SQL.

Dirty tables are made inside the query from digests of keys, so that the SQL can make the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import constraints as K
from tablewright.operators import profile as P
from tablewright.plans.registry import query
from tablewright.sources.warehouse import table

ORDER_COLUMNS = ["o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate", "o_flag", "o_none"]
DIRTY = """dirty AS (SELECT o_orderkey, CASE WHEN md5(o_orderkey::VARCHAR) LIKE '0%' THEN ' ' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN md5(o_orderkey::VARCHAR) LIKE '1%' THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_custkey,
  CASE WHEN md5(o_orderkey::VARCHAR) LIKE '22%' THEN 'n/a' ELSE (o_totalprice::DECIMAL(18,2))::VARCHAR END AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'No' END AS o_flag, NULL::VARCHAR AS o_none FROM orders)"""


def dirty(spark, d):
    o = table(spark, d, "orders")
    h = F.md5(F.col("o_orderkey").cast("string"))
    return o.select(
        "o_orderkey",
        F.when(h.startswith("0"), " ").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(h.startswith("1"), None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_custkey",
        F.when(h.startswith("22"), "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.when(F.col("o_custkey") % 2 == 0, "true").otherwise("No").alias("o_flag"),
        F.lit(None).cast("string").alias("o_none"),
    )


def cells_sql(columns=ORDER_COLUMNS, keep="") -> str:
    return "cells AS (" + " UNION ALL ".join(f"""SELECT {keep} '{c}' AS "column", {c}::VARCHAR AS value FROM dirty""" for c in columns) + ")"


PRESENT = "(value IS NOT NULL AND trim(value) <> '')"
NUM, TIME = "try_cast(trim(value) AS DOUBLE) IS NOT NULL", "(regexp_matches(value, '[-/:T]') AND try_cast(value AS TIMESTAMP) IS NOT NULL)"


@query(
    "logical_types",
    f"""WITH {DIRTY}, {cells_sql()}, g AS (SELECT "column", count(*) FILTER {PRESENT} AS n, count(*) FILTER ({PRESENT} AND {NUM}) AS x, count(*) FILTER ({PRESENT} AND {TIME}) AS t,
  count(*) FILTER ({PRESENT} AND lower(trim(value)) IN ('true','false','0','1','yes','no')) AS b FROM cells GROUP BY 1)
  SELECT "column", n, CASE WHEN n = 0 THEN 'empty' WHEN x >= 0.95 * n THEN 'numeric' WHEN t >= 0.95 * n THEN 'datetime' WHEN b = n THEN 'boolean' ELSE 'string' END AS logical_type FROM g""",
)
def logical_types(spark, d):
    return P.logical_types(dirty(spark, d), ORDER_COLUMNS)


PATTERN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr({0}, 1, 200), '\p{{Lu}}+', 'A', 'g'), '\p{{Ll}}+', 'a', 'g'), '\p{{Nd}}+', '9', 'g'), '[\s_]+', '_', 'g')"


@query("format_patterns", f"SELECT {PATTERN.format('p_name')} AS pattern, count(*) AS n FROM (SELECT p_name || '-' || p_brand || '_ ' || p_partkey AS p_name FROM part) GROUP BY 1")
def format_patterns(spark, d):
    p = table(spark, d, "part").select(F.concat("p_name", F.lit("-"), "p_brand", F.lit("_ "), F.col("p_partkey").cast("string")).alias("p_name"))
    return P.format_patterns(p, "p_name")


PROFILE = """SELECT {keys} "column", count(*) AS n_rows, count(*) - count(v) AS missing, round((count(*) - count(v))::DOUBLE / greatest(count(*), 1), 6) AS missing_rate, count(DISTINCT v) AS distinct_values,
  count(v) > 0 AND count(x) >= 0.95 * count(v) AS is_numeric,
  CASE WHEN count(v) > 0 AND count(x) >= 0.95 * count(v) THEN round(min(x), 6) END AS min_value, CASE WHEN count(v) > 0 AND count(x) >= 0.95 * count(v) THEN round(quantile_cont(x, 0.25), 6) END AS q25,
  CASE WHEN count(v) > 0 AND count(x) >= 0.95 * count(v) THEN round(quantile_cont(x, 0.5), 6) END AS median_value, CASE WHEN count(v) > 0 AND count(x) >= 0.95 * count(v) THEN round(quantile_cont(x, 0.75), 6) END AS q75,
  CASE WHEN count(v) > 0 AND count(x) >= 0.95 * count(v) THEN round(max(x), 6) END AS max_value, min(length(v))::INT AS min_length, round(quantile_cont(length(v)::DOUBLE, 0.5), 6) AS median_length, max(length(v))::INT AS max_length
  FROM (SELECT *, CASE WHEN value IS NOT NULL AND trim(value) <> '' THEN value END AS v, try_cast(CASE WHEN value IS NOT NULL AND trim(value) <> '' THEN value END AS DOUBLE) AS x FROM cells) GROUP BY ALL"""


@query("profile_columns", f"WITH {DIRTY}, {cells_sql()} {PROFILE.format(keys='')}")
def profile_columns(spark, d):
    return P.profile_columns(dirty(spark, d), ORDER_COLUMNS)


@query(
    "profile_topk",
    f"""WITH {DIRTY}, {cells_sql(ORDER_COLUMNS[:3])}, g AS (SELECT "column", value, count(*) AS n FROM cells WHERE {PRESENT} GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM g) WHERE place <= 5""",
)
def profile_topk(spark, d):
    return P.top_values(dirty(spark, d), ORDER_COLUMNS[:3], 5)


@query("profile_group_statistics", f"WITH {DIRTY}, {cells_sql(['o_orderstatus', 'o_totalprice', 'o_orderdate'], 'o_orderpriority,')} SELECT *, distinct_values > 1 AS inconsistent FROM ({PROFILE.format(keys='o_orderpriority,')})")
def profile_group_statistics(spark, d):
    return P.group_statistics(dirty(spark, d), ["o_orderpriority"], ["o_orderstatus", "o_totalprice", "o_orderdate"])


@query(
    "profile_group_topk",
    f"""WITH {DIRTY}, {cells_sql(['o_orderstatus', 'o_totalprice'], 'o_orderpriority,')}, g AS (SELECT o_orderpriority, "column", value, count(*) AS n FROM cells WHERE {PRESENT} GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, "column" ORDER BY n DESC, value) AS place FROM g) WHERE place <= 5""",
)
def profile_group_topk(spark, d):
    return P.top_values(dirty(spark, d), ["o_orderstatus", "o_totalprice"], 5, keys=["o_orderpriority"])


@query("profile_table", "SELECT sum(n)::BIGINT AS n_rows, 3::BIGINT AS n_columns, sum(n - 1)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag)")
def profile_table(spark, d):
    return P.profile_table(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    "profile_by_group",
    f"""WITH {DIRTY}, {cells_sql(["o_orderstatus", "o_totalprice"], "o_orderpriority,")}
  SELECT o_orderpriority, "column", count(*) AS n_rows, count(*) FILTER (NOT {PRESENT}) AS missing, count(DISTINCT CASE WHEN {PRESENT} THEN value END) AS distinct_values,
  count(DISTINCT CASE WHEN {PRESENT} THEN value END) > 1 AS inconsistent FROM cells GROUP BY ALL""",
)
def profile_by_group(spark, d):
    return P.profile_by_group(dirty(spark, d), ["o_orderpriority"], ["o_orderstatus", "o_totalprice"])


@query(
    "inspect_table",
    f"""WITH {DIRTY}, {cells_sql()} SELECT "column", count(*) AS n_rows, count(*) FILTER (NOT {PRESENT}) AS missing, round((count(*) FILTER (NOT {PRESENT}))::DOUBLE / greatest(count(*), 1), 6) AS missing_rate,
  least(count(DISTINCT CASE WHEN {PRESENT} THEN value END), 2000) AS distinct_values, count(DISTINCT CASE WHEN {PRESENT} THEN value END) > 2000 AS capped FROM cells GROUP BY 1""",
)
def inspect_table(spark, d):
    return P.inspect(dirty(spark, d).select(*ORDER_COLUMNS))


@query("inspect_sample", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders ORDER BY md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) LIMIT 5")
def inspect_sample(spark, d):
    return P.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


def _flag(name: str, condition: str, extra: str = "") -> str:
    return f"WITH {DIRTY} SELECT o_orderkey, {condition} AS violates FROM dirty {extra}"


def _marked(spark, d, rule):
    return dirty(spark, d).select("o_orderkey", rule.alias("violates"))


@query("check_not_null", _flag("", "(o_orderpriority IS NULL OR trim(o_orderpriority) = '' OR o_orderstatus IS NULL OR trim(o_orderstatus) = '')"))
def check_not_null(spark, d):
    return _marked(spark, d, K.not_null(["o_orderpriority", "o_orderstatus"]))


@query("check_allowed_values", _flag("", "(o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O'))"))
def check_allowed_values(spark, d):
    return _marked(spark, d, K.allowed_values("o_orderstatus", ["F", "O"]))


@query("check_range", _flag("", "(try_cast(o_totalprice AS DOUBLE) IS NULL OR try_cast(o_totalprice AS DOUBLE) < 1000 OR try_cast(o_totalprice AS DOUBLE) > 400000)"))
def check_range(spark, d):
    return _marked(spark, d, K.in_range("o_totalprice", 1000, 400000))


@query("check_regex", _flag("", "(trim(o_orderpriority) <> '' AND NOT regexp_full_match(o_orderpriority, '[1-4]-[A-Z ]+'))"))
def check_regex(spark, d):
    return _marked(spark, d, K.full_match("o_orderpriority", "[1-4]-[A-Z ]+"))


@query("check_unique", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS violates FROM lineitem")
def check_unique(spark, d):
    return K.unique(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["l_orderkey", "l_linenumber"])


@query(
    "check_functional_dependency",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, (SELECT count(DISTINCT (l_returnflag, l_linestatus)) FROM lineitem i WHERE i.l_orderkey = o.l_orderkey) > 1 AS violates FROM lineitem o",
)
def check_functional_dependency(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return K.functional_dependency(rows, ["l_orderkey"], ["l_returnflag", "l_linestatus"]).drop("l_linestatus")


@query("check_foreign_key", "SELECT o_orderkey, k IS NOT NULL AND k NOT IN (SELECT c_custkey FROM customer) AS violates FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN o_custkey + 900000000 ELSE o_custkey END AS k FROM orders)")
def check_foreign_key(spark, d):
    k = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 900000000).otherwise(F.col("o_custkey"))
    rows = table(spark, d, "orders").select("o_orderkey", k.alias("k"))
    return K.foreign_key(rows, ["k"], table(spark, d, "customer"), ["c_custkey"]).drop("k")


@query("check_temporal_order", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate > l_shipdate AS violates FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def check_temporal_order(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", K.temporal_order(rows, "o_orderdate", "l_shipdate").alias("violates"))


def _report_row(name: str, condition: str, source: str = "dirty") -> str:
    n = f"count(*) FILTER ({condition})"
    return f"SELECT '{name}' AS \"constraint\", count(*) AS n_rows, {n} AS violations, round({n}::DOUBLE / greatest(count(*), 1), 6) AS violation_rate, {n} = 0 AS passed FROM {source}"


RULES = [
    {"name": "filled", "type": "not_null", "columns": ["o_orderpriority"]},
    {"name": "status", "type": "allowed_values", "column": "o_orderstatus", "values": ["F", "O", "P"]},
    {"name": "price", "type": "range", "column": "o_totalprice", "min": 0},
    {"name": "date", "type": "regex", "column": "o_orderdate", "pattern": "[0-9]{4}-[0-9]{2}-[0-9]{2}"},
    {"name": "key", "type": "unique", "columns": ["o_orderkey"]},
    {"name": "customer", "type": "foreign_key", "columns": ["o_custkey"], "parent": "customer", "parent_columns": ["c_custkey"]},
]
BROKEN = {
    "filled": "o_orderpriority IS NULL OR trim(o_orderpriority) = ''", "status": "o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O', 'P')", "price": "try_cast(o_totalprice AS DOUBLE) IS NULL OR try_cast(o_totalprice AS DOUBLE) < 0",
    "date": "NOT regexp_full_match(o_orderdate, '[0-9]{4}-[0-9]{2}-[0-9]{2}')", "key": "n > 1", "customer": "o_custkey NOT IN (SELECT c_custkey FROM customer)",
}
COUNTED = "(SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n FROM dirty)"


@query(
    "constraint_report",
    f"WITH {DIRTY} "
    + " UNION ALL ".join((
        _report_row("filled", "o_orderpriority IS NULL OR trim(o_orderpriority) = ''"),
        _report_row("status", "o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O', 'P')"),
        _report_row("price", "try_cast(o_totalprice AS DOUBLE) IS NULL OR try_cast(o_totalprice AS DOUBLE) < 0"),
        _report_row("date", "NOT regexp_full_match(o_orderdate, '[0-9]{4}-[0-9]{2}-[0-9]{2}')"),
        _report_row("key", "n > 1", "(SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n FROM dirty)"),
        _report_row("customer", "o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    )),
)
def constraint_report(spark, d):
    return K.report(dirty(spark, d), RULES, {"customer": table(spark, d, "customer")})


@query("constraint_totals", f"WITH {DIRTY}, r AS (" + " UNION ALL ".join(_report_row(k, c, COUNTED) for k, c in BROKEN.items()) + ") SELECT count(*) FILTER (passed) AS passed_count, count(*) FILTER (NOT passed) AS failed_count, sum(violations)::BIGINT AS violations FROM r")
def constraint_totals(spark, d):
    return K.totals(constraint_report(spark, d))


@query("constraint_examples", f"WITH {DIRTY}, e AS (" + " UNION ALL ".join(f"SELECT '{k}' AS \"constraint\", o_orderkey, o_orderstatus FROM {COUNTED} WHERE {c}" for k, c in BROKEN.items()) + ") SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"constraint\" ORDER BY o_orderkey, o_orderstatus) AS place FROM e) WHERE place <= 3")
def constraint_examples(spark, d):
    return K.report_examples(dirty(spark, d), RULES, ["o_orderkey", "o_orderstatus"], {"customer": table(spark, d, "customer")}, 3)
