"""Queries of scans, packages and fingerprints.

Files are written from the given tables into the shared scratch folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import events as E
from tablewright.plans.registry import query
from tablewright.sources import warehouse as W
from tablewright.sources import packages as P
from tablewright.sources.lineage import scratch
from tablewright.sources.warehouse import table


def small_package(spark, d):
    return {
        "cohort/orders": table(spark, d, "orders").select(F.col("o_orderkey").alias("stay_id"), "o_orderstatus", (F.col("o_custkey") % 2).alias("label")),
        "features/parts": table(spark, d, "part").select("p_partkey", "p_name", "p_brand"),
        "summary/nations": table(spark, d, "nation"),
    }


@query("scan_csv_strings", "SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name || ', \"' || p_brand || '\"' END AS p_name FROM part")
def scan_csv_strings(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).alias("p_name"))
    path = scratch(spark, "csv")
    p.write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return P.read_strings(spark, path)


@query("scan_structured", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def scan_structured(spark, d):
    path = scratch(spark, "tsv")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.option("header", True).option("sep", "\t").csv(path)
    return P.read_structured(spark, path, "tsv").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice", "o_orderstatus")


@query("scan_json_rows", "SELECT c_custkey, c_name FROM customer")
def scan_json_rows(spark, d):
    path = scratch(spark, "json")  # one object with a list of rows a file
    c = table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 50).alias("g"))
    c.groupBy("g").agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("rows")).write.partitionBy("g").json(path)
    return P.read_json_rows(spark, path)


@query("scan_corrupt_rows", "SELECT count(*) FILTER (p_partkey % 13 = 0) AS corrupt_rows, count(*) AS n_rows FROM part")
def scan_corrupt_rows(spark, d):
    path = scratch(spark, "lines")
    p = table(spark, d, "part")
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_brand"), F.when(F.col("p_partkey") % 13 == 0, "one,too,many"))
    p.select(line).write.text(path)
    rows = P.read_checked(spark, path, ["p_partkey", "p_brand"], header=False)
    return rows.agg(F.count("_corrupt").alias("corrupt_rows"), F.count("p_partkey").alias("n_rows"))


@query("package_inventory")
def package_inventory(spark, d):
    return P.inventory(spark, f"{d}/nation.parquet").unionByName(P.inventory(spark, f"{d}/part.parquet")).select(F.substring_index("path", "/", -1).alias("file"), "length")


@query("source_snapshot")
def source_snapshot(spark, d):
    return P.source_snapshot(spark, f"{d}/orders.parquet")


@query("primary_table", "SELECT 'cohort/orders' AS path, count(*) AS n_rows FROM orders")
def primary_table(spark, d):
    tables = {"cohort/orders": table(spark, d, "orders"), "csv/nation": table(spark, d, "nation"), "features/part": table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.lit(1).alias("x"))}
    name = P.primary(tables)
    return tables[name].agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("path"), "n_rows")


@query("package_manifest", "SELECT 'cohort/orders' AS relative_path, 'cohort' AS role, count(*) AS row_count, 'stay_id,o_orderstatus,label' AS columns FROM orders UNION ALL SELECT 'features/parts', 'feature', count(*), 'p_partkey,p_name,p_brand' FROM part UNION ALL SELECT 'summary/nations', 'feature', count(*), 'n_nationkey,n_name,n_regionkey' FROM nation")
def package_manifest(spark, d):
    root = scratch(spark, "package")
    tables = small_package(spark, d)
    P.assemble(tables, root, {"cohort/orders": "cohort"})
    return P.manifest({p: spark.read.parquet(f"{root}/{p}") for p in tables}, {"cohort/orders": "cohort"})


@query("table_fingerprint")
def table_fingerprint(spark, d):
    return P.fingerprint(small_package(spark, d))


@query("contract_row", "SELECT 'cohort/orders' AS cohort, 'directory' AS kind, 'stay_id' AS key, 'label' AS label_columns, 'o_orderstatus' AS feature_columns, count(*) AS n_rows, count(o_orderkey) AS n_keys FROM orders")
def contract_row(spark, d):
    return P.contract(spark, small_package(spark, d))


@query(
    "stay_products_written",
    W.sql("""c AS (SELECT stay_id, coalesce(dod BETWEEN intime AND outtime, false)::INT AS label FROM stays JOIN patients USING (subject_id)),
  r AS (SELECT DISTINCT stay_id, substr(icd_code, 1, 3) AS root FROM stays JOIN diagnoses USING (hadm_id)),
  b AS (SELECT stay_id, itemid, floor(epoch(charttime - intime) / 86400)::BIGINT AS bucket FROM measures JOIN stays USING (hadm_id) WHERE charttime >= intime AND epoch(charttime - intime) < 2400 * 3600 GROUP BY ALL)
  SELECT 'demo' AS product, count(*) AS n_rows, count(DISTINCT stay_id) AS stays FROM c UNION ALL SELECT 'static', count(*), count(DISTINCT stay_id) FROM r UNION ALL SELECT 'dynamic', count(*), count(DISTINCT stay_id) FROM b"""),
)
def stay_products_written(spark, d):
    """The three products of every stay, written in folders of stays and read back."""
    s = W.stays(spark, d)
    products = {
        "demo": s.join(W.patients(spark, d), "subject_id").select("stay_id", "gender", "anchor_age"),
        "static": E.stay_static(s, W.diagnoses(spark, d).withColumn("root_icd_code", F.substring("icd_code", 1, 3)), "hadm_id"),
        "dynamic": E.bucket_events(W.measures(spark, d), s, "hadm_id", 2400, 24),
    }
    root, rows = scratch(spark, "stays"), []
    for name, df in products.items():
        P.write_by_key(df, f"{root}/{name}", "stay_id", 16)
        rows.append(spark.read.parquet(f"{root}/{name}").agg(F.count("*").alias("n_rows"), F.count_distinct("stay_id").alias("stays")).select(F.lit(name).alias("product"), "n_rows", "stays"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


AFTER = "after_ AS (SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 1009 <> 3 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 1013 = 7)"
BEFORE = "before_ AS (SELECT o_orderkey, o_orderstatus FROM orders)"


def versions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changed = F.when(F.col("o_orderkey") % 997 == 5, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    return o, o.where("o_orderkey % 1009 <> 3").select("o_orderkey", changed).unionAll(o.where("o_orderkey % 1013 = 7"))


@query(
    "fingerprint_leaves",
    f"""WITH {BEFORE}, {AFTER}, r AS (SELECT o_orderkey, o_orderstatus, sum(b) AS b, sum(a) AS a FROM (SELECT *, 1 AS b, 0 AS a FROM before_ UNION ALL SELECT *, 0, 1 FROM after_) GROUP BY ALL)
  SELECT substr(md5(o_orderkey::VARCHAR), 1, 3) AS leaf, sum(b)::BIGINT AS rows_before, sum(a)::BIGINT AS rows_after FROM r GROUP BY 1 HAVING count(*) FILTER (a <> b) > 0""",
)
def fingerprint_leaves(spark, d):
    before, after = versions(spark, d)
    return P.changed_leaves(P.leaves(before, ["o_orderkey"]), P.leaves(after, ["o_orderkey"]))


@query(
    "fingerprint_located",
    f"""WITH {BEFORE}, {AFTER}, r AS (SELECT o_orderkey, o_orderstatus, sum(n) AS n FROM (SELECT *, 1 AS n FROM before_ UNION ALL SELECT *, -1 FROM after_) GROUP BY ALL HAVING sum(n) <> 0)
  SELECT o_orderkey, sum(greatest(n, 0))::BIGINT AS gone, sum(greatest(-n, 0))::BIGINT AS come FROM r GROUP BY 1""",
)
def fingerprint_located(spark, d):
    before, after = versions(spark, d)
    return P.changed_keys(before, after, ["o_orderkey"], P.changed_leaves(P.leaves(before, ["o_orderkey"]), P.leaves(after, ["o_orderkey"])))


@query("sink_csv", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority || ', \"' || o_orderstatus || '\"' AS o_orderpriority FROM orders")
def sink_csv(spark, d):
    """Written as gzipped csv and read back as texts."""
    path = scratch(spark, "sink")
    P.write_csv(table(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("o_orderpriority")), path)
    return P.read_strings(spark, path)


@query("scan_optional", "SELECT 'parts.csv' AS name, 'p_partkey,p_brand' AS columns, count(*) AS n_rows, count(DISTINCT p_brand) AS brands FROM part UNION ALL SELECT 'absent.csv', NULL, 0, 0")
def scan_optional(spark, d):
    """A root found below the one given, a table cut to those of the wanted columns it has, and one that is not there."""
    root, rows = scratch(spark, "root"), []
    P.write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), f"{root}/3.1/hosp/parts.csv")
    found = P.resolve_root(spark, root)
    for name in ("parts.csv", "absent.csv"):
        df = P.read_optional(spark, f"{found}/hosp", name, ["p_partkey", "p_brand", "p_unknown"])
        if df is None:
            df = table(spark, d, "part").limit(0).select("p_brand")
            columns = F.lit(None).cast("string")
        else:
            columns = F.lit(",".join(df.columns))
        rows.append(df.agg(F.count("*").alias("n_rows"), F.count_distinct("p_brand").alias("brands")).select(F.lit(name).alias("name"), columns.alias("columns"), "n_rows", "brands"))
    return rows[0].unionByName(rows[1])


@query(
    "discovered_package",
    """SELECT 'cohort/orders' AS path, 'cohort' AS role, true AS is_primary, count(*) AS n_rows FROM orders UNION ALL SELECT 'features/parts', 'feature', false, count(*) FROM part UNION ALL SELECT 'summary/nations', 'summary', false, count(*) FROM nation""",
)
def discovered_package(spark, d):
    """A package written, found again by its folders, and each table's rows counted."""
    root, tables = scratch(spark, "package"), small_package(spark, d)
    P.assemble(tables, root, {})
    found, rows = P.discover(spark, root, "stay_id", ["label"]), []
    for path in sorted(tables):
        rows.append(P.read_structured(spark, f"{root}/{path}", "parquet").agg(F.count("*").alias("n_rows")).select(F.lit(path).alias("path"), "n_rows"))
    return found.join(rows[0].unionByName(rows[1]).unionByName(rows[2]), "path").select("path", "role", "is_primary", "n_rows")
