"""Packages of tables: inventory, fingerprints, manifests, contracts, and delimited or JSON files."""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.cohort import KEY_ORDER

IGNORED = ("manifest.json", "metadata.json")
SEPARATORS = {"csv": ",", "tsv": "\t"}


def suffix(path: str) -> str:
    return path.lower().removesuffix(".gz").rsplit(".", 1)[-1]


#: Where the tables may lie under a given root, first match first.
ROOTS = ("", "mimiciv/3.1", "3.1", "raw_mimic")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def resolve_root(spark: SparkSession, root: str, marker: str = "hosp") -> str:
    """The first of the known places under root that holds the marker folder."""
    for sub in ROOTS:
        at = f"{root}/{sub}".rstrip("/")
        if exists(spark, f"{at}/{marker}"):
            return at
    raise ValueError(f"no folder {marker} under {root}")


def table_path(spark: SparkSession, root: str, name: str) -> str | None:
    """root/name as it is or with .gz behind, or None."""
    return next((p for p in (f"{root}/{name}", f"{root}/{name}.gz") if exists(spark, p)), None)


def read_optional(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame | None:
    """A delimited table as texts with those of the wanted columns that it has, or None where it is absent."""
    path = table_path(spark, root, name)
    if path is None:
        return None
    df = read_strings(spark, path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A structured file, or None where it has no readable header or schema; scoring gives None zero."""
    from pyspark.errors import AnalysisException
    from py4j.protocol import Py4JJavaError

    try:
        df = read_structured(spark, path)
        return df if df.columns else None
    except (AnalysisException, Py4JJavaError):
        return None


def open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line of a delimited file ends inside a quoted cell, so that records span lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header, every column as text; .gz is read as it is.

    A file is one task's only if its records span lines; else it is read in splits.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", open_quotes(spark, path)).csv(path)


def read_structured(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A csv, tsv, parquet, json or jsonl file with inferred types; a name without a suffix is a table that assemble() wrote."""
    kind = kind or (suffix(path) if "." in path.rsplit("/", 1)[-1] else "parquet")
    if kind in SEPARATORS:
        return spark.read.option("header", True).option("inferSchema", True).option("sep", SEPARATORS[kind]).option("escape", '"').csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "json":
        return read_json_rows(spark, path)
    raise ValueError(f"unknown kind of file: {kind}")


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, an object with a list of rows, or one object as one row."""
    df = spark.read.option("multiLine", True).json(path)
    if "rows" in df.columns and dict(df.dtypes)["rows"].startswith("array<struct"):
        return df.select(F.inline("rows"))
    return df


def read_checked(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """Texts of the named columns, and in _corrupt the lines that do not fit them; lines are parsed whole to tell."""
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_corrupt"])
    reader = spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", False).csv(path)


def read_guarded(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """read_checked(), but a line with more cells than columns is refused, with its file and line."""
    df = read_checked(spark, path, columns, sep, header)
    cells = F.size(F.split(F.regexp_replace("_corrupt", '"([^"]|"")*"', ""), re.escape(sep)))
    over = df.where(F.col("_corrupt").isNotNull() & (cells > len(columns))).first()
    if over is None:
        return df
    # lines of a file are in order within a block, and blocks by their start
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"))
    first = lines.where(F.col("value") == over["_corrupt"]).groupBy("file").agg(F.min("at").alias("at")).orderBy("file").first()
    before = F.struct(F.lit(first["at"]["block"]).cast("long").alias("block"), F.lit(first["at"]["id"]).cast("long").alias("id"))
    line = lines.where((F.col("file") == first["file"]) & (F.col("at") <= before)).count()
    raise ValueError(f"{first['file']}, line {line}: more than {len(columns)} cells")


def write_csv(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.option("header", True).option("escape", '"').option("compression", "gzip" if gzip else "none").mode("errorifexists").csv(path)


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)).cast("int")


def write_by_key(df: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """df in folders of keys by digest, sorted by the key within files, so that one key's rows lie in one folder.

    Rows of a folder are dealt over files by their key, so a folder is not one task's however large it is.
    """
    at = df.withColumn("part", part_of(F.col(key), parts))
    at.repartition("part", F.xxhash64(key) % 8).sortWithinPartitions("part", key).write.partitionBy("part").mode("errorifexists").parquet(path)


def read_key(spark: SparkSession, path: str, key: str, value, parts: int = 64) -> DataFrame:
    """The rows of one key of a table that write_by_key() wrote with as many parts: one folder is read, and of it the row groups that may hold the key."""
    part = zlib.crc32(str(value).encode()) % parts
    return spark.read.parquet(path).where((F.col("part") == part) & (F.col(key) == value)).drop("part")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of all files under a root but its manifests; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.where(~F.substring_index("path", "/", -1).isin(*IGNORED))


def source_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """One digest over names, sizes and times of the files under a root."""
    rows = inventory(spark, root).select(F.xxhash64(F.substring_index("path", "/", -2), "length", "modificationTime").cast("decimal(38,0)").alias("h"), "length")
    return rows.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sum("h").cast("string").alias("digest"))


def table_digest(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest of them: sums of two row hashes, so that nothing is sorted or gathered."""
    text = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in sorted(df.columns)]))
    return df.select(F.xxhash64(text).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(7), text).cast("decimal(38,0)").alias("b")).agg(F.count("*").alias("n_rows"), F.sum("a").cast("string").alias("a"), F.sum("b").cast("string").alias("b"))


def fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [table_digest(df).select(F.lit(path).alias("path"), "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), "a", "b"), 256).alias("digest")) for path, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, rows)


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path under the root, length, sha256 of its bytes) of every file but manifests; a file of up to 2 GB is one row of one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = files.where(~F.substring_index("path", "/", -1).isin(*IGNORED))
    return kept.select(F.regexp_replace("path", f"^.*{re.escape(root.rstrip('/'))}/", "").alias("path"), "length", F.sha2("content", 256).alias("sha256"))


#: Hex digits of a key's digest that name its leaf: 16 ** LEAF leaves at most, whatever the table.
LEAF = 3


def leaf_of(keys: list[str]) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys])), 1, LEAF)


def leaves(df: DataFrame, keys: list[str]) -> DataFrame:
    """(leaf, n_rows, a, b): an order-free digest of the rows of each leaf; digests of wider ranges are sums of these.

    The 16 ** LEAF rows are a table's fingerprint: kept, they tell later which leaves changed without the old rows.
    """
    text = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in sorted(df.columns)]))
    at = df.select(leaf_of(keys).alias("leaf"), F.xxhash64(text).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(7), text).cast("decimal(38,0)").alias("b"))
    return at.groupBy("leaf").agg(F.count("*").alias("n_rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def changed_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(leaf, rows_before, rows_after) of the leaves in which two fingerprints differ."""
    x, y = before.alias("x"), after.alias("y")
    same = F.col("x.n_rows").eqNullSafe(F.col("y.n_rows")) & F.col("x.a").eqNullSafe(F.col("y.a")) & F.col("x.b").eqNullSafe(F.col("y.b"))
    rows = lambda side: F.coalesce(F.col(f"{side}.n_rows"), F.lit(0)).cast("long")
    return x.join(y, F.col("x.leaf") == F.col("y.leaf"), "full_outer").where(~same).select(F.coalesce("x.leaf", "y.leaf").alias("leaf"), rows("x").alias("rows_before"), rows("y").alias("rows_after"))


def changed_keys(before: DataFrame, after: DataFrame, keys: list[str], changed: DataFrame) -> DataFrame:
    """Keys and rows gone and come (gone, come) of what differs, looked for in the changed leaves only."""
    names = F.broadcast(changed.select("leaf"))  # 16 ** LEAF rows at most
    columns = [c for c in before.columns if c in after.columns]
    side = lambda df, n: df.select(*columns, leaf_of(keys).alias("leaf")).join(names, "leaf", "left_semi").select(*columns, F.lit(n).alias("_n"))
    rows = side(before, 1).unionAll(side(after, -1)).groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return rows.groupBy(*keys).agg(F.sum(F.greatest("_n", F.lit(0))).cast("long").alias("gone"), F.sum(F.greatest(-F.col("_n"), F.lit(0))).cast("long").alias("come"))


def fingerprint_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select("path", F.col("digest").alias("da")), after.select("path", F.col("digest").alias("db"))
    status = F.when(F.col("da").isNull(), "extra").when(F.col("db").isNull(), "missing").otherwise("mismatched")
    return a.join(b, "path", "full_outer").where("not (da <=> db)").select("path", status.alias("status"))


def manifest(tables: dict[str, DataFrame], roles: dict[str, str]) -> DataFrame:
    """(relative_path, role, row_count, columns) of a package; a path that leaves its root is refused."""
    for path in tables:
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError(f"path leaves the package: {path}")
    rows = [df.agg(F.count("*").alias("row_count")).select(F.lit(p).alias("relative_path"), F.lit(roles.get(p, "feature")).alias("role"), "row_count", F.lit(",".join(df.columns)).alias("columns")) for p, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, rows)


def assemble(tables: dict[str, DataFrame], root: str, roles: dict[str, str]) -> DataFrame:
    """Writes each table at its place under the root and returns the manifest."""
    out = manifest(tables, roles)
    for path, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{path}")
    return out


def discover(spark: SparkSession, root: str, key: str, labels: list[str]) -> DataFrame:
    """(path, role, is_primary) of a package: as its metadata.json tells ({"tables": [{"path", "role"}, ...]}), else by folders.

    The primary table is the first one of the cohort, by path, that has the key and the label columns.
    """
    if exists(spark, f"{root}/metadata.json"):
        told = spark.read.option("multiLine", True).schema("tables array<struct<path:string,role:string>>").json(f"{root}/metadata.json").select(F.inline("tables"))
    else:
        place = F.regexp_extract("path", r"((?:cohort|features|csv|summary)/[^/]+)(?:/[^/]*)?$", 1)
        told = inventory(spark, root).select(place.alias("path")).where("path <> ''").distinct()
        told = told.withColumn("role", F.when(F.col("path").startswith("features/"), "feature").otherwise(F.substring_index("path", "/", 1)))
    cohorts = [r.path for r in told.where("role = 'cohort'").orderBy("path").collect()]  # files of one folder
    wanted = {key, *labels}
    chosen = next((p for p in cohorts if (df := read_or_none(spark, f"{root}/{p}")) is not None and wanted <= set(df.columns)), None)
    return told.withColumn("is_primary", F.col("path").eqNullSafe(F.lit(chosen)))


def primary(tables: dict[str, DataFrame]) -> str:
    """The widest table: most columns, then most rows, then the first name."""
    most = max(len(df.columns) for df in tables.values())
    wide = {p: df for p, df in tables.items() if len(df.columns) == most}
    return min(wide, key=lambda p: (-wide[p].count(), p)) if len(wide) > 1 else next(iter(wide))


def contract(spark: SparkSession, tables: dict[str, DataFrame], labels=("label", "outcome", "target")) -> DataFrame:
    """One row: key, kind of layout, feature and label columns of the first cohort table, and its rows and filled keys."""
    kind = "single" if len(tables) == 1 else "directory" if any(p.startswith("features/") for p in tables) else "wide"
    cohort = next((p for p in sorted(tables) if p.startswith("cohort/")), sorted(tables)[0])
    columns = tables[cohort].columns
    key = next((k for k in ("stay_id", "hadm_id", "subject_id", *KEY_ORDER) if k in columns), None)
    own = [c for c in columns if c in labels]
    told = {"cohort": cohort, "kind": kind, "key": key, "label_columns": ",".join(own), "feature_columns": ",".join(c for c in columns if c not in own and c != key)}
    one = tables[cohort].agg(F.count("*").alias("n_rows"), (F.count(key) if key else F.lit(0).cast("long")).alias("n_keys"))
    return one.select(*[F.lit(v).cast("string").alias(k) for k, v in told.items()], "n_rows", "n_keys")
