"""Gates of result packages: each returns issue rows (path, issue, count); no row means passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.cells import PLACEHOLDERS, is_missing, normal_cell

#: Columns that tell of single patients.
PATIENT_COLUMNS = ("subject_id", "hadm_id", "stay_id", "case_id", "intime", "outtime", "admittime", "dischtime")
SCHEMA = "path string, issue string, count long"


def notes(spark, rows: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def issue(df: DataFrame, path: str, name: str, count: Column) -> DataFrame:
    return df.agg(F.lit(path).alias("path"), F.lit(name).alias("issue"), F.coalesce(count, F.lit(0)).cast("long").alias("count")).where("count > 0")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def says(df: DataFrame, keys: list[str]) -> Column:
    """Whether a row says anything beside its keys, as 0 or 1."""
    cells = [(~F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).isin(*PLACEHOLDERS)).cast("int") for c in df.columns if c not in keys]
    return F.greatest(*cells) if len(cells) > 1 else cells[0] if cells else F.lit(0)


def placeholder_only(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, and whether no cell beside the keys says anything."""
    return df.agg(F.count("*").alias("n_rows"), (F.coalesce(F.max(says(df, keys)), F.lit(0)) == 0).alias("placeholder_only"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows beyond the first of each key, keys in normal form."""
    groups = df.groupBy(*[normal_cell(F.col(k)).alias(k) for k in keys]).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def file_set(spark, expected: dict[str, DataFrame], result: dict[str, DataFrame]) -> DataFrame:
    rows = [(p, "missing_file", 1) for p in sorted(set(expected) - set(result))] + [(p, "unexpected_file", 1) for p in sorted(set(result) - set(expected))]
    rows += [(p, "schema_differs", 1) for p in sorted(set(expected) & set(result)) if expected[p].columns != result[p].columns]
    return notes(spark, rows)


def listed(one: DataFrame, path: str, named: dict[str, Column]) -> DataFrame:
    """Issue rows of a one-row table: those whose count is over 0."""
    rows = F.array(*[F.struct(F.lit(path).alias("path"), F.lit(k).alias("issue"), F.coalesce(v, F.lit(0)).cast("long").alias("count")) for k, v in named.items()])
    return one.select(F.inline(rows)).where("count > 0")


def key_counts(df: DataFrame, key: str, known: DataFrame, said: Column) -> DataFrame:
    """One row from one grouping by key: rows, whether any says something, and unknown, uncovered and repeated keys."""
    mine = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"), F.max(said).alias("said"))
    wanted = known.select(F.col(known.columns[0]).cast("string").alias("k"), F.lit(1).alias("known")).distinct()
    at = mine.join(wanted, "k", "full_outer")
    n, hit = F.col("n"), F.col("known")
    many = lambda c: F.sum(c.cast("long"))
    return at.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"), F.coalesce(F.max("said"), F.lit(0)).alias("said"), many(n.isNotNull() & hit.isNull() & ~is_missing(F.col("k"))).alias("unknown"), many(n.isNull() & hit.isNotNull()).alias("uncovered"), F.sum(n - 1).alias("repeated"))


def key_named(cover: bool, unique: bool) -> dict[str, Column]:
    named = {"unknown_keys": F.col("unknown")}
    if cover:
        named["uncovered_keys"] = F.col("uncovered")
    if unique:
        named["duplicate_keys"] = F.col("repeated")
    return named


def business_gate(expected: dict[str, DataFrame], result: dict[str, DataFrame], keys: dict[str, list[str]], split_keys: DataFrame, key: str, labels_cover: bool = True) -> DataFrame:
    """Files, schemas in order, emptiness, placeholders, split keys, coverage and duplicates of a package; a table is read once for its rows and keys."""
    parts = [file_set(split_keys.sparkSession, expected, result)]
    for path in sorted(set(expected) & set(result)):
        df = result[path]
        said = says(df, keys.get(path, []))
        state = {"empty": (F.col("n_rows") == 0).cast("long"), "placeholder_only": ((F.col("n_rows") > 0) & (F.col("said") == 0)).cast("long")}
        folder = path.split("/")[0]
        if key in df.columns:
            one, more = key_counts(df, key, split_keys, said), key_named(folder == "cohort" or (folder == "csv" and labels_cover), folder in ("cohort", "csv"))
        else:
            one, more = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.max(said), F.lit(0)).alias("said")), {}
        parts.append(listed(one, path, state | more))
        if keys.get(path) and set(keys[path]) <= set(df.columns):
            parts.append(listed(duplicate_keys(df, keys[path]), path, {"duplicate_business_keys": F.col("duplicates")}))
    return union(parts)


def correction_gate(dirty: dict[str, DataFrame], result: dict[str, DataFrame], split_keys: DataFrame, key: str) -> DataFrame:
    """Same files and headers as the dirty input, non-empty stays non-empty, known keys, a covered cohort without repeats."""
    parts = [file_set(split_keys.sparkSession, dirty, result)]
    for path in sorted(set(dirty) & set(result)):
        n = result[path].limit(1).agg(F.count("*").alias("n")).select(F.col("n"), F.lit(1).alias("j"))
        was = dirty[path].limit(1).agg(F.count("*").alias("was")).select("was", F.lit(1).alias("j"))
        parts.append(n.join(was, "j").where("n = 0 and was > 0").select(F.lit(path).alias("path"), F.lit("emptied").alias("issue"), F.lit(1).cast("long").alias("count")))
        if key in result[path].columns:
            cohort = path.startswith("cohort/")
            parts.append(listed(key_counts(result[path], key, split_keys, F.lit(1)), path, key_named(cohort, cohort)))
    return union(parts)


def self_check(tables: dict[str, DataFrame], manifest: dict[str, int], key: str, expected_keys: int) -> DataFrame:
    """Without gold: declared files, missing and repeated keys, row counts, a feature file, and coverage of half the keys."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(p, "declared_but_missing", 1) for p in sorted(set(manifest) - set(tables))] + ([] if any(p.startswith("features/") for p in tables) else [("", "no_feature_file", 1)])
    parts = [notes(spark, rows)]
    for path, df in sorted(tables.items()):
        if path in manifest:
            parts.append(issue(df, path, "row_count_differs", (F.count("*") != manifest[path]).cast("long")))
        if key in df.columns:
            parts.append(issue(df, path, "missing_keys", F.sum(is_missing(F.col(key)).cast("long"))))
            if path.startswith(("cohort/", "csv/")):
                parts.append(issue(df, path, "duplicate_keys", F.count(key) - F.count_distinct(key)))
            parts.append(issue(df, path, "low_coverage", (F.count_distinct(key) < 0.5 * expected_keys).cast("long")))
    return union(parts)


def changed_tables(before: DataFrame, after: DataFrame, targeted: DataFrame) -> DataFrame:
    """(path, issue) from two fingerprint tables (path, digest): what changed, and whether it was meant to."""
    a, b = before.select("path", F.col("digest").alias("da")), after.select("path", F.col("digest").alias("db"))
    changed = a.join(b, "path", "full_outer").where("not (da <=> db)").select("path")
    meant = targeted.select("path", F.lit(True).alias("meant")).distinct()
    return changed.join(meant, "path", "left").select("path", F.when(F.col("meant"), "changed").otherwise("changed_outside_targets").alias("issue"))


def shared_asset(asset: DataFrame, source_digest: str, digest: str, path: str) -> DataFrame:
    """A learned summary holds no patient column and equals its training source."""
    rows = [(path, f"patient_column:{c}", 1) for c in asset.columns if c in PATIENT_COLUMNS]
    if source_digest != digest:
        rows.append((path, "differs_from_source", 1))
    return notes(asset.sparkSession, rows)
