"""Repair rules and the evaluation of repairs.

Rules repair only where the evidence is unique and otherwise keep the value.  Repairs
are scored by multisets of row hashes of the clean, dirty and repaired packages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """Hash of a row as canonical JSON: sorted names, every value as text, null as ''."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)])), 256)


def multiset(clean: dict[str, DataFrame], dirty: dict[str, DataFrame], result: dict[str, DataFrame]) -> DataFrame:
    """(path, hash, clean, dirty, result): how often each row stands in the three packages; equal tables and headers are required."""
    if not set(clean) == set(dirty) == set(result):
        raise ValueError("the packages hold different tables")
    parts = []
    for path in sorted(clean):
        columns = clean[path].columns
        if not columns == dirty[path].columns == result[path].columns:
            raise ValueError(f"headers of {path} differ")
        for side, df in (("clean", clean[path]), ("dirty", dirty[path]), ("result", result[path])):
            parts.append(df.select(F.lit(path).alias("path"), row_hash(columns).alias("hash"), *[F.lit(int(side == s)).alias(s) for s in ("clean", "dirty", "result")]))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("path", "hash").agg(*[F.sum(s).alias(s) for s in ("clean", "dirty", "result")])


def status(log: DataFrame, rows: DataFrame) -> DataFrame:
    """log (path, clean_hash or null for inserted rows, dirty_hash) with status exact, missed or incorrect."""
    side = lambda tag: rows.select(F.col("path").alias(f"{tag}_path"), F.col("hash").alias(f"{tag}_key"), *[F.col(s).alias(f"{tag}_{s}") for s in ("clean", "dirty", "result")])
    at = log.join(side("c"), (F.col("path") == F.col("c_path")) & (F.col("clean_hash") == F.col("c_key")), "left").join(side("d"), (F.col("path") == F.col("d_path")) & (F.col("dirty_hash") == F.col("d_key")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    inserted = F.col("clean_hash").isNull()
    like = lambda s: (n("d_result") == n(f"d_{s}")) & (inserted | (n("c_result") == n(f"c_{s}")))
    out = at.withColumn("status", F.when(like("clean"), "exact").when(like("dirty"), "missed").otherwise("incorrect"))
    return out.select(*log.columns, "status")


def metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Totals, recall and deletion rate of inserted rows, for all errors or by class and subtype; a share of nothing is 1."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = lambda name: F.col("status") == name
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(F.round(a / F.greatest(b, F.lit(1)), 6))
    inserted = F.col("clean_hash").isNull()
    frame = scored.groupBy(*by) if by else scored.groupBy()
    return frame.agg(F.count("*").alias("errors"), n(s("exact")).alias("exact"), n(s("missed")).alias("missed"), n(s("incorrect")).alias("incorrect"), share(n(s("exact")), F.count("*")).alias("recall"), share(n(inserted & s("exact")), n(inserted)).alias("inserted_deletion_rate"))


def preservation(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Unaffected clean rows kept and lost, invented rows, and the collateral total; of no rows all are kept."""
    affected = log.where("clean_hash is not null").select("path", F.col("clean_hash").alias("hash")).distinct().withColumn("hit", F.lit(True))
    at = rows.join(affected, ["path", "hash"], "left").withColumn("free", F.col("hit").isNull())
    t = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    free = lambda c: t(F.when(F.col("free"), c))
    out = at.agg(free(F.col("clean")).alias("unaffected"), free(F.least("clean", "result")).alias("kept"), free(F.greatest(F.col("clean") - F.col("result"), F.lit(0))).alias("lost"), t(F.greatest(F.col("result") - F.greatest("clean", "dirty"), F.lit(0))).alias("invented"))
    return out.withColumn("collateral", F.col("lost") + F.col("invented")).withColumn("preservation_rate", F.when(F.col("unaffected") == 0, 1.0).otherwise(F.round(F.col("kept") / F.greatest(F.col("unaffected"), F.lit(1)), 6)))


def quality(scored: DataFrame, kept: DataFrame) -> DataFrame:
    """Precision, recall and F1; both inputs are reduced to one row."""
    a = metrics(scored).select("errors", "exact", "incorrect", "recall", F.lit(1).alias("j"))
    b = kept.select("collateral", F.lit(1).alias("j"))
    out = a.join(b, "j").drop("j").withColumn("precision", F.round(F.col("exact") / F.greatest(F.col("exact") + F.col("incorrect") + F.col("collateral"), F.lit(1)), 6))
    return out.withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), 6))


def learn_values(dirty: DataFrame, clean: DataFrame, key: str, columns: list[str], support: int = 3) -> DataFrame:
    """(column, dirty, clean, n): values that always become one other value, seen often enough, and never the other way round."""
    pairs = dirty.alias("d").join(clean.alias("c"), F.col(f"d.{key}") == F.col(f"c.{key}"))
    cells = pairs.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d.{c}").cast("string").alias("dirty"), F.col(f"c.{c}").cast("string").alias("clean")) for c in columns])))
    counts = cells.groupBy("column", "dirty", "clean").agg(F.count("*").alias("n"))
    one = counts.groupBy("column", "dirty").agg(F.count("*").alias("ways"), F.max("clean").alias("clean"), F.max("n").alias("n")).where("ways = 1 and dirty <> clean").select("column", "dirty", "clean", "n").where(F.col("n") >= support)
    back = one.select("column", F.col("clean").alias("dirty"), F.col("dirty").alias("clean"))
    return one.join(back, ["column", "dirty", "clean"], "left_anti")


def apply_values(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    own = mapping.where(F.col("column") == column).select(F.col("dirty").alias("_from"), F.col("clean").alias("_to"))
    return df.join(own, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).select(*df.columns)


def mapping_check(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """One row: rows, cells changed, and rows beyond the first of equal ones before and after a mapping is applied."""
    new = apply_values(df, mapping, column)
    spare = lambda d: F.count("*") - F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(c) for c in d.columns]))
    before, after = df.agg(F.count("*").alias("n_rows"), spare(df).alias("duplicates_before")), new.agg(spare(new).alias("duplicates_after"))
    changed = df.join(mapping.where(F.col("column") == column).select(F.col("dirty").alias(column)), column, "left_semi").agg(F.count("*").alias("changed"))
    rows = [d.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in d.columns]))) for d in (before, after, changed)]
    pick = lambda c: F.max(F.when(F.col("name") == c, F.col("n"))).alias(c)
    return reduce(DataFrame.unionByName, rows).agg(*map(pick, ("n_rows", "changed", "duplicates_before", "duplicates_after")))


def nullify(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Cells that provably violate a rule become null; rare but valid ones stay."""
    return df.select(*[F.when(~F.coalesce(rules[c], F.lit(False)), F.col(c)).alias(c) if c in rules else F.col(c) for c in df.columns])


def exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def restore_parent(df: DataFrame, column: str, by: str, parent: DataFrame, parent_key: str, parent_by: str) -> DataFrame:
    """A key with no parent is restored where another column determines exactly one parent."""
    known = parent.select(F.col(parent_key).alias("_known")).distinct()
    only = parent.groupBy(F.col(parent_by).alias("_by")).agg(F.count_distinct(parent_key).alias("_n"), F.min(parent_key).alias("_key")).where("_n = 1").drop("_n")
    at = df.join(known, F.col(column) == F.col("_known"), "left").join(only, F.col(by) == F.col("_by"), "left")
    return at.withColumn(column, F.when(F.col("_known").isNull() & F.col("_key").isNotNull(), F.col("_key")).otherwise(F.col(column))).select(*df.columns)


def drop_orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return df.join(parent.select(F.col(parent_key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_semi")


def join_cardinality(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(children, parents, keys): how many keys match so many rows to so many."""
    a = df.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("children"))
    b = parent.groupBy(F.col(parent_key).alias("k")).agg(F.count("*").alias("parents"))
    both = a.join(b, "k", "full_outer").select(F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("parents", F.lit(0)).alias("parents"))
    return both.groupBy("children", "parents").agg(F.count("*").alias("keys"))


def inside_window(events: DataFrame, entities: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """Events inside their entity's visible window."""
    at = events.join(entities.select(key, F.col(start).alias("_a"), F.col(end).alias("_b")), key)
    return at.where(F.col(time).between(F.col("_a"), F.col("_b"))).select(*events.columns)


def leakage_probe(events: DataFrame, labels: DataFrame, key: str, item: str, value: str, support: int = 20) -> DataFrame:
    """(item, n, labels): items whose value follows from the label: one value a label, different ones across labels."""
    pairs = events.join(labels.select(key, "label"), key).groupBy(item, "label", value).agg(F.count("*").alias("n"))
    per = pairs.groupBy(item, "label").agg(F.count("*").alias("ways"), F.max(value).alias("v"), F.sum("n").alias("n"))
    out = per.groupBy(item).agg(F.max("ways").alias("ways"), F.count("*").alias("labels"), F.count_distinct("v").alias("values"), F.sum("n").alias("n"))
    return out.where((F.col("ways") == 1) & (F.col("labels") > 1) & (F.col("values") == F.col("labels")) & (F.col("n") >= support)).select(item, "n", "labels")
