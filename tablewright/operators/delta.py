"""Differences of two tables: by key, by group, as multisets, and with tolerance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.sources.lineage import cut, numbered


def same_keys(keys: list[str], left: str = "a", right: str = "b") -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def shared_columns(before: DataFrame, after: DataFrame, keys: list[str] = ()) -> list[str]:
    return [c for c in before.columns if c in after.columns and c not in keys]


def paired(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer pairs of rows with the same key; _in_a and _in_b tell which sides are there."""
    a, b = before.withColumn("_in_a", F.lit(True)).alias("a"), after.withColumn("_in_b", F.lit(True)).alias("b")
    return a.join(b, same_keys(keys), "full_outer")


def differs(column: str) -> Column:
    return ~F.col(f"a.{column}").eqNullSafe(F.col(f"b.{column}"))


def keyed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: inserted, deleted and changed rows, changed cells, for keys that occur once on each side."""
    columns = shared_columns(before, after, keys)
    both = F.col("_in_a") & F.col("_in_b")
    cells = sum((F.when(both & differs(c), 1).otherwise(0) for c in columns), F.lit(0))
    p = paired(before, after, keys).select(F.col("_in_a"), F.col("_in_b"), cells.alias("n"))
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return p.agg(total(F.col("_in_a").isNull()).alias("inserted_rows"), total(F.col("_in_b").isNull()).alias("deleted_rows"), total(F.col("n") > 0).alias("changed_rows"), total(F.col("n")).alias("changed_cells"))


def by_column(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    columns = shared_columns(before, after, keys)
    both = F.col("_in_a") & F.col("_in_b")
    each = [F.struct(F.lit(c).alias("column"), F.coalesce(F.sum((both & differs(c)).cast("long")), F.lit(0)).alias("changed_cells")) for c in columns]
    return paired(before, after, keys).agg(F.array(*each).alias("r")).select(F.inline("r"))


def examples(before: DataFrame, after: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    """Keys and changed cells with both values, the first so many by key."""
    columns = shared_columns(before, after, keys)
    cells = F.array_compact(F.array(*[F.when(differs(c), F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("before"), F.col(f"b.{c}").cast("string").alias("after"))) for c in columns]))
    p = paired(before, after, keys).where("_in_a and _in_b").select(*[F.col(f"a.{k}").alias(k) for k in keys], F.inline(cells))
    return p.orderBy(*keys, "column").limit(limit)


def row_counts(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Each distinct row and how often it stands on either side: one shuffle for both."""
    tagged = before.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(after.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return tagged.groupBy(*columns).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))


def duplicate_groups(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """For keys that repeat on a side: groups, and rows inserted and deleted as multisets inside the group.

    Where the two sides differ in their columns every group is ambiguous.
    """
    columns = keys + shared_columns(before, after, keys)
    rows = row_counts(before, after, columns)
    groups = rows.groupBy(*keys).agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b"), F.sum(F.greatest(F.col("n_b") - F.col("n_a"), F.lit(0))).alias("inserted"), F.sum(F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0))).alias("deleted"))
    groups = groups.where("a > 1 or b > 1")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    changed = F.lit(1) if set(before.columns) != set(after.columns) else (F.col("inserted") + F.col("deleted") > 0).cast("long")
    return groups.agg(F.count("*").alias("duplicate_groups"), total(changed).alias("ambiguous_groups"), total(F.col("inserted")).alias("inserted_rows"), total(F.col("deleted")).alias("deleted_rows"))


def multiset(before: DataFrame, after: DataFrame) -> DataFrame:
    rows = row_counts(before, after, shared_columns(before, after))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(total(F.greatest(F.col("n_b") - F.col("n_a"), F.lit(0))).alias("inserted_rows"), total(F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0))).alias("deleted_rows"))


def schema_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(place, column, change, cells): columns added and removed, in their order, and how many filled cells come or go with each."""

    def side(df: DataFrame, other: DataFrame, change: str) -> DataFrame:
        own = [F.struct(F.lit(i).cast("long").alias("place"), F.lit(c).alias("column"), F.lit(change).alias("change"), F.count(c).alias("cells")) for i, c in enumerate(df.columns) if c not in other.columns]
        rows = F.array(*own).cast("array<struct<place:bigint,column:string,change:string,cells:bigint>>")
        return df.agg(rows.alias("r")).select(F.inline("r"))

    return side(before, after, "removed").unionByName(side(after, before, "added"))


def package(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Multiset deltas of all the tables of two packages; a table on one side only counts as inserted or deleted."""
    parts = []
    for path in sorted({*before, *after}):
        a, b = before.get(path), after.get(path)
        kind = "inserted_file" if a is None else "deleted_file" if b is None else "compared"
        if kind == "compared":
            row = multiset(a, b)
        else:
            one = (b if a is None else a).agg(F.count("*").alias("n"))
            row = one.select(F.col("n").alias("inserted_rows") if a is None else F.lit(0).cast("long").alias("inserted_rows"), F.col("n").alias("deleted_rows") if b is None else F.lit(0).cast("long").alias("deleted_rows"))
        parts.append(row.select(F.lit(path).alias("path"), F.lit(kind).alias("status"), "inserted_rows", "deleted_rows"))
    return reduce(DataFrame.unionByName, parts)


def plain(c: Column) -> Column:
    """Empty texts alike: null and the spellings of missing become ''."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.isin("nan", "None", "NaT"), "").otherwise(t)


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """One row a shared column: compared and unequal cells, for rows aligned by key and place within the key.

    Keys that occur once are aligned by a join alone.  Rows of a repeated key are aligned in the order of their
    other columns; a row's place in its key is its place in a global sort less that of the key's first row.
    """
    columns = shared_columns(expected, actual)
    normal = {tag: df.select(*[plain(F.col(c)).alias(c) for c in columns]) for tag, df in (("a", expected), ("b", actual))}
    again = None
    if keys:
        often = lambda df: df.groupBy(*keys).agg(F.count("*").alias("_c")).where("_c > 1").select(*keys)
        again = cut(often(normal["a"]).unionAll(often(normal["b"])).distinct())
        again = None if again.isEmpty() else again

    def places(df: DataFrame) -> DataFrame:
        at = numbered(df, [*keys, *[c for c in columns if c not in keys]])
        if keys:
            first = at.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_i").alias("_first"))
            at = at.join(first, reduce(lambda x, y: x & y, (F.col(k) == F.col(f"_{k}") for k in keys)))
        else:
            at = at.withColumn("_first", F.lit(0))
        return at.select(*columns, (F.col("_i") - F.col("_first")).cast("long").alias("_n"))

    def side(tag: str) -> DataFrame:
        df, first = normal[tag], F.lit(0).cast("long").alias("_n")
        if not keys:
            at = places(df)
        elif again is None:
            at = df.select(*columns, first)
        else:
            at = df.join(again, keys, "left_anti").select(*columns, first).unionByName(places(df.join(again, keys, "left_semi").select(*columns)))
        return at.withColumn(f"_{tag}", F.lit(True)).alias(tag)

    p = side("a").join(side("b"), same_keys([*keys, "_n"]), "full_outer")

    def unequal(c: str) -> Column:
        x, y = F.col(f"a.{c}").try_cast("double"), F.col(f"b.{c}").try_cast("double")
        near = F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        return F.col("_a") & F.col("_b") & ~(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) | near)

    both = F.sum((F.col("_a") & F.col("_b")).cast("long"))
    total = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    rows = [F.struct(F.lit(c).alias("column"), total(both).alias("compared"), total(F.sum(unequal(c).cast("long"))).alias("unequal")) for c in columns]
    missing, extra = total(F.sum(F.col("_b").isNull().cast("long"))), total(F.sum(F.col("_a").isNull().cast("long")))
    out = p.agg(F.array(*rows).alias("r"), missing.alias("missing_rows"), extra.alias("extra_rows"))
    out = out.select(F.inline("r"), "missing_rows", "extra_rows")
    return out.withColumn("match_rate", F.round(1 - F.col("unequal") / F.greatest(F.col("compared"), F.lit(1)), 6))


def compare_packages(expected: dict[str, DataFrame], actual: dict[str, DataFrame], keys: dict[str, list[str]], tolerance: float = 0.0) -> DataFrame:
    """compare() over the shared paths, and a row for each path on one side only."""
    schema = "path string, status string, column string, compared long, unequal long, missing_rows long, extra_rows long, match_rate double"
    spark = next(iter(expected.values())).sparkSession
    alone = [(p, "missing" if p in expected else "extra", None, 0, 0, 0, 0, 0.0) for p in sorted({*expected} ^ {*actual})]
    parts = [spark.createDataFrame(alone, schema)] if alone else []
    for path in sorted({*expected} & {*actual}):
        parts.append(compare(expected[path], actual[path], keys[path], tolerance).select(F.lit(path).alias("path"), F.lit("compared").alias("status"), "column", "compared", "unequal", "missing_rows", "extra_rows", "match_rate"))
    return reduce(DataFrame.unionByName, parts)
