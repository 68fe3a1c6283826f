"""Profiles of columns, groups and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.cells import format_pattern, is_missing, rate
from tablewright.sources.lineage import cut

#: Texts of a boolean column.
BOOLEANS = ("true", "false", "0", "1", "yes", "no")


def long_cells(df: DataFrame, columns: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """(keep..., column, value as text): one row a cell, from one pass over the table."""
    columns = columns or [c for c in df.columns if c not in keep]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def is_number(v: Column) -> Column:
    return v.try_cast("double").isNotNull()


def is_time(v: Column) -> Column:
    return v.rlike("[-/:T]") & v.try_cast("timestamp").isNotNull()


def logical_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """numeric, datetime, boolean, string or empty for each column, by the shares of values that parse."""
    cells = long_cells(df, columns).withColumn("present", ~is_missing(F.col("value")))
    v = F.trim("value")
    some = lambda test: F.sum((F.col("present") & test).cast("long"))
    out = cells.groupBy("column").agg(F.sum(F.col("present").cast("long")).alias("n"), some(is_number(v)).alias("numbers"), some(is_time(v)).alias("times"), some(F.lower(v).isin(*BOOLEANS)).alias("booleans"))
    kind = F.when(F.col("n") == 0, "empty").when(F.col("numbers") >= 0.95 * F.col("n"), "numeric").when(F.col("times") >= 0.95 * F.col("n"), "datetime").when(F.col("booleans") == F.col("n"), "boolean").otherwise("string")
    return out.select("column", "n", kind.alias("logical_type"))


def quantiles(df: DataFrame, by: list[str], x: str, shares: tuple[float, ...], weight: Column | None = None) -> DataFrame:
    """by and q (an array): exact quantiles of x in each group, linear between neighbours; weight: how often a row counts.

    Equal values are counted first; the counts are range-sorted once, places are summed inside
    ranges and ranges are added up, so that no task holds a group and no map its values.
    """
    group = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(by)]))
    counts = df.where(F.col(x).isNotNull()).groupBy(group.alias("_g"), F.col(x).cast("double").alias("_x")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_c"))
    ranged = cut(counts.repartitionByRange("_g", "_x").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p", "_g").agg(F.sum("_c").alias("_s"))  # a row for each range and group in it
    sizes = sizes.withColumn("_before", F.sum("_s").over(Window.partitionBy("_g").orderBy("_p")) - F.col("_s")).withColumn("_n", F.sum("_s").over(Window.partitionBy("_g"))).drop("_s")
    inside = F.sum("_c").over(Window.partitionBy("_p", "_g").orderBy("_x")) - F.col("_c")
    at = ranged.withColumn("_lo", inside).join(sizes, ["_p", "_g"]).withColumn("_lo", F.col("_lo") + F.col("_before"))
    place = lambda s: (F.col("_n") - 1) * F.lit(float(s))
    value = lambda k: F.max(F.when((F.col("_lo") <= k) & (k < F.col("_lo") + F.col("_c")), F.col("_x")))
    ends = [v.alias(f"{e}{i}") for i, s in enumerate(shares) for e, v in (("a", value(F.floor(place(s)))), ("b", value(F.ceil(place(s)))))]
    found = at.groupBy("_g").agg(F.first("_n").alias("_n"), *ends)
    q = [F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (place(s) - F.floor(place(s))) for i, s in enumerate(shares)]
    return df.select(*by, group.alias("_g")).distinct().join(found.select("_g", F.array(*q).alias("q")), "_g").drop("_g")


def profile_columns(df: DataFrame, columns: list[str] | None = None, keys: list[str] = ()) -> DataFrame:
    """Missing, distinct, five-number summary of numbers and lengths of texts, a row a column (and group)."""
    cells = long_cells(df, columns, list(keys))
    value = F.when(~is_missing(F.col("value")), F.col("value"))
    by = [*keys, "column"]
    # each value of a column is counted once; all figures are read off the counts
    counts = cut(cells.groupBy(*by, value.alias("v")).agg(F.count("*").alias("c")).withColumns({"x": F.col("v").try_cast("double"), "l": F.length("v")}))
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("c"))), F.lit(0))
    out = counts.groupBy(*by).agg(
        F.sum("c").alias("n_rows"), (F.sum("c") - of("v")).alias("missing"), F.count("v").alias("distinct_values"), of("x").alias("numbers"), F.min("l").alias("min_length"), F.max("l").alias("max_length"),
    )
    both = counts.select(*by, "c", F.inline(F.array(F.struct(F.lit("x").alias("what"), F.col("x").alias("m")), F.struct(F.lit("l").alias("what"), F.col("l").cast("double").alias("m")))))
    places = quantiles(both, [*by, "what"], "m", (0.0, 0.25, 0.5, 0.75, 1.0), F.col("c")).groupBy(*by).agg(F.max(F.when(F.col("what") == "x", F.col("q"))).alias("five"), F.max(F.when(F.col("what") == "l", F.get("q", F.lit(2)))).alias("median_length"))
    same = reduce(lambda a, b: a & b, (F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by))
    out = out.alias("o").join(places.alias("p"), same, "left").select("o.*", "p.five", "p.median_length")
    numeric = (F.col("n_rows") > F.col("missing")) & (F.col("numbers") >= 0.95 * (F.col("n_rows") - F.col("missing")))
    at = lambda i: F.when(numeric, F.round(F.get("five", F.lit(i)), 6))
    names = ("min_value", "q25", "median_value", "q75", "max_value")
    return out.select(*by, "n_rows", "missing", rate(F.col("missing"), F.col("n_rows")).alias("missing_rate"), "distinct_values", numeric.alias("is_numeric"), *[at(i).alias(n) for i, n in enumerate(names)], "min_length", F.round("median_length", 6).alias("median_length"), "max_length")


def top_values(df: DataFrame, columns: list[str], k: int, patterns: bool = False, keys: list[str] = ()) -> DataFrame:
    """The k most frequent values (or format patterns) of each column (and group); counts come before ranks."""
    cells = long_cells(df, columns, list(keys)).where(~is_missing(F.col("value")))
    shown = format_pattern(F.col("value")) if patterns else F.col("value")
    counts = cells.groupBy(*keys, "column", shown.alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def format_patterns(df: DataFrame, column: str) -> DataFrame:
    return df.select(format_pattern(F.col(column)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, columns, and rows beyond the first of each group of equal rows."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def group_limit(df: DataFrame, keys: list[str], most: int) -> None:
    if df.select(*keys).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} groups")


def profile_by_group(df: DataFrame, keys: list[str], values: list[str], most: int = 1000) -> DataFrame:
    """Per group and column: rows, missing, distinct, inconsistent; more groups than allowed is an error."""
    group_limit(df, keys, most)
    cells = long_cells(df, values, keys)
    value = F.when(~is_missing(F.col("value")), F.col("value"))
    return cells.groupBy(*keys, "column").agg(F.count("*").alias("n_rows"), F.count(F.when(value.isNull(), 1)).alias("missing"), F.count_distinct(value).alias("distinct_values")).withColumn("inconsistent", F.col("distinct_values") > 1)


def group_statistics(df: DataFrame, keys: list[str], values: list[str], most: int = 1000) -> DataFrame:
    """profile_columns() of each group, with inconsistent, larger groups first."""
    group_limit(df, keys, most)
    return profile_columns(df, values, keys).withColumn("inconsistent", F.col("distinct_values") > 1).orderBy(F.desc("n_rows"), *keys, "column")


#: Distinct values that a sketch of 2**12 digests counts exactly; more are known to be more.
SKETCH = 12


def inspect(df: DataFrame, most: int = 80, distinct: int = 2000) -> DataFrame:
    """Missing cells and capped distinct counts of up to so many columns, in one aggregate; whole values are told apart.

    Distinct values are counted by mergeable sketches of bounded size, which are exact up to 4,096 values, so
    no value is shuffled.  distinct may be 4,096 at most.
    """
    if distinct > 1 << SKETCH:
        raise ValueError(f"distinct values are exact up to {1 << SKETCH}")
    names = df.columns[:most]
    value = {c: F.when(~is_missing(F.col(f"`{c}`").cast("string")), F.col(f"`{c}`").cast("string")) for c in names}
    rows = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count(v)).alias("missing"), F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(v, SKETCH)), F.lit(0)).cast("long").alias("_d")) for c, v in value.items()]
    out = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return out.select("column", "n_rows", "missing", rate(F.col("missing"), F.col("n_rows")).alias("missing_rate"), F.least(F.col("_d"), F.lit(distinct)).alias("distinct_values"), (F.col("_d") > distinct).alias("capped"))


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The n rows with the smallest digests: the same rows however they are dealt; tasks pass on n rows each."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in df.columns])
    return df.withColumn("_digest", F.md5(text)).orderBy("_digest", *df.columns).limit(n).drop("_digest")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
