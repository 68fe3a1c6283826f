"""Declarative constraints: each adds a boolean column `violates`, and a report counts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.cells import is_missing, rate


def not_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (is_missing(F.col(c)) for c in columns))


def allowed_values(column: str, values: list[str]) -> Column:
    return ~is_missing(F.col(column)) & ~F.col(column).cast("string").isin(*values)


def in_range(column: str, low: float | None = None, high: float | None = None) -> Column:
    x = F.col(column).try_cast("double")
    bad = x.isNull()
    if low is not None:
        bad = bad | (x < low)
    if high is not None:
        bad = bad | (x > high)
    return ~is_missing(F.col(column)) & bad


def full_match(column: str, pattern: str) -> Column:
    return ~is_missing(F.col(column)) & ~F.col(column).cast("string").rlike(rf"\A(?:{pattern})\z")


def temporal_order(df: DataFrame, start: str, end: str) -> Column:
    """start > end, as numbers where both columns mostly parse as numbers, else as times; what does not parse never violates."""
    kinds = dict(df.dtypes)
    if any(kinds[c].startswith(("timestamp", "date")) for c in (start, end)):
        return F.coalesce(F.col(start).cast("timestamp") > F.col(end).cast("timestamp"), F.lit(False))
    share = lambda c: F.try_divide(F.count(F.col(c).try_cast("double")), F.count(c))
    a, b = df.agg(share(start), share(end)).first()  # one row
    kind = "double" if (a or 0) >= 0.95 and (b or 0) >= 0.95 else "timestamp"
    return F.coalesce(F.col(start).try_cast(kind) > F.col(end).try_cast(kind), F.lit(False))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a repeated key violate; null keys equal each other.

    Keys are counted first and met again by a join, so one hot key never sorts in one task.
    """
    repeated = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n")).where("_n > 1")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return df.join(repeated, same, "left").withColumn("violates", F.col("_n").isNotNull()).drop("_n", *[f"_{k}" for k in keys])


def functional_dependency(df: DataFrame, determinant: list[str], dependent: list[str]) -> DataFrame:
    """Rows of determinant groups with more than one dependent tuple violate; null groups are kept."""
    tuples = df.groupBy(*[F.col(k).alias(f"_{k}") for k in determinant], F.struct(*dependent).alias("_t")).agg(F.lit(1).alias("_one"))
    broken = tuples.groupBy(*[f"_{k}" for k in determinant]).agg(F.count("*").alias("_n")).where("_n > 1")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in determinant))
    return df.join(broken, same, "left").withColumn("violates", F.col("_n").isNotNull()).drop("_n", *[f"_{k}" for k in determinant])


def foreign_key(df: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Complete keys absent from the parent violate; rows with a missing part are exempt."""
    known = parent.select(*[F.col(p).alias(f"_{k}") for p, k in zip(parent_keys, keys)]).distinct().withColumn("_known", F.lit(True))
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_{k}") for k in keys))
    complete = ~not_null(keys)
    return df.join(known, same, "left").withColumn("violates", complete & F.col("_known").isNull()).drop("_known", *[f"_{k}" for k in keys])


def summary(violating: DataFrame, name: str) -> DataFrame:
    """One report row of a table with a violates column."""
    n = F.coalesce(F.sum(F.col("violates").cast("long")), F.lit(0))
    return violating.agg(F.lit(name).alias("constraint"), F.count("*").alias("n_rows"), n.alias("violations"), rate(n, F.count("*")).alias("violation_rate"), (n == 0).alias("passed"))


def local_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Report rows of all row-local rules from one aggregate over the table."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    rows = [F.struct(F.lit(k).alias("constraint"), F.count("*").alias("n_rows"), n(c).alias("violations"), rate(n(c), F.count("*")).alias("violation_rate"), (n(c) == 0).alias("passed")) for k, c in rules.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def local_rule(df: DataFrame, rule: dict) -> Column | None:
    """The violation of a row-local rule, or None where the rule needs other rows."""
    kind = rule["type"]
    if kind == "not_null":
        return not_null(rule["columns"])
    if kind == "allowed_values":
        return allowed_values(rule["column"], rule["values"])
    if kind == "range":
        return in_range(rule["column"], rule.get("min"), rule.get("max"))
    if kind == "regex":
        return full_match(rule["column"], rule["pattern"])
    if kind == "temporal_order":
        return temporal_order(df, rule["start"], rule["end"])
    return None


def violating(df: DataFrame, rule: dict, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """df with violates; an unknown type of rule is refused."""
    kind, local = rule["type"], local_rule(df, rule)
    if local is not None:
        return df.withColumn("violates", local)
    if kind == "unique":
        return unique(df, rule["columns"])
    if kind == "functional_dependency":
        return functional_dependency(df, rule["determinant"], rule["dependent"])
    if kind == "foreign_key":
        return foreign_key(df, rule["columns"], parents[rule["parent"]], rule["parent_columns"])
    raise ValueError(f"unknown constraint type: {kind}")


def report(df: DataFrame, rules: list[dict], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Violations of every rule: {"name", "type", ...}; row-local rules share one aggregate."""
    local = {r["name"]: c for r in rules if (c := local_rule(df, r)) is not None}
    parts = [local_report(df, local)] if local else []
    parts += [summary(violating(df, r, parents), r["name"]) for r in rules if r["name"] not in local]
    return reduce(DataFrame.unionByName, parts)


def totals(reported: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return reported.agg(n(F.col("passed")).alias("passed_count"), n(~F.col("passed")).alias("failed_count"), n(F.col("violations")).alias("violations"))


def examples(marked: DataFrame, keys: list[str], limit: int = 50) -> DataFrame:
    """Up to so many violating rows, in key order."""
    return marked.where("violates").orderBy(*keys).limit(limit)


def report_examples(df: DataFrame, rules: list[dict], keys: list[str], parents: dict[str, DataFrame] | None = None, limit: int = 10) -> DataFrame:
    """(constraint, keys ..., place): up to so many violating rows of each rule, in the order of the given columns."""
    place = F.row_number().over(Window.partitionBy("constraint").orderBy(*keys))  # over limit rows a rule
    parts = [examples(violating(df, r, parents), keys, limit).select(F.lit(r["name"]).alias("constraint"), *keys) for r in rules]
    return reduce(DataFrame.unionByName, parts).withColumn("place", place)
