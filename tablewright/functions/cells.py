"""Column expressions for single cells: missing values, normal forms, names, patterns and ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that count as an empty cell in scoring.
EMPTY_TEXTS = ("", "nan", "nat", "none", "null")
#: Texts that count as placeholders in a package gate.
PLACEHOLDERS = ("", "placeholder", "todo", "unknown", "n/a", "not available")


def is_missing(c: Column) -> Column:
    """Null, or blank after trimming."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def number(c: Column) -> Column:
    return c.try_cast("double")


def strip_zeros(text: Column) -> Column:
    short = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(F.contains(text, F.lit(".")), short).otherwise(text)


#: Types of whole numbers, whose digits are their normal form.
WHOLE_TYPES = ("tinyint", "smallint", "int", "bigint")


def normal_whole(c: Column) -> Column:
    """normal_cell() of a column of a whole type."""
    return F.coalesce(c.cast("string"), F.lit(""))


def one_spaced(text: Column) -> Column:
    """Each run of white space as one space; plain texts that have single spaces alone go without a pattern."""
    odd = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in ("  ", "\t", "\n", "\v", "\f", "\r")))
    return F.when((F.octet_length(text) == F.length(text)) & ~odd, text).otherwise(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_cell(c: Column) -> Column:
    """The form in which cells are compared: empty, hours of a duration, a plain decimal, or lower-case text."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    lower = F.lower(text)
    # only what begins like a number is matched against the patterns of numbers
    numeric = F.substring(lower, 1, 1).isin(*"0123456789+-.")
    duration = r"^(-?[0-9]+) days? ([0-9]{1,2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)$"
    part = lambda k: F.regexp_extract(lower, duration, k).try_cast("decimal(20,6)")
    hours = (part(1) * 24 + part(2) + part(3) / 60 + part(4) / 3600).cast("decimal(38,6)")
    plain = F.when(numeric & lower.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), lower.try_cast("decimal(38,6)"))
    written = lambda x: F.regexp_replace(strip_zeros(x.cast("string")), "^-0$", "0")
    return (
        F.when(lower.isin(*EMPTY_TEXTS), "")
        .when(numeric & lower.rlike(duration), written(hours))
        .when(plain.isNotNull(), written(plain))
        .otherwise(one_spaced(lower))
    )


def clean_code(c: Column) -> Column:
    return F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit("."), F.lit(""))


def code_prefix(c: Column) -> Column:
    return F.substring(clean_code(c), 1, 3)


def safe_name(c: Column) -> Column:
    """Upper case, anything but letters and digits as one underscore, UNK if nothing is left."""
    name = F.trim(F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.when(name == "", "UNK").otherwise(name)


def format_pattern(c: Column) -> Column:
    text = F.substring(c.cast("string"), 1, 200)
    for pattern, mark in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{Nd}+", "9"), (r"[\s_]+", "_")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def rate(part: Column, whole: Column) -> Column:
    """part / max(whole, 1), to six decimals."""
    return F.round(part.cast("double") / F.greatest(whole, F.lit(1)).cast("double"), 6)


def f1(matched: Column, result: Column, reference: Column) -> Column:
    """2 m / (result + reference); 1 where both sides are empty."""
    both = (result + reference).cast("double")
    return F.when(both == 0, 1.0).otherwise(F.round(2 * matched.cast("double") / both, 6))


def first_by_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the one with the smallest digest, however the rows are dealt; keys are counted before rows move."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in rest])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), digest).alias("_row")).select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])
