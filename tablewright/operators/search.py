"""Regular-expression search over text records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern_of(pattern: str, ignore_case: bool) -> str:
    return f"(?iu){pattern}" if ignore_case else pattern


def match_counts(df: DataFrame, key: str, text: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(key, n) of the records that match."""
    p = F.lit(pattern_of(pattern, ignore_case))
    return df.where(F.regexp_like(F.col(text), p)).select(key, F.regexp_count(F.col(text), p).cast("long").alias("n"))


def match_lines(df: DataFrame, key: str, text: str, pattern: str, ignore_case: bool = False, limit: int | None = None) -> DataFrame:
    """(key, line, content): matching lines with their number from 1; a limit gives the first ones by key."""
    p = F.lit(pattern_of(pattern, ignore_case))
    # records without any match are left out before their lines are made
    lines = df.where(F.regexp_like(F.col(text), p)).select(key, F.posexplode(F.split(text, "\n")).alias("_i", "content"))
    out = lines.where(F.regexp_like(F.col("content"), p)).select(key, (F.col("_i") + 1).alias("line"), "content")
    return out.orderBy(key, "line").limit(limit) if limit is not None else out
