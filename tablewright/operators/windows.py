"""Events inside time windows of their key, as a join on time bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(at) / seconds)


def in_windows(events: DataFrame, windows: DataFrame, keys: list[str], at: str, start: str, end: str, seconds: int) -> DataFrame:
    """Every pair of an event and a window of its key with start <= at <= end.

    A window is put into each bin of so many seconds that it touches and an event into its own one; both meet by
    key and bin, then by the exact bounds.  So a key with many events and windows is dealt over
    its bins, and only those that are near in time meet.  Windows that overlap each keep the event.  With
    bins about as long as windows a window has two or three.  Rows without a key or a time, and windows that end before they start, meet nothing.
    """
    w = windows.where(F.col(end) >= F.col(start)).dropna(subset=keys)
    w = w.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start), seconds), bin_of(F.col(end), seconds)))).alias("w")
    e = events.where(F.col(at).isNotNull()).withColumn("_bin", bin_of(F.col(at), seconds)).alias("e")
    same = reduce(lambda a, b: a & b, (F.col(f"e.{k}") == F.col(f"w.{k}") for k in [*keys, "_bin"]))
    rest = [c for c in windows.columns if c not in keys]
    return e.join(w, same & F.col(f"e.{at}").between(F.col(f"w.{start}"), F.col(f"w.{end}"))).select(*[F.col(f"e.{c}") for c in events.columns], *[F.col(f"w.{c}") for c in rest])
