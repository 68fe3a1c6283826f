"""Cutting lineage: a reliable checkpoint in the shared folder the cluster names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is named and one machine does all, as in tests, a temporary one is set."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written inside a query."""
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shelved(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read by columns, for tables that a query scans several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _i, each row's place from 0 in the order of the given columns.

    Rows are numbered inside ranges of a global sort, so that no task sees them all: a range's
    first place is the count of rows in the ranges before it.  The ranges are cut once: planned
    again, they would be sampled anew and their sizes belong to others.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect())  # a row a range
    offsets, before = [], 0
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    first = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return ranged.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("_i", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")
