"""What the operators share about the session: where cut lineage goes, sizes, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds at most: texts are large, so batches are short.
ARROW_ROWS = 400
#: A table under this many rows of a few numbers each may be broadcast.
BROADCAST_ROWS = 100_000


def prepared(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, and a checkpoint folder.

    On a cluster the shared folder is named in spark.checkpoint.dir; only where one machine
    does all, as in tests, does a temporary folder take its place.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, so that a lost executor costs no long replay."""
    prepared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written under the checkpoint folder: lineage is cut as by cut(), columns are compressed and sizes known."""
    spark = prepared(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, name: str) -> None:
    """Removes the tables of written(..., name) that df reads, once nothing needs them; whatever else it reads stays."""
    spark = df.sparkSession
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    inside = re.compile(rf"{re.escape(re.sub('^[a-z]+:/+', '/', root))}/{re.escape(name)}-[0-9a-f]{{32}}$")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if inside.search(folder):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df marked for broadcast if it is counted to be within the bound, else as it is (a shuffle join follows).

    weight: how many rows of a few numbers a row of df is worth, where its rows hold arrays.
    """
    some = df.limit(rows + 1)
    if weight is None:
        return F.broadcast(df) if some.count() <= rows else df
    n, weighed = some.select(weight.alias("w")).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and weighed <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
