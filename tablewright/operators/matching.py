"""Pairing the rows of large keys for the most equal cells, as Spark jobs.

Two rows that share a key pair with the number of their equal cells as weight; sought is the
pairing with the largest total.  The graph is never written out.  Rows meet in nodes, one
for each set of columns and their values that occurs on both sides of a key: a row of either side
belongs to the nodes of all its column sets, and two rows with k equal cells meet in a node of k columns.

Every left row has a height u, every right row a height v, and u + v is never under the weight.
All heights are whole numbers: u starts at the largest weight, v at 0.  An edge is tight
where u + v is its weight, which in a node of k columns holds for just those rows with u + v = k.
In each phase

1. trees grow from all free left rows at once, along tight edges to right rows not yet reached
   and from these to their mates.  Each right row picks one of a node's left rows by
   digest, so that free rows of one node spread over it;
2. a tree that reaches a free right row grows no further, the others for as many layers again; then each
   such tree switches the pairs along one of its paths, and growth begins anew;
3. where none is reached, u of all left rows in trees falls by 1 and v of all right rows in trees rises by 1.

Free left rows are as low as any, so after as many falls as there are columns they are at 0 and the
pairing is a best one; what is left free on both sides shares no cell.  A round is a
few joins on rows, nodes and their pairs, each written as a table in the shared folder: unlike a
checkpoint, which hands on the estimates of the plan before it and lets them multiply round by round, it
is planned with by its true size.  Nothing is gathered by key, and of the state only counts reach the driver.  Work follows the rows times the column sets they share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.lineage import scratch

#: Left rows of one node that a round offers to the node's right rows, at most; the others wait for a later round.
SLOTS = 4096
_NODES = "array<struct<node:bigint,size:int>>"


def _null_safe(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))


class _Keep:
    """Writes tables under a fresh folder and reads them again; remove() deletes them all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, scratch(spark, "pairs"), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

    def remove(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _numbered(cut: _Keep, rows: DataFrame, count: str) -> DataFrame:
    """Each row as often as it is there, with its own _id."""
    return cut(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).drop("_copy", count).withColumn("_id", F.monotonically_increasing_id()))


def _nodes(cut: _Keep, left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(row, node, size) of either side, and the largest size.

    Sets of columns grow one column at a time, and only from sets whose values both sides have:
    a set of k columns is shared only if those without its last column and without its first are.
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    one = lambda df: df.select(F.col("_id").alias("row"), key.alias("key"), F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("column", "value"))
    shared = lambda a, b, at: a.select(*at).distinct().join(b.select(*at).distinct(), at).withColumn("node", F.monotonically_increasing_id())
    sides, done, size = [one(left).where("value is not null"), one(right).where("value is not null")], [[], []], 1
    level = cut(shared(*sides, ["key", "column", "value"]))
    first = last = [cut(s.join(level, ["key", "column", "value"]).select("row", F.col("column").alias("high"), "node")) for s in sides]
    while not last[0].isEmpty():
        for side, rows in zip(done, last):
            side.append(rows.select("row", "node", F.lit(size).alias("size")))
        if size == len(columns):
            break
        longer = [a.join(b.select("row", F.col("high").alias("next"), F.col("node").alias("added")), "row").where("next > high").select("row", F.col("node").alias("of"), "next", "added") for a, b in zip(last, first)]
        longer = [cut(x) for x in longer]
        level = cut(shared(*longer, ["of", "added"]))
        last = [cut(x.join(level, ["of", "added"]).select("row", F.col("next").alias("high"), F.col("node").bitwiseOR(F.lit(size) * F.lit(1 << 56)).alias("node"))) for x in longer]
        size += 1
    if not done[0]:
        none = first[0].select("row", "node", F.lit(0).alias("size"))
        return none, none, 0
    every = [cut(reduce(DataFrame.unionAll, side)) for side in done]
    return every[0], every[1], len(done[0])


def _counted(cut: _Keep, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict[str, int]]:
    """df cut, and figures of it."""
    done = cut(df)
    return done, done.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in figures.items()]).first().asDict()


def _grow(right: DataFrame, front: DataFrame, reached: DataFrame | None) -> DataFrame:
    """(row, by, root, mate) of right rows not reached before that a left row of the front has a tight edge to.

    front: row, u, nodes, root, salt.  Of a node's left rows at most SLOTS take part in a round, picked by digest.
    """
    at = front.select("row", "root", "salt", F.col("u"), F.inline("nodes")).where("size >= u")
    at = at.select("node", (F.col("size") - F.col("u")).alias("v"), F.pmod(F.xxhash64("row", "salt"), F.lit(SLOTS)).alias("slot"), "row", "root", "salt")
    some = at.groupBy("node", "v", "salt", "slot").agg(F.min(F.struct(F.col("row").alias("by"), "root")).alias("own"))
    hubs = some.groupBy("node", "v", "salt").agg(F.collect_list("own").alias("who"))
    open_ = right if reached is None else right.join(reached.select("row"), "row", "left_anti")
    there = open_.select("row", "mate", "v", F.inline("nodes")).join(hubs, ["node", "v"])
    chance = F.xxhash64("row", "node", "salt")
    pick = F.element_at("who", (F.pmod(chance, F.size("who")) + 1).cast("int"))
    return there.groupBy("row", "mate").agg(F.min_by(pick, chance).alias("p")).select("row", "p.by", "p.root", "mate")


def _switched(cut: _Keep, state: tuple[DataFrame, DataFrame], layers: list[DataFrame], ends: list[DataFrame | None]) -> tuple[DataFrame, DataFrame]:
    """State after each tree has switched the pairs along its path; ends has the free right rows of each layer that end one."""
    pairs, at = [], None
    for layer, own in zip(reversed(layers), reversed(ends)):
        # a left row of a path leaves its old mate, which was reached in the layer below
        below = None if at is None else layer.join(at.select(F.col("by").alias("mate")), "mate").select("row", "by")
        both = [x for x in (own, below) if x is not None]
        if both:
            at = cut(reduce(DataFrame.unionAll, both))
            pairs.append(at.select(F.col("by").alias("l"), F.col("row").alias("r")))
    new = cut(reduce(DataFrame.unionAll, pairs))
    left = state[0].join(new.select(F.col("l").alias("row"), F.col("r").alias("now")), "row", "left").select("row", "u", F.coalesce("now", "mate").alias("mate"), "nodes")
    right = state[1].join(new.select(F.col("r").alias("row"), F.col("l").alias("now")), "row", "left").select("row", "v", F.coalesce("now", "mate").alias("mate"), "nodes")
    return cut(left), cut(right)


def best_pairs(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], count: str) -> DataFrame:
    """(column, n): how many pairs of the best pairing within keys have equal cells in each column.

    left, right: keys, columns and how often each row occurs.  A null cell equals none.  Rows of a key are
    paired as far as the smaller side goes, those without an equal cell too.
    """
    cut = _Keep(left.sparkSession)
    left, right = _numbered(cut, left, count), _numbered(cut, right, count)
    free = columns_apart(columns, keys)
    nodes_l, nodes_r, most = _nodes(cut, left, right, keys, free) if free else (None, None, 0)
    def begun(rows: DataFrame, nodes: DataFrame | None, name: str, height: int) -> DataFrame:
        own = rows.select(F.col("_id").alias("row"), F.lit(height).alias(name), F.lit(None).cast("long").alias("mate"))
        if nodes is None:
            return own.withColumn("nodes", F.array().cast(_NODES))
        held = nodes.groupBy("row").agg(F.collect_list(F.struct("node", "size")).alias("nodes"))  # column sets of one row
        return own.join(held, "row", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast(_NODES)))

    (l, seen), r = _counted(cut, begun(left, nodes_l, "u", most), n=F.count(F.lit(1))), cut(begun(right, nodes_r, "v", 0))
    state, free_rows, height, salt = (l, r), seen["n"], most, 0
    while height > 0 and free_rows:
        layers, reached, ends, ended, first = [], None, [], 0, 0
        front = state[0].where("mate is null").withColumn("root", F.col("row"))
        while not first or len(layers) <= 2 * first:
            salt += 1
            new, seen = _counted(cut, _grow(state[1], front.withColumn("salt", F.lit(salt)), reached), n=F.count(F.lit(1)), free=F.count_if(F.col("mate").isNull()))
            if not seen["n"]:
                break
            layers.append(new)
            ends.append(None)
            reached = new if reached is None else reached.unionAll(new)
            grown = new.where("mate is not null")
            if seen["free"]:
                found, seen = _counted(cut, new.where("mate is null").groupBy("root").agg(F.min(F.struct("row", "by")).alias("e")).select("root", "e.*"), n=F.count(F.lit(1)))
                ends[-1], ended, first = found.select("row", "by"), ended + seen["n"], first or len(layers)
                grown = grown.join(found.select("root"), "root", "left_anti")  # a tree has one path; the others grow on
            front = grown.select(F.col("mate").alias("row"), "root").join(state[0].select("row", "u", "nodes"), "row")
        free_rows -= ended
        if ended:
            state = _switched(cut, state, layers, ends)
            continue
        # no free right row is in reach: heights in the trees change
        grown = state[0].where("mate is null").select("row")
        if reached is not None:
            grown = grown.unionAll(reached.select(F.col("mate").alias("row")))
        low = grown.withColumn("_in", F.lit(1))
        fall = state[0].join(low, "row", "left").select("row", (F.col("u") - F.coalesce("_in", F.lit(0))).alias("u"), "mate", "nodes")
        rise = state[1] if reached is None else state[1].join(reached.select("row", F.lit(1).alias("_in")), "row", "left").select("row", (F.col("v") + F.coalesce("_in", F.lit(0))).alias("v"), "mate", "nodes")
        state, height = (cut(fall), state[1] if reached is None else cut(rise)), height - 1
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    pairs = state[0].where("mate is not null").join(left.withColumnRenamed("_id", "row"), "row").alias("l").join(right.withColumnRenamed("_id", "mate").alias("r"), "mate")
    equal = [F.struct(F.lit(c).alias("column"), total(F.coalesce(F.col(f"l.{c}") == F.col(f"r.{c}"), F.lit(False))).alias("n")) for c in free]
    out = pairs.agg(F.array(*equal).alias("r")).select(F.inline("r")) if free else None
    sides = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    all_ = sides(left, "nl").alias("l").join(sides(right, "nr").alias("r"), _null_safe(keys)).agg(total(F.least("nl", "nr")).alias("n"))
    of_keys = all_.select(F.explode(F.array(*[F.lit(k) for k in columns if k in keys]).cast("array<string>")).alias("column"), "n")
    found = [tuple(r) for r in (of_keys if out is None else out.unionAll(of_keys)).collect()]  # a row a column
    spark = cut.spark
    cut.remove()
    return spark.createDataFrame(found, "column string, n long")


def columns_apart(columns: list[str], keys: list[str]) -> list[str]:
    return [c for c in columns if c not in keys]
