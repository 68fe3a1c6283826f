"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture, in characters.  Its mean repetition
rate is share * budget / size of the source, and each document is repeated a
Poisson-distributed number of times with that mean: a number in [0, 1) from a digest
of seed and doc_id is looked up in the inverted distribution.  Rates over PART are
split into independent parts of the same rate, whose counts add up.  The documents are
exploded by their counts and shuffled globally: sorted by a digest of seed, id and copy.

Defined results: a null source is a source of its own, named "".  A null text counts
as empty; a source whose texts are all empty has rate 1.  Documents with the same id
get the same count.  Sources missing from a weights table get weight 1; negative
weights are refused.  All columns of the documents are kept; doc_copy, mix_rate and
mix_key are added and replace columns of those names.  An empty table gives no rows;
texts of any length are repeated whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.native import fraction
from tablewright.llm.session import cut, small, table

SEED = "mix-1"
#: Largest rate inverted at once, and the most counts the inverted distribution is tabled for.
PART, MOST = 8.0, 60


def cdf(rate: Column) -> Column:
    """P(count <= k) for k = 0 .. MOST, as an array."""
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), first, step, lambda acc: acc["c"])


def rates(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """source, rate, parts and the distribution of one part, a row for each source.

    Without a weights table a source weighs the square root of its size, which tempers large ones.
    """
    size = F.sum(F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long"))
    found = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(size.alias("size"))
    if weights is None:
        found = found.withColumn("weight", F.sqrt(F.col("size").cast("double")))
    else:
        given = weights.select(F.coalesce(F.col("source"), F.lit("")).alias("source"), F.col("weight").cast("double")).groupBy("source").agg(F.max("weight").alias("weight"))
        found = found.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        found = found.withColumn("weight", F.when(F.col("weight") >= 0, F.col("weight")).otherwise(F.raise_error(F.lit("a weight is negative"))))
    found = cut(found)
    whole = found.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = F.try_divide(F.col("weight"), F.lit(float(whole[0])))
    target = float(whole[1] if budget is None else budget)
    rate = F.when(F.col("size") > 0, share * target / F.col("size")).otherwise(F.lit(1.0))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    return found.select("source", rate.alias("rate")).withColumn("parts", parts).withColumn("cdf", cdf(F.col("rate") / F.col("parts")))


def mix(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, seed: str = SEED, shuffle: bool = True) -> DataFrame:
    # the documents' columns travel as one, so that no name of theirs meets one of ours
    own = docs.drop("doc_copy", "mix_rate", "mix_key")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), id_.alias("id"))
    at = own.join(small(rates(docs, weights, budget)), "source")
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda acc, k: acc + F.size(F.filter("cdf", lambda c: fraction(F.lit(seed), F.col("id"), k.cast("string")) >= c)),
    )
    one = F.size(F.filter("cdf", lambda c: F.col("u") >= c))
    at = at.withColumn("u", fraction(F.lit(seed), F.col("id"), F.lit("1"))).withColumn("count", F.when(F.col("parts") == 1, one).otherwise(count))
    copies = at.where("count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count").cast("long"))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "id", F.col("copy").cast("string")))
    out = copies.select("row.*", F.col("rate").alias("mix_rate"), F.col("copy").alias("doc_copy"), key.alias("mix_key"))
    return out.orderBy("mix_key", "doc_id") if shuffle else out


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("mix_rate")


def sql(of: str = "documents") -> str:
    u = f"(('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || k), 1, 13))::BIGINT / {float(16**13)})"
    return f"""
WITH RECURSIVE s AS (SELECT coalesce(source, '') AS src, sum(length(coalesce(text, '')))::BIGINT AS size FROM {of} GROUP BY 1),
r AS (SELECT src, CASE WHEN size > 0 THEN sqrt(size::DOUBLE) / (SELECT sum(sqrt(size::DOUBLE)) FROM s) * (SELECT sum(size) FROM s)::DOUBLE / size ELSE 1.0 END AS rate FROM s),
q AS (SELECT src, greatest(ceil(rate / {PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART}), 1)::INT AS part FROM r),
c AS (SELECT src, parts, part, 0 AS k, exp(-part) AS p, exp(-part) AS c FROM q
  UNION ALL SELECT src, parts, part, k + 1, p * part / (k + 1), c + p * part / (k + 1) FROM c WHERE k < {MOST}),
l AS (SELECT src, parts, list(c ORDER BY k) AS cdf FROM c GROUP BY ALL),
n AS (SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda k: len(list_filter(cdf, lambda x: {u} >= x)))) AS copies FROM {of} d JOIN l ON l.src = coalesce(d.source, '')),
e AS (SELECT * EXCLUDE (copies), unnest(range(1, copies::BIGINT + 1))::BIGINT AS doc_copy FROM n)
SELECT *, md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, '') || '|' || doc_copy) AS mix_key FROM e
"""


ORACLE = sql()
