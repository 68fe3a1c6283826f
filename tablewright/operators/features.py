"""Features of visits from coded and measured events, and their assembly into a wide table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.cells import clean_code, code_prefix, first_by_digest, is_missing, safe_name
from tablewright.sources.lineage import cut


def semi_scan(events: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Events of the wanted keys; the join's side is picked by its size at run time."""
    return events.join(keys.select(key).distinct(), key, "left_semi")


#: Bits of one block of the key filter, set bits of a key, and the most blocks (4 KB each) that are broadcast.
BLOCK_BITS, KEY_BITS, MOST_BLOCKS = 32_768, 3, 2_048


def key_blocks(keys: DataFrame, key: str, bits_a_key: int = 12) -> tuple[DataFrame, int] | None:
    """A blocked Bloom filter of the keys as (_block, bitmap), and its number of blocks; None where it would pass MOST_BLOCKS.

    A key sets KEY_BITS bits of the one block its digest names; blocks are built by a bitmap aggregate.
    """
    n = keys.count()
    blocks = 1
    while blocks * BLOCK_BITS < n * bits_a_key:
        blocks *= 2
    if blocks > MOST_BLOCKS:
        return None
    at = keys.select(_block(F.col(key), blocks).alias("_block"), F.explode(F.array(*_bits(F.col(key)))).alias("_bit"))
    return at.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bitmap")), blocks


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(BLOCK_BITS)) for k in range(1, KEY_BITS + 1)]


def probed(events: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """Events whose key may be in the filter: all that are, and few others, before any shuffle."""
    byte = lambda bit: F.conv(F.hex(F.substring("_bitmap", (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    held = [F.getbit(byte(b), (b % 8).cast("int")) == 1 for b in _bits(F.col(key))]
    at = events.withColumn("_block", _block(F.col(key), blocks)).join(F.broadcast(filter_), "_block")
    for h in held:
        at = at.where(h)
    return at.drop("_block", "_bitmap")


def semi_scan_filtered(events: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """semi_scan() for key sets too large to broadcast: a filter of at most 8 MB goes first, the exact join follows on what it lets through."""
    one = cut(keys.select(key).where(F.col(key).isNotNull()).distinct())
    made = key_blocks(one, key)
    some = events if made is None else probed(events, key, *made)
    return some.join(one, key, "left_semi")


def enrich(events: DataFrame, dictionary: DataFrame | None, shared: list[str]) -> DataFrame:
    """Events with the dictionary's columns; without a dictionary they stay as they are."""
    return events if dictionary is None else events.join(dictionary, shared, "left")


def joined_set(c: Column) -> Column:
    """Distinct non-blank texts, sorted and joined by a bar."""
    return F.array_join(F.sort_array(F.collect_set(F.when(~is_missing(c), c.cast("string")))), "|")


def top_values(df: DataFrame, column: str, n: int) -> list[str]:
    """The n most frequent values, ties by value; n bounds what comes to the driver."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n).collect()
    return [r[0] for r in rows]


def distinct_names(names: Iterable[str]) -> list[str]:
    """Names with a number added where one comes again."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def top_flags(df: DataFrame, key: str, column: str, prefix: str, n: int) -> DataFrame:
    """key and a 0/1 column for each of the n most frequent values; keys without any of them are absent."""
    values = top_values(df, column, n)
    if not values:
        return df.select(key).limit(0)
    names = distinct_names(prefix + _safe(v) for v in values)
    flags = [F.max((F.col(column) == v).cast("int")).alias(name) for v, name in zip(values, names)]
    return df.where(F.col(column).isin(values)).groupBy(key).agg(*flags)


def _safe(value: str) -> str:
    import re

    return re.sub("[^A-Z0-9]+", "_", str(value).strip().upper()).strip("_") or "UNK"


def primary_code(events: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Code, prefix and title of the row with the lowest sequence number of each visit."""
    order = F.struct(F.col("seq_num").try_cast("int"), F.col("icd_code"), F.col("icd_version"))
    out = events.where(F.col("seq_num").try_cast("int").isNotNull()).groupBy(key).agg(F.min(F.struct(order.alias("o"), F.col("icd_code").alias("code"), F.col("long_title").alias("title"))).alias("m"))
    return out.select(key, F.col("m.code").alias("primary_code"), code_prefix(F.col("m.code")).alias("primary_prefix"), F.col("m.title").alias("primary_title"))


def code_features(events: DataFrame, key: str, prefix: str, n: int = 20, titles: bool = False) -> DataFrame:
    """Counts, joined codes (and titles) and flags of the most frequent code prefixes."""
    coded = events.withColumn("_code", clean_code(F.col("icd_code"))).withColumn("_root", F.substring(clean_code(F.col("icd_code")), 1, 3))
    aggs = [F.count("*").alias(f"{prefix}_count"), F.count_distinct("_code").alias(f"{prefix}_distinct"), joined_set(F.col("_code")).alias(f"{prefix}_codes")]
    if titles:
        aggs.append(joined_set(F.col("long_title")).alias(f"{prefix}_titles"))
    return coded.groupBy(key).agg(*aggs).join(top_flags(coded, key, "_root", f"{prefix}_", n), key, "left")


def medication_features(orders: DataFrame, key: str, n: int = 30) -> DataFrame:
    named = orders.withColumn("_drug", safe_name(F.col("drug")))
    counts = named.groupBy(key).agg(F.count("*").alias("med_count"), F.count_distinct("_drug").alias("med_distinct"))
    return counts.join(top_flags(named, key, "_drug", "med_", n), key, "left")


#: Events of whole keys that one task lays out as columns, about.
TASK_ROWS = 250_000


def measure_features(events: DataFrame, dictionary: DataFrame | None, key: str, prefix: str, n: int) -> DataFrame:
    """Count, mean, min and max of the n most frequent items a key, and counts over all items.

    Narrow rows are dealt by key first; a key's items are summed up and only then laid out as columns, in the same
    tasks.  No wide row is shuffled, and the number of tasks follows the events, so that a task's memory does not.
    """
    at = enrich(events, dictionary, ["itemid"])
    label = F.coalesce(F.col("label"), F.col("itemid").cast("string")) if "label" in at.columns else F.col("itemid").cast("string")
    at = at.withColumn("_item", label).withColumn("_value", F.col("valuenum").try_cast("double"))
    sizes = cut(at.groupBy("_item").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    items = [r[0] for r in sizes.where(F.col("_item").isNotNull()).orderBy(F.desc("n"), "_item").limit(n).collect()]
    names = distinct_names(f"{prefix}_{_safe(i)}" for i in items)
    place = F.coalesce(*[F.when(F.col("_item") == item, F.lit(i)) for i, item in enumerate(items)], F.lit(-1))
    own = at.select(key, "itemid", place.alias("_at"), "_value").repartition(total // TASK_ROWS + 1, key)
    one = own.groupBy(key, "itemid", "_at").agg(F.count("*").alias("_rows"), F.count("_value").alias("_n"), F.sum("_value").alias("_sum"), F.min("_value").alias("_min"), F.max("_value").alias("_max"))
    if "label" not in at.columns:
        kinds = F.count("itemid")
    else:
        # an item with several labels has several places, and is one item
        one = one.withColumn("_first", F.row_number().over(Window.partitionBy(key, "itemid").orderBy("_at")))
        kinds = F.count(F.when(F.col("_first") == 1, F.col("itemid")))
    aggs = [F.sum("_rows").alias(f"{prefix}_events"), kinds.alias(f"{prefix}_items")]
    for i, name in enumerate(names):
        of = lambda c: F.when(F.col("_at") == i, F.col(c))  # noqa: B023, E731
        mean = F.sum(of("_sum")) / F.sum(F.when((F.col("_at") == i) & (F.col("_n") > 0), F.col("_n")))
        aggs += [F.coalesce(F.sum(of("_n")), F.lit(0)).cast("long").alias(f"{name}_count"), mean.alias(f"{name}_mean"), F.min(of("_min")).alias(f"{name}_min"), F.max(of("_max")).alias(f"{name}_max")]
    return one.groupBy(key).agg(*aggs)


def stay_event_features(stays: DataFrame, events: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Stays and lengths of stay a visit, and item statistics of the events mapped to it."""
    own = stays.groupBy(key).agg(F.count_distinct("stay_id").alias("icu_stays"), F.avg("los").alias("icu_los_mean"), F.max("los").alias("icu_los_max"))
    mapped = events.join(stays.select("stay_id", key).distinct(), "stay_id")
    return own.join(measure_features(mapped, None, key, "chart", n), key, "left")


def empty_features(cohort: DataFrame, key: str) -> DataFrame:
    return cohort.select(key).distinct()


def assemble(cohort: DataFrame, features: list[DataFrame], grain: str, grouped: bool = False) -> DataFrame:
    """The cohort with each feature table joined left on the grain; overlapping columns stay the cohort's.

    Of several rows of a grain key the one with the smallest digest is taken, whatever the partitioning.
    grouped: the tables have one row a key already, as results of a groupBy on the grain do, so none is looked for.
    """
    one = (lambda df: df) if grouped else (lambda df: first_by_digest(df, [grain]))
    out = one(cohort)
    for f in features:
        if grain not in f.columns:
            continue
        fresh = [c for c in f.columns if c == grain or c not in out.columns]
        out = out.join(one(f.select(*fresh)), grain, "left")
    return out


def numeric_columns(df: DataFrame, skip: Iterable[str], least: float = 0.8) -> DataFrame:
    """One row a text column: present cells, those that parse, and whether it is promoted; one pass over the table."""
    names = [c for c, t in df.dtypes if t == "string" and c not in set(skip)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, present long, parsed long, promoted boolean")
    each = [F.struct(F.lit(c).alias("column"), F.count(c).alias("present"), F.count(F.col(c).try_cast("double")).alias("parsed")) for c in names]
    rows = df.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return rows.withColumn("promoted", (F.col("present") > 0) & (F.col("parsed") >= least * F.col("present")))


def promote(df: DataFrame, skip: Iterable[str], least: float = 0.8) -> DataFrame:
    """df with the text columns that mostly parse as numbers; their other cells become null."""
    names = {r["column"] for r in numeric_columns(df, skip, least).where("promoted").collect()}  # columns of one table
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in names else F.col(c) for c in df.columns])
