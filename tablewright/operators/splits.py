"""Splits of keys and tables: by ratio, by count, nested, closed over ids, and by coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.sources.lineage import cut, numbered


def order_key(seed: str, key: str) -> Column:
    """A digest that orders keys the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))


def one_stratum(df: DataFrame, key: str, stratum: str | None) -> DataFrame:
    """Each key once, in the smallest of its strata."""
    return df.groupBy(key).agg(F.min(stratum).alias(stratum)) if stratum and stratum != key else df.select(key).distinct()


def placed(df: DataFrame, key: str, stratum: str | None, seed: str, bins: int = 256) -> DataFrame:
    """df with _i, the row's place (from 1) in its stratum by digest, and _n, the stratum's size.

    Places are counted inside bins of the digest and bins are added up, so that no task
    holds a whole stratum.
    """
    s = F.col(stratum).cast("string") if stratum else F.lit("")
    at = df.withColumn("_s", F.coalesce(s, F.lit("\u0000"))).withColumn("_h", order_key(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = at.groupBy("_s", "_b").agg(F.count("*").alias("_c"))  # strata times bins rows
    w = Window.partitionBy("_s").orderBy("_b")
    before = sizes.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy("_s"))).drop("_c")
    inside = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key))
    return at.withColumn("_r", inside).join(before, ["_s", "_b"]).withColumn("_i", F.col("_r") + F.col("_before")).drop("_r", "_b", "_before")


def by_ratio(df: DataFrame, key: str, train: float, validation: float, seed: str, stratum: str | None = None) -> DataFrame:
    """(key, split): rounded shares of each stratum, at least one of train and validation where it has three rows or more."""
    at = placed(one_stratum(df, key, stratum), key, stratum, seed)
    n = F.col("_n")
    n_train = F.when(n >= 3, F.greatest(F.floor(n * train + 0.5), F.lit(1))).otherwise(1)
    n_val = F.when(n >= 3, F.greatest(F.floor(n * validation + 0.5), F.lit(1))).when(n == 2, 1).otherwise(0)
    return at.select(key, F.when(F.col("_i") <= n_train, "train").when(F.col("_i") <= n_train + n_val, "validation").otherwise("test").alias("split"))


def quotas(sizes: DataFrame, count: int) -> DataFrame:
    """(stratum, quota): count shared by largest remainder, ties by size, then name; sizes has a row a stratum."""
    total = max(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 1)
    at = cut(sizes.withColumn("q", F.floor(F.col("n") * count / F.lit(total))).withColumn("f", F.col("n") * count % F.lit(total)))
    left = min(count, total) - (at.agg(F.sum("q")).first()[0] or 0)
    more = at.orderBy(F.desc("f"), F.desc("n"), "_s").limit(max(left, 0)).select("_s", F.lit(1).alias("_more"))
    return at.join(more, "_s", "left").select("_s", (F.col("q") + F.coalesce("_more", F.lit(0))).cast("long").alias("quota"))


def by_count(df: DataFrame, key: str, train: int, validation: int, test: int | None, seed: str, stratum: str | None = None) -> DataFrame:
    """(key, split): so many keys each, shared among strata by largest remainder; test None takes the rest."""
    at = cut(placed(one_stratum(df, key, stratum), key, stratum, seed))
    sizes = cut(at.groupBy("_s").agg(F.count("*").alias("n")))
    a = quotas(sizes, train).withColumnRenamed("quota", "qa")
    rest = sizes.join(a, "_s").select("_s", (F.col("n") - F.col("qa")).alias("n"))
    b = quotas(rest, validation).withColumnRenamed("quota", "qb")
    out = at.join(a, "_s").join(b, "_s")
    name = F.when(F.col("_i") <= F.col("qa"), "train").when(F.col("_i") <= F.col("qa") + F.col("qb"), "validation")
    if test is None:
        return out.select(key, name.otherwise("test").alias("split"))
    left = sizes.join(a, "_s").join(b, "_s").select("_s", (F.col("n") - F.col("qa") - F.col("qb")).alias("n"))
    c = quotas(left, test).withColumnRenamed("quota", "qc")
    return out.join(c, "_s").select(key, name.when(F.col("_i") <= F.col("qa") + F.col("qb") + F.col("qc"), "test").alias("split")).where("split is not null")


def manifest(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("n_keys"))


def nested_prefix(keys: DataFrame, key: str, count: int, seed: str) -> DataFrame:
    """The first so many keys by digest: a larger count contains a smaller one."""
    return keys.select(key).distinct().withColumn("_h", order_key(seed, key)).orderBy("_h", key).limit(count).drop("_h")


def id_closure(stays: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(kind, id): all stays, visits and subjects that the keys lead to."""
    subjects = stays.join(keys.select(key).distinct(), key, "left_semi").select("subject_id").distinct() if key == "subject_id" else None
    rows = stays.join(subjects, "subject_id", "left_semi") if subjects is not None else stays.join(keys.select(key).distinct(), key, "left_semi")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("id")) for k in ("stay_id", "hadm_id", "subject_id")])
    return rows.select(F.inline(kinds)).where("id is not null").distinct()


#: Keys by which a raw table is cut, the first that it has.
CUT_ORDER = ("stay_id", "hadm_id", "subject_id")


def subset_raw(tables: dict[str, DataFrame], closure: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables cut by the first id they have, dictionaries whole, others left out; and a row a table on what was done."""
    out, report = {}, []
    for name, df in sorted(tables.items()):
        key = next((k for k in CUT_ORDER if k in df.columns), None)
        if name.split("/")[-1].startswith("d_"):
            out[name], mode = df, "copied"
        elif key is None:
            report.append(df.limit(0).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("path"), F.lit("skipped").alias("mode"), "n_rows"))
            continue
        else:
            out[name], mode = df.join(closure.where(F.col("kind") == key).select(F.col("id").alias(key)), key, "left_semi"), f"filtered_by_{key}"
        report.append(out[name].agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("path"), F.lit(mode).alias("mode"), "n_rows"))
    return out, reduce(DataFrame.unionByName, report)


def subset_generic(tables: dict[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables that hold the key are cut by it, the others stay whole."""
    return {n: df.join(keys.select(key).distinct(), key, "left_semi") if key in df.columns else df for n, df in tables.items()}


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("path"), "n_rows") for n, df in sorted(tables.items())])


SPLITS = ("train", "validation", "test")


def layout(tables: dict[str, DataFrame]) -> str:
    """clinical where raw tables lie in hosp and icu folders, else generic."""
    folders = {n.split("/")[0] for n in tables}
    return "clinical" if {"hosp", "icu"} <= folders else "generic"


def prepare(raw: dict[str, DataFrame], package: dict[str, DataFrame], split: DataFrame, key: str, stays: DataFrame | None = None) -> tuple[dict[tuple[str, str, str], DataFrame], DataFrame]:
    """The tables of each split by (split, part, path), part keys, raw or reference, and a record (split, part, path, n_rows) of them.

    split is (key, split).  Raw tables of a clinical layout are cut by all ids that the keys lead to in
    stays, those of any other by the key; reference tables by the key.
    """
    out = {}
    for name in SPLITS:
        keys = split.where(F.col("split") == name).select(key).distinct()
        out[name, "keys", "keys"] = keys
        cut_ = subset_raw(raw, id_closure(stays, keys, key))[0] if layout(raw) == "clinical" and stays is not None else subset_generic(raw, keys, key)
        out |= {(name, "raw", p): df for p, df in cut_.items()}
        out |= {(name, "reference", p): df for p, df in subset_generic(package, keys, key).items()}
    rows = [df.agg(F.count("*").alias("n_rows")).select(F.lit(s).alias("split"), F.lit(part).alias("part"), F.lit(p).alias("path"), "n_rows") for (s, part, p), df in sorted(out.items())]
    return out, reduce(DataFrame.unionByName, rows)


def coverage_select(errors: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """(key, place): greedily the key that adds most new subtypes, then classes, then has most errors, then the smaller digest.

    Of keys with the same subtypes and classes only the first in order can add anything, so candidates are one a
    combination.  Once nothing new is left, which is after as many rounds as there are subtypes and classes
    at most, all further places go by order in one sort: jobs do not grow with k.
    """
    sets = errors.groupBy(key).agg(F.sort_array(F.collect_set("error_subtype")).alias("subs"), F.sort_array(F.collect_set("error_class")).alias("classes"), F.count("*").alias("n"))
    own = cut(sets.withColumn("_h", order_key(seed, key)).withColumn("_less", -F.col("n")))
    order = ["_less", "_h", key]
    candidates = cut(own.groupBy("subs", "classes").agg(F.min(F.struct(*order)).alias("o")).select("subs", "classes", "o.*"))
    picked, subs, classes = [], [], []
    fresh = lambda c, have: F.size(F.array_except(c, F.array(*map(F.lit, have)).cast("array<string>")))
    while len(picked) < k:
        at = candidates.withColumns({"_s": fresh("subs", subs), "_c": fresh("classes", classes)}).where("_s + _c > 0")
        best = at.orderBy(F.desc("_s"), F.desc("_c"), *order).first()
        if best is None:
            break
        picked.append(best[key])
        subs, classes = sorted({*subs, *best["subs"]}), sorted({*classes, *best["classes"]})
    first = errors.sparkSession.createDataFrame(list(zip(picked, range(1, len(picked) + 1))), f"{key} {dict(own.dtypes)[key]}, place long")
    left = own.join(first.select(key), key, "left_anti").orderBy(*order).limit(k - len(picked))
    return first.unionByName(numbered(left, order).select(key, (F.col("_i") + len(picked) + 1).cast("long").alias("place")))


def split_checks(split: DataFrame, key: str, universe: DataFrame) -> DataFrame:
    """(name, observed): keys in several splits, keys of no split, keys unknown to the universe."""
    many = split.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("observed")).select(F.lit("overlapping_keys").alias("name"), "observed")
    none = universe.select(key).distinct().join(split.select(key), key, "left_anti").agg(F.count("*").alias("observed")).select(F.lit("uncovered_keys").alias("name"), "observed")
    odd = split.select(key).distinct().join(universe.select(key), key, "left_anti").agg(F.count("*").alias("observed")).select(F.lit("unknown_keys").alias("name"), "observed")
    return many.unionByName(none).unionByName(odd)


def route_rows(rows: DataFrame, overrides: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """Each row of a table with the split of its key, where an override by row index goes first."""
    routed = rows.join(overrides.select("_row_index", F.col(key).alias("_override")), "_row_index", "left").withColumn("_key", F.coalesce("_override", F.col(key)))
    return routed.join(split.select(F.col(key).alias("_key"), "split"), "_key").drop("_override", "_key")


def split_log(log: DataFrame, train_keys: DataFrame, key: str) -> DataFrame:
    """The modification log with the side its key falls on and the rows' texts."""
    mark = train_keys.select(key).distinct().withColumn("_t", F.lit(True))
    payload = lambda names: F.to_json(F.struct(*[F.col(c) for c in sorted(names)]))
    out = log.join(mark, key, "left").withColumn("side", F.when(F.col("_t"), "train").otherwise("test")).drop("_t")
    return out.withColumn("row_json", payload([c for c in log.columns if c != key]))
