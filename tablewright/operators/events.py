"""The event package: alignment to stays, code conversion, summaries, vocabularies and its checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.cells import first_by_digest
from tablewright.sources.lineage import numbered

#: The cohort's columns in order.
COHORT_COLUMNS = ("subject_id", "stay_id", "intime", "outtime", "Age", "gender", "ethnicity", "insurance", "label", "dod", "hadm_id")


def cohort_contract(base: DataFrame) -> DataFrame:
    """Adults with the contracted columns, one row for each stay: of several the one with the smallest digest."""
    return first_by_digest(base.where("Age >= 18 and stay_id is not null and label in (0, 1)").select(*COHORT_COLUMNS), ["stay_id"])


def bucket_events(events: DataFrame, stays: DataFrame, key: str, hours: int = 72, width: int = 1) -> DataFrame:
    """Events of a stay's first hours, counted and averaged in buckets of so many hours."""
    at = events.join(stays.select("stay_id", key, "intime"), key)
    since = F.unix_timestamp("charttime") - F.unix_timestamp("intime")
    at = at.where((since >= 0) & (since < hours * 3600)).withColumn("bucket", F.floor(since / (3600 * width)))
    return at.groupBy("stay_id", "itemid", "bucket").agg(F.count("*").alias("n"), F.avg(F.col("valuenum").try_cast("double")).alias("value"))


def map_codes(codes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Codes of the old system mapped to the new one; those without a mapping go; the root is kept too."""
    out = codes.join(mapping, "icd_code").select("hadm_id", "new_icd_code", F.substring("new_icd_code", 1, 3).alias("root_icd_code"))
    return out.distinct()


def item_summary(events: DataFrame, key: str = "itemid") -> DataFrame:
    number = F.col("valuenum").try_cast("double")
    missing = F.round(F.sum(number.isNull().cast("int")) / F.count("*"), 6)
    return events.groupBy(key).agg(F.count("*").alias("total_count"), F.count_distinct("hadm_id").alias("visits"), missing.alias("missing_rate"))


def summary_tables(families: dict[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """(name, item, total_count, visits, missing_rate) of the summary and features tables of each family (events, item column, value column).

    A summary has every item; a features table those with a value, and counts these.
    """
    parts = []
    for name, (events, key, value) in sorted(families.items()):
        number = F.col(value).try_cast("double") if value else F.col(key)
        some = events.groupBy(F.col(key).cast("string").alias("item")).agg(F.count("*").alias("total_count"), F.count_distinct("hadm_id").alias("visits"), F.count(number).alias("_n"))
        some = some.where("item is not null").withColumn("missing_rate", F.round(1 - F.col("_n") / F.col("total_count"), 6))
        kinds = F.array(F.struct(F.lit(f"{name}_summary").alias("name"), F.col("total_count").alias("n")), F.struct(F.lit(f"{name}_features").alias("name"), F.col("_n").alias("n")))
        parts.append(some.select("item", "visits", "missing_rate", F.inline(kinds)).where("n > 0").select("name", "item", F.col("n").alias("total_count"), "visits", "missing_rate"))
    return reduce(DataFrame.unionByName, parts)


#: Items of visits that a task of family_tables() counts.
TASK_ITEMS = 600_000


def family_tables(sources: list[tuple[DataFrame, Column, dict[str, tuple[Column, Column]]]], sized: DataFrame | None = None) -> DataFrame:
    """(name, item, total_count, visits, missing_rate) of the summary and features table of every family, and its totals (item '*').

    sources: (events, visit, {family: (item, value)}); a family has one source.  Each event moves once, to its visit, with what all
    its families need; a visit's items are then counted where they lie, so that only sums move on.  Events without a visit are dealt out.
    The number of tasks follows the events, so that a task's memory does not.  sized: a table with about as many rows as the largest
    source, which is counted for that; left out, each source is.
    """
    total = None if sized is None else sized.count()
    names = [name for _, _, families in sources for name in families]
    if len(set(names)) < len(names):
        raise ValueError("a family has more than one source")
    parts = []
    for events, visit, families in sources:
        named = sorted(families.items())
        flat = [c for i, (_, (item, value)) in enumerate(named) for c in (item.alias(f"item{i}"), value.isNotNull().alias(f"filled{i}"))]
        moved = events.select(visit.cast("long").alias("visit"), *flat)
        spread = F.coalesce(F.col("visit"), F.xxhash64(*[F.col(f"item{i}") for i in range(len(named))]))
        tasks = (events.count() if total is None else total) * len(named) // TASK_ITEMS + 1
        moved = moved.withColumn("place", spread).repartition(tasks, "place")
        # items: of each visit once, then over visits
        kinds = [F.struct(F.lit(i).alias("kind"), F.col(f"item{i}").cast("string").alias("item"), F.col(f"filled{i}").cast("int").alias("filled")) for i in range(len(named))]
        rows = moved.select("place", "visit", F.inline(F.array(*kinds))).where("item is not null")
        own = rows.groupBy("place", "visit", "kind", "item").agg(F.count("*").alias("n"), F.sum("filled").alias("filled"))
        own = own.groupBy("kind", "item").agg(F.sum("n").alias("total_count"), F.count("visit").alias("visits"), F.sum("filled").alias("_n"))
        family = F.element_at(F.array(*[F.lit(name) for name, _ in named]), F.col("kind") + 1)
        parts.append(own.select(family.alias("family"), "item", "total_count", "visits", "_n"))
        # totals: a row a visit with the sums of all families
        here = [F.col(f"item{i}").isNotNull() for i in range(len(named))]
        sums = [c for i, x in enumerate(here) for c in (F.count_if(x).alias(f"n{i}"), F.count_if(x & F.col(f"filled{i}")).alias(f"f{i}"))]
        every = moved.groupBy("place", "visit").agg(*sums)
        totals = [F.struct(F.lit(name).alias("family"), F.lit("*").alias("item"), F.sum(f"n{i}").alias("total_count"), F.count_if(F.col("visit").isNotNull() & (F.col(f"n{i}") > 0)).alias("visits"), F.sum(f"f{i}").alias("_n")) for i, (name, _) in enumerate(named)]
        parts.append(every.agg(F.array(*totals).alias("t")).select(F.inline("t")).where("total_count > 0"))
    some = reduce(DataFrame.unionByName, parts).withColumn("missing_rate", F.round(1 - F.col("_n") / F.col("total_count"), 6))
    kinds = F.array(F.struct(F.concat("family", F.lit("_summary")).alias("name"), F.col("total_count").alias("n")), F.struct(F.concat("family", F.lit("_features")).alias("name"), F.col("_n").alias("n")))
    return some.select("item", "visits", "missing_rate", F.inline(kinds)).where("n > 0").select("name", "item", F.col("n").alias("total_count"), "visits", "missing_rate")


def stay_demo(cohort: DataFrame) -> DataFrame:
    """What is known of a stay's person."""
    return cohort.select("stay_id", "Age", "gender", "ethnicity", "insurance")


def stay_static(stays: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """(stay_id, root, value): each root of the codes a stay has, once."""
    return stays.select("stay_id", key).join(codes.select(key, F.col("root_icd_code").alias("root")), key).select("stay_id", "root").distinct().withColumn("value", F.lit(1))


def label_eligible(stays: DataFrame, include: int = 72, predict: int = 2) -> DataFrame:
    """Stays of at least so many whole hours."""
    whole = F.floor((F.unix_timestamp("outtime") - F.unix_timestamp("intime")) / 3600)
    return stays.withColumn("hours", whole).where(F.col("hours") >= include + predict)


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Each value and its place in sorted order, from 0; no task sees all values."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return numbered(values, ["value"]).select("value", F.col("_i").alias("idx"))


def check(name: str, observed: Column, expected: int = 0) -> Column:
    return F.struct(F.lit(name).alias("name"), (observed == expected).alias("passed"), observed.cast("long").alias("observed"), F.lit(expected).cast("long").alias("expected"))


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def package_checks(cohort: DataFrame, labels: DataFrame, features: dict[str, DataFrame], include: int = 72, predict: int = 2) -> DataFrame:
    """A row a check: (name, passed, observed, expected); each table is read for one aggregate."""
    own = cohort.agg(
        F.array(
            check("cohort_not_empty", (F.count("*") == 0).cast("long")),
            check("adults", count_if(F.coalesce(F.col("Age") < 18, F.lit(True)))),
            check("label_domain", count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)))),
            check("stay_not_null", count_if(F.col("stay_id").isNull())),
            check("stay_unique", F.count("stay_id") - F.count_distinct("stay_id")),
            check("times_in_order", count_if(F.col("outtime") < F.col("intime"))),
            check("label_rule", count_if(F.col("label") != F.when(F.col("dod").between(F.col("intime"), F.col("outtime")), 1).otherwise(0))),
        ).alias("c")
    ).select(F.inline("c"))
    hours = F.floor((F.unix_timestamp("outtime") - F.unix_timestamp("intime")) / 3600)
    known = cohort.select("stay_id", hours.alias("_hours"))
    mine = labels.join(known, "stay_id", "left").agg(
        F.array(check("labels_subset", count_if(F.col("_hours").isNull())), check("label_window", count_if(F.col("_hours") < include + predict)), check("labels_unique", F.count("*") - F.count_distinct("stay_id"))).alias("c")
    ).select(F.inline("c"))
    parts = [own, mine]
    for name, f in features.items():
        extra = f.select("stay_id").distinct().join(known, "stay_id", "left_anti")
        parts.append(extra.agg(F.array(check(f"{name}_subset", F.count("*"))).alias("c")).select(F.inline("c")))
    return reduce(DataFrame.unionByName, parts)


#: Files that no package of tables may hold.
MODEL_FILES = r"(?i)\.(pt|pth|onnx)$"
LABEL_COLUMNS = ("stay_id", "label")


def verdict(name: str, wrong: dict[str, Column], details: Column | None = None) -> Column:
    """A check that passes where nothing is wrong: (name, passed, observed as JSON, details)."""
    observed = F.struct(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in wrong.items()])
    passed = reduce(lambda a, b: a & b, (F.coalesce(v, F.lit(0)) == 0 for v in wrong.values()))
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"), F.to_json(observed).alias("observed"), (F.lit("") if details is None else details).alias("details"))


def inventory_checks(files: DataFrame, expected: dict[str, tuple[str, list[str], bool]]) -> DataFrame:
    """files (path) against {check: (folder, paths, nothing else allowed)}; details name up to 20 missing or extra paths."""
    want = files.sparkSession.createDataFrame([(k, f"{folder}{p}") for k, (folder, paths, _) in expected.items() for p in paths], "name string, path string").withColumn("want", F.lit(1))
    alone = {k: folder for k, (folder, _, only) in expected.items() if only}
    there = files.select("path").distinct()
    rows = want.join(there.withColumn("have", F.lit(1)), "path", "left").select("name", "path", F.col("have").isNull().cast("int").alias("missing"), F.lit(0).alias("extra"))
    for k, folder in alone.items():
        more = there.where(F.col("path").startswith(folder)).join(want.where(F.col("name") == k).select("path"), "path", "left_anti")
        rows = rows.unionByName(more.select(F.lit(k).alias("name"), "path", F.lit(0).alias("missing"), F.lit(1).alias("extra")))
    bad = F.array_sort(F.collect_list(F.when(F.col("missing") + F.col("extra") > 0, F.col("path"))))  # paths of one folder
    out = rows.groupBy("name").agg(F.sum("missing").alias("missing"), F.sum("extra").alias("extra"), F.array_join(F.slice(bad, 1, 20), ",").alias("bad"))
    return out.select(F.inline(F.array(*[F.struct(F.col("name").alias("name"), ((F.col("missing") == 0) & (F.col("extra") == 0)).alias("passed"), F.to_json(F.struct(F.col("missing"), F.col("extra"))).alias("observed"), F.col("bad").alias("details"))])))


def absent(table: DataFrame | None, columns: Iterable[str], name: str) -> str:
    """What of a table a check lacks: the table itself, or columns."""
    return name if table is None else ",".join(f"{name}.{c}" for c in columns if c not in table.columns)


def verdicts(table: DataFrame | None, name: str, checks: dict[str, tuple[tuple[str, ...], Callable[[], Column]]]) -> list[DataFrame]:
    """The checks of one table in one pass; a check whose columns are not there fails and says which, without being computed."""
    spark, lost = SparkSession.active(), {k: absent(table, columns, name) for k, (columns, _) in checks.items()}
    failed = [(k, False, f'{{"absent":{1 + x.count(",")}}}', f"absent: {x}") for k, x in lost.items() if x]
    out = [spark.createDataFrame(failed, "name string, passed boolean, observed string, details string")] if failed else []
    held = [make() for k, (_, make) in checks.items() if not lost[k]]
    return out + ([table.agg(F.array(*held).alias("c")).select(F.inline("c"))] if held else [])


def with_expected(report: DataFrame) -> DataFrame:
    """A report with expected: what observed shows where a check passes."""
    return report.withColumn("expected", F.regexp_replace("observed", ":-?[0-9]+", ":0"))


def validation_report(cohort: DataFrame | None, labels: DataFrame | None, features: dict[str, DataFrame | None], diagnosis_columns: tuple[list[str], list[str]], products: dict[str, DataFrame | None], files: DataFrame, expected: dict[str, tuple[str, list[str], bool]], snapshots: tuple[str, str], include: int = 72, predict: int = 2) -> DataFrame:
    """(name, passed, observed, details) of every check of a package.

    Tables: cohort, labels (stay_id, label), features by file name, and per-stay products by name, all with
    stay_id; None for one that is not there.  diagnosis_columns and snapshots are pairs of what is there and what should
    be; files (path) is the inventory.  Only schemas are looked at first: a check that lacks a table or a
    column fails and names it, the others are taken.
    """
    columns = lambda name, have, want: verdict(name, {"differs": F.lit(int(list(have) != list(want)))}, F.lit("" if list(have) == list(want) else ",".join(have)))
    hours = F.floor((F.unix_timestamp("outtime") - F.unix_timestamp("intime")) / 3600)
    died = F.coalesce(F.col("dod").between(F.col("intime"), F.col("outtime")), F.lit(False)).cast("int")
    parts = verdicts(
        cohort,
        "cohort",
        {
            "cohort_schema": ((), lambda: columns("cohort_schema", cohort.columns, COHORT_COLUMNS)),
            "labels_schema": ((), lambda: columns("labels_schema", labels.columns if labels is not None else [], LABEL_COLUMNS)),
            "diagnosis_schema": ((), lambda: columns("diagnosis_schema", *diagnosis_columns)),
            "original_data_untouched": ((), lambda: verdict("original_data_untouched", {"differs": F.lit(int(snapshots[0] != snapshots[1]))})),
            "cohort_adults": (("Age",), lambda: verdict("cohort_adults", {"under_age": count_if(F.coalesce(F.col("Age") < 18, F.lit(True)))})),
            "cohort_label_domain": (("label",), lambda: verdict("cohort_label_domain", {"outside": count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(True)))})),
            "cohort_stay_keys": (("stay_id",), lambda: verdict("cohort_stay_keys", {"duplicates": F.count("stay_id") - F.count_distinct("stay_id"), "missing": count_if(F.col("stay_id").isNull())})),
            "cohort_mortality_rule": (("label", "dod", "intime", "outtime"), lambda: verdict("cohort_mortality_rule", {"mismatches": count_if(~F.col("label").eqNullSafe(died))})),
        },
    )
    lost = absent(cohort, ("stay_id", "intime", "outtime"), "cohort")
    known = None if lost else cohort.where("stay_id is not null").groupBy("stay_id").agg(F.min(hours).alias("_hours"))

    def without(name: str, what: str) -> DataFrame:
        told = (name, False, f'{{"absent":{1 + what.count(",")}}}', f"absent: {what}")
        return SparkSession.active().createDataFrame([told], "name string, passed boolean, observed string, details string")

    lacks = lambda *more: ",".join(x for x in (lost, *more) if x)
    if no := lacks(absent(labels, LABEL_COLUMNS, "labels")):
        parts += [without(k, no) for k in ("labels_keys_and_domain", "labels_observation_window")]
    else:
        at = labels.join(known.withColumn("_known", F.lit(1)), "stay_id", "left")
        short = F.col("_known").isNotNull() & F.coalesce(F.col("_hours") < include + predict, F.lit(True))
        few = at.where(short).select("stay_id").distinct().orderBy("stay_id").limit(20).collect()  # 20 rows
        shown = F.lit(",".join(str(r[0]) for r in few))
        mine = at.agg(
            F.array(
                verdict("labels_keys_and_domain", {"outside_cohort": F.count_distinct(F.when(F.col("_known").isNull(), F.col("stay_id"))), "outside_domain": count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(True)))}),
                verdict("labels_observation_window", {"short_stays": F.count_distinct(F.when(short, F.col("stay_id"))), "duplicate_label_rows": F.count("*") - F.count_distinct("stay_id")}, shown),
            ).alias("c")
        )
        parts.append(mine.select(F.inline("c")))
    if no := lacks(*(absent(f, ("stay_id",), n) for n, f in sorted(features.items()))):
        parts.append(without("feature_stays_in_cohort", no))
    else:
        extras = [f.select("stay_id").distinct().join(known, "stay_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(n).alias("file"), "n") for n, f in sorted(features.items())]
        parts.append(reduce(DataFrame.unionByName, extras).agg(verdict("feature_stays_in_cohort", {"outside": F.sum("n")}, F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("file")))), ",")).alias("v")).select("v.*"))
    if no := ",".join(x for x in (absent(labels, ("stay_id",), "labels"), *(absent(p, ("stay_id",), n) for n, p in sorted(products.items()))) if x):
        parts.append(without("stay_csv_completeness", no))
    else:
        wanted = labels.select("stay_id").where("stay_id is not null").distinct()
        counted = []
        for n, p in sorted(products.items()):
            both = wanted.withColumn("_w", F.lit(1)).join(p.select("stay_id").distinct().withColumn("_h", F.lit(1)), "stay_id", "full_outer")
            counted.append(both.agg(count_if(F.col("_h").isNull()).alias("missing"), count_if(F.col("_w").isNull()).alias("extra")).select(F.lit(n).alias("product"), "missing", "extra"))
        parts.append(reduce(DataFrame.unionByName, counted).agg(verdict("stay_csv_completeness", {"missing": F.sum("missing"), "extra": F.sum("extra")}).alias("v")).select("v.*"))
    models = files.agg(verdict("no_model_artifacts", {"files": count_if(F.col("path").rlike(MODEL_FILES))}).alias("v")).select("v.*")
    return reduce(DataFrame.unionByName, [*parts, models, inventory_checks(files, expected)])
