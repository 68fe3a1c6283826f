"""Cohorts: visit base, outcome labels, key and code filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.cells import clean_code

#: Key columns in the order in which one is inferred.
KEY_ORDER = ("hadm_id", "stay_id", "subject_id", "case_id", "row_id")


def infer_key(*columns: list[str], order=KEY_ORDER) -> str | None:
    """The first known key that all the column lists share."""
    return next((k for k in order if all(k in c for c in columns)), None)


def dedupe(df: DataFrame, keys: list[str], tie: list) -> DataFrame:
    """One row for each non-null key, the first by the tie-break columns, then by digest; keys meet before rows move."""
    rest = [c for c in df.columns if c not in keys]
    named = [(c if isinstance(c, Column) else F.col(c)).alias(f"t{i}") for i, c in enumerate(tie)]
    order = F.struct(*named, F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in rest]).alias("digest"))
    one = df.dropna(subset=keys).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return one.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def with_length_of_stay(df: DataFrame, start: str = "intime", end: str = "outtime", name: str = "los") -> DataFrame:
    """Fractional days between two times, unless the column is there already."""
    if name in df.columns:
        return df
    return df.withColumn(name, (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(86400.0))


def visit_base(stays: DataFrame | None, patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """Stays (or admissions) with their subject's and admission's columns, one row for each grain key."""
    base = stays if stays is not None else admissions
    out = base.join(patients, "subject_id", "left")
    if stays is not None:
        extra = [c for c in admissions.columns if c == "hadm_id" or c not in out.columns]
        out = with_length_of_stay(out.join(admissions.select(*extra), "hadm_id", "left"))
    for new, old in (("Age", "anchor_age"), ("ethnicity", "race")):
        if new not in out.columns and old in out.columns:
            out = out.withColumn(new, F.col(old))
    return dedupe(out, ["stay_id" if stays is not None else "hadm_id"], ["subject_id", "hadm_id"])


def label_event_in_window(df: DataFrame, event: str, start: str, end: str) -> DataFrame:
    return df.withColumn("label", F.when(F.col(event).between(F.col(start), F.col(end)), 1).otherwise(0))


def label_readmission(df: DataFrame, key: str, days: int = 30, subject: str = "subject_id", start: str = "intime", end: str = "outtime") -> DataFrame:
    """1 where the subject's next start lies within so many days after this end."""
    following = F.lead(start).over(Window.partitionBy(subject).orderBy(start, key))
    gap = F.unix_timestamp(following) - F.unix_timestamp(F.col(end))
    return df.withColumn("label", F.when((gap > 0) & (gap <= days * 86400), 1).otherwise(0))


def label_long_stay(df: DataFrame, days: float = 7, los: str = "los") -> DataFrame:
    return df.withColumn("label", F.coalesce((F.col(los).try_cast("double") > days).cast("int"), F.lit(0)))


def label_constant(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.lit(1))


def label_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def case_key_filter(cohort: DataFrame, keys: DataFrame, preferred: str | None = None) -> DataFrame:
    """Rows of the cohort whose key is among the keys, compared as text."""
    key = preferred if preferred in cohort.columns and preferred in keys.columns else infer_key(cohort.columns, keys.columns)
    if key is None:
        raise ValueError("cohort and keys share no known key column")
    wanted = keys.select(F.col(key).cast("string").alias("_key")).distinct()
    return cohort.join(wanted, F.col(key).cast("string") == F.col("_key"), "left_semi")


def resolve_code_terms(dictionary: DataFrame, terms: list[str], most: int = 25, picked: int = 5) -> DataFrame:
    """Three-character code prefixes whose titles hold any term, by frequency, with examples."""
    hit = reduce(lambda a, b: a | b, (F.contains(F.lower("long_title"), F.lit(t.lower())) for t in terms))
    prefix = F.substring(clean_code(F.col("icd_code")), 1, 3)
    found = dictionary.where(hit).withColumn("prefix", prefix)
    examples = Window.partitionBy("prefix").orderBy("icd_code", "icd_version", "long_title")
    found = found.withColumn("_rank", F.row_number().over(examples))
    out = found.groupBy("prefix").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("_rank") <= 3, F.col("icd_code")))), "|").alias("examples"))
    ranked = out.orderBy(F.desc("n"), "prefix").limit(most)  # a report of at most so many candidates
    w = Window.orderBy(F.desc("n"), "prefix")
    return ranked.withColumn("selected", F.row_number().over(w) <= picked)


def matches_prefix(code: Column, prefixes: list[str]) -> Column:
    cleaned = clean_code(code)
    return reduce(lambda a, b: a | b, (cleaned.startswith(p.upper().replace(".", "")) for p in prefixes))


def filter_code_cohort(cohort: DataFrame, codes: DataFrame, prefixes: list[str], primary_only: bool = False) -> DataFrame:
    """Cohort rows with a code under one of the prefixes; no prefixes let everything pass."""
    if not prefixes:
        return cohort
    hit = codes.where(matches_prefix(F.col("icd_code"), prefixes))
    if primary_only:
        hit = hit.where(F.col("seq_num").try_cast("int") == 1)
    return cohort.join(hit.select("hadm_id"), "hadm_id", "left_semi")
