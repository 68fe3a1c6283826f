"""Quality rules: a table of thresholds compiled into one projection.

Measures of the whole text are bound once a row; each rule of RULES becomes an
integer comparison of two measures, so every engine decides alike.  kept is false
where the base rule fails or any rule of the table does; failed_rules names them.

Defined results: a null text counts as empty; empty text has no words and fails
the base rule.  Repeated rows are judged one by one and alike.  An empty table gives no
rows; very long texts are measured whole.  Other columns pass by unread; only doc_id and
text are looked at.  Stop words are those of four languages: a text in any other one has
none and fails that rule; hand in other RULES for such corpora.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.native import let, words
from tablewright.llm.session import table

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he are this or "
    "der die das und zu den von mit ist nicht ein eine für auf im dem sich "
    "le la les de des et un une que est dans pour pas sur par "
    "el los las y en por con una para no del se lo al"
).split()
#: (name, measure, times, "<=" or ">=", measure or None, bound): times * measure <=/>= bound * other measure.
RULES = (
    ("too_long", "n_words", 1, "<=", None, 1_000_000),
    ("short_words", "word_chars", 1, ">=", "n_words", 2),
    ("long_words", "word_chars", 1, "<=", "n_words", 30),
    ("symbols", "n_symbols", 100, "<=", "n_words", 40),
    ("stop_words", "n_stop_words", 100, ">=", "n_words", 2),
    ("dup_lines", "n_dup_lines", 100, "<=", "n_lines", 40),
    ("upper_words", "n_upper_words", 100, "<=", "n_words", 60),
)


def repeat_words(found: Column) -> Column:
    """How many of the words lie in a window of WINDOW words that the text has twice or more."""

    def positions(h: Column) -> Column:
        return let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size(s) - 1),
                        lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]).eqNullSafe(F.lit(True)) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]).eqNullSafe(F.lit(True)),
                    ),
                    lambda k: F.get(s, k)["i"],
                )
            ),
        )

    def covered(p: Column) -> Column:
        steps = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW).cast("long"), lambda acc, k: acc + F.least(F.lit(WINDOW), F.get(p, k) - F.get(p, k - 1)))
        return F.when(F.size(p) > 1, steps).otherwise(F.lit(WINDOW).cast("long"))

    windows = F.transform(F.sequence(F.lit(1), F.size(found) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(found, i, F.lit(WINDOW))))
    count = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(positions(h), covered)))
    return F.when(F.size(found) <= WINDOW, F.lit(0).cast("long")).otherwise(count)


def measures(text: Column) -> Column:
    def of(w: Column) -> Column:
        stop = F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))
        upper = F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(stop).cast("long").alias("n_stop_words"),
            F.size(upper).cast("long").alias("n_upper_words"),
            repeat_words(w).alias("n_repeat_words"),
        )

    return let(words(text), of)


def line_measures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def compiled(rules=RULES) -> Column:
    """The names of the rules that a row fails, as an array."""

    def broken(rule) -> Column:
        name, measure, times, how, other, bound = rule
        left, right = F.lit(times) * F.col(measure), F.lit(bound) * (F.col(other) if other else F.lit(1))
        return F.when(~(left <= right) if how == "<=" else ~(left >= right), F.lit(name))

    return F.array_compact(F.array(*map(broken, rules)))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = docs.select("doc_id", measures(text).alias("m"), line_measures(text).alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    at = at.select("doc_id", "m.n_words", "m.word_chars", "n_symbols", "l.n_dup_lines", "m.n_repeat_words", "l.n_lines", "m.n_stop_words", "m.n_upper_words")
    base = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    at = at.withColumn("base_failed", base).withColumn("failed_rules", F.array_join(compiled(rules), ","))
    return at.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _rule_sql(rule) -> str:
    name, measure, times, how, other, bound = rule
    return f"CASE WHEN NOT ({times} * {measure} {how} {bound} * {other or 1}) THEN '{name}' END"


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, count(*) OVER f AS n, list(word) OVER f AS words FROM p WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, words) AS times FROM g WHERE n = {WINDOW}),
c AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS later FROM h WHERE times > 1),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(later - i, {WINDOW})))::BIGINT AS n_repeat_words FROM c GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(d.t, '{SYMBOLS}'))::BIGINT AS n_symbols, (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l.l)::BIGINT AS n_lines,
  len(list_filter(w.w, lambda x: lower(x) IN ({', '.join(repr(x) for x in STOP_WORDS)})))::BIGINT AS n_stop_words,
  len(list_filter(w.w, lambda x: upper(x) = x AND lower(x) <> x))::BIGINT AS n_upper_words
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {', '.join(map(_rule_sql, RULES))}) AS failed_rules FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM b
"""
