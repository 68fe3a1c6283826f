"""Personal data: pattern spans, and terms that reveal them by co-occurrence.

Base spans are found by four patterns (FIXED below), as the leftmost non-overlapping
matches of each kind that pass its check.  The values found are the protected entities.
Over all distinct texts of the corpus, a term t reveals an entity c by the pointwise
mutual information PMI(t; c) = log2(p(t, c) / (p(t) p(c))), against the entity's own
information IC(c) = -log2 p(c).  A term is disclosing where
    PMI / IC >= GENERALISE,  n(t, c) >= SUPPORT,  n(t, c) * IC(c) >= EVIDENCE bits;
it is removed where PMI / IC >= REMOVE too, else generalised to [WORD] or [NUMBER].
Disclosing terms get spans of kind "term" wherever they stand outside base spans.

Counts run over all texts; the terms counted corpus-wide are those that reached
SUPPORT with an entity, so that the other words are never shuffled.

Defined results: null text counts as empty and has no spans.  Repeated rows are found
alike and count once in the statistics.  Offsets are code points, end exclusive.  In
redact() a null text stays null, other columns stay as they are, and n_chars, where
present, becomes the new length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.native import GAP, let
from tablewright.llm.session import cut, small, table

# Possessive loops and starts bound to the beginning of a run keep matching linear; the matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

GENERALISE, REMOVE = 0.9, 0.97
SUPPORT, EVIDENCE = 3, 30.0
SLICES = 16
EDGE = ".,;:!?()\"'"
SPAN = "array<struct<start:int,end:int,value:string>>"
TAGS = "array<struct<start:int,end:int,tag:string>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        v = F.substring(d, F.length(d) + 1 - i, F.lit(1)).cast("int")
        twice = v * 2 - F.when(v > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def valid_card(m: Column) -> Column:
    return let(digits(m), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(OCTETS),
    "card": valid_card,
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}
#: (pattern, what a text must contain to be searched at all)
PATTERNS = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, None), "phone": (PHONE, "+")}


def spans(text: Column, pattern: Column, check) -> Column:
    """Matches as array<struct<start, end, value>>: what stands between them gives the offsets."""

    def located(m: Column, between: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(between, i))
            end = start + F.length(F.get(m, i))
            here = F.array(F.struct(start.alias("start"), end.alias("end"), F.get(m, i).alias("value")))
            return F.struct(end.alias("at"), F.when(check(F.get(m, i)), F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), nothing, step, lambda acc: acc["spans"])

    return let(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern), lambda between: located(m, between))),
    )


def base_spans(text: Column) -> Column:
    """A struct with an array of spans for each kind."""

    def of(kind: str) -> Column:
        pattern, needs = PATTERNS[kind]
        found = spans(text, F.lit(pattern), CHECKS[kind])
        return (F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast(SPAN)) if needs else found).alias(kind)

    return F.struct(*map(of, KINDS))


def listed(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def all_base(found: Column) -> Column:
    """Base spans of all kinds with their tags, by start."""
    def of(kind: str) -> Column:
        return F.transform(found[kind], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag")))

    return F.array_sort(F.concat(*map(of, KINDS)))


def entities(found: Column) -> Column:
    """The protected values of a text, each with its kind."""

    def of(kind: str) -> Column:
        return F.transform(found[kind], lambda s: F.concat(F.lit(f"{kind}:"), F.lower(s["value"])))

    return F.array_distinct(F.concat(*map(of, KINDS)))


def replaced(text: Column, tagged: Column) -> Column:
    """text with each of the spans (sorted by start) put as its tag; of overlapping ones the first gives the tag."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["tag"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(tagged, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(tagged) == 0, text).otherwise(done)


def terms(text: Column) -> Column:
    """Distinct lower-cased words without punctuation at their edges."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text), GAP), lambda w: F.trim(w, F.lit(EDGE))), lambda w: w != ""))


def _blanked(texts: DataFrame, blanks: DataFrame) -> DataFrame:
    """(_key, term): the terms of each text outside its base spans."""
    at = texts.join(blanks, "_key", "left")
    return at.select("_key", F.explode(terms(replaced(F.col("_text"), F.coalesce("blank", F.array().cast(TAGS))))).alias("term"))


def disclosing(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, evidence: float = EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """(term, removed): the terms that reveal some entity; and (_key, blank): the base spans of the texts that have any.

    docs has _text and _key (hash of the text).  Base spans are looked for once; what is found of a
    text is cut, and later passes join it by the text's hash.
    """
    found = docs.select("_key", "_text", base_spans(F.col("_text")).alias("_base"))
    blank = F.transform(all_base(F.col("_base")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("tag")))
    held = found.select("_key", "_text", blank.alias("blank"), entities(F.col("_base")).alias("named")).where(F.size("named") > 0)
    held = cut(held.select("_key", "blank", "named", terms(replaced(F.col("_text"), F.col("blank"))).alias("terms")))
    blanks = small(held.groupBy("_key").agg(F.first("blank").alias("blank")), weight=F.size("blank"))
    entity = held.select("_key", F.explode("named").alias("entity")).distinct()
    entity = entity.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= support)
    entity = cut(entity)
    if entity.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, removed boolean"), blanks
    with_entity = held.withColumn("entity", F.explode("named")).join(small(entity.select("entity")), "entity", "left_semi")
    words_ = cut(with_entity.select("entity", "_key", F.explode("terms").alias("term")).distinct())
    n = docs.select(F.count_distinct("_key")).first()[0]
    # the texts seen so far bound a term's corpus count from below: what cannot reach the ratio any more goes before the corpus is counted
    reach = F.col("n_tc") * F.pow(F.lit(float(n)) / F.col("n_c"), F.lit(1 - generalise))
    least = words_.groupBy("term").agg(F.count_distinct("_key").alias("n_least"))
    pairs = words_.groupBy("entity", "term").agg(F.count("*").alias("n_tc")).where(F.col("n_tc") >= support)
    pairs = pairs.join(entity, "entity").join(least, "term").where(reach >= F.col("n_least") * 0.999)
    pairs = cut(pairs.select("entity", "term", "n_tc", "n_c"))

    def counted(texts: DataFrame, name: str) -> DataFrame:
        wanted = small(cut(pairs.select("term").distinct()))
        seen = _blanked(texts, blanks).join(wanted, "term", "left_semi")
        return seen.groupBy("term").agg(F.count_distinct("_key").alias(name))

    # so does a slice of the corpus by text hash, in which common words show at once
    part = counted(docs.where(F.pmod("_key", F.lit(SLICES)) == 0), "n_part")
    pairs = cut(pairs.join(part, "term", "left").where(reach >= F.coalesce("n_part", F.lit(0)) * 0.999).select("entity", "term", "n_tc", "n_c"))
    counts = counted(docs, "n_t")
    ic = F.log2(F.lit(float(n)) / F.col("n_c"))
    pmi = F.log2(F.col("n_tc") * F.lit(float(n)) / (F.col("n_t") * F.col("n_c")))
    scored = pairs.join(counts, "term").withColumn("ratio", F.try_divide(pmi, ic)).where((F.col("ratio") >= generalise) & (F.col("n_tc") * ic >= evidence))
    return cut(scored.groupBy("term").agg((F.max("ratio") >= remove).alias("removed"))), blanks


def _found(docs: DataFrame, **thresholds) -> tuple[DataFrame, DataFrame | None]:
    """docs as row with _text, _key and _base, and (doc key, terms in it) for the texts that hold disclosing terms."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("_text")).withColumn("_key", F.xxhash64("_text")).withColumn("_base", base_spans(F.col("_text")))
    texts = docs.select(text.alias("_text")).withColumn("_key", F.xxhash64("_text"))
    flagged, blanks = disclosing(texts, **thresholds)
    if flagged.isEmpty():
        return at, None
    of = _blanked(texts, blanks).join(small(flagged), "term")
    return at, cut(of.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("term", "removed"))).alias("_terms")))


def term_spans(text: Column, found: Column, base: Column) -> Column:
    """Spans of the text's disclosing terms outside its base spans."""
    quoted = lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}])", r"\\$1")
    rim = r"[^\x20\x09-\x0D.,;:!?()\"']"
    pattern = F.concat(F.lit(f"(?iu)(?<!{rim})(?:"), F.array_join(F.transform(F.reverse(found), lambda t: quoted(t["term"])), "|"), F.lit(f")(?!{rim})"))
    hits = spans(text, pattern, lambda m: F.lit(True))
    outside = let(all_base(base), lambda b: F.filter(hits, lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))))
    return F.when(F.size(found) > 0, outside).otherwise(F.array().cast(SPAN))


def detect(docs: DataFrame, **thresholds) -> DataFrame:
    """row (all columns of docs), _text, _base (spans by kind), _terms and _term_spans; thresholds as in disclosing()."""
    at, of = _found(docs, **thresholds)
    none = F.array().cast("array<struct<term:string,removed:boolean>>")
    at = at.withColumn("_terms", none) if of is None else at.join(small(of, weight=F.size("_terms")), "_key", "left").withColumn("_terms", F.coalesce("_terms", none))
    return at.withColumn("_term_spans", term_spans(F.col("_text"), F.col("_terms"), F.col("_base")) if of is not None else F.array().cast(SPAN))


def redact(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with personal data put as tags and disclosing terms removed or generalised."""
    at = detect(docs, **thresholds)
    removed = F.transform(F.filter("_terms", lambda t: t["removed"]), lambda t: t["term"])
    tag = lambda s: F.when(F.array_contains(removed, F.lower(s["value"])), "[REMOVED]").when(s["value"].rlike("[0-9]"), "[NUMBER]").otherwise("[WORD]")
    tagged = F.concat(all_base(F.col("_base")), F.transform("_term_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag(s).alias("tag"))))
    clean = let(F.array_sort(tagged), lambda s: replaced(F.col("_text"), s))
    text = F.when(F.col("row.text").isNull(), None).otherwise(clean)
    at = at.select("row", text.alias("_new"))
    length = F.when(F.col("row").getField("n_chars").isNotNull(), F.length(F.coalesce("_new", F.lit(""))).cast("long")) if "n_chars" in docs.columns else None
    of = {"text": F.col("_new"), "n_chars": length}
    return at.select(*[(of[c] if c in of else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[listed(F.col("_base")[k], k) for k in KINDS])
    at = at.select("row.doc_id", F.col("_base"), F.array_join(base, ",").alias("b"), F.array_join(F.concat(base, listed(F.col("_term_spans"), "term")), ",").alias("spans"))
    counts = [F.size(F.col("_base")[k]).cast("long").alias(f"n_{k}") for k in KINDS]
    return at.select("doc_id", *counts, F.sha2("b", 256).alias("base_sha256"), "spans")
