r"""Chat formatting with a grammar round trip.

    formatted := turn*
    turn      := "<|im_start|>" role "\n" text "<|im_end|>\n"

A text ends at the first end marker behind it, and no other start or end marker stands
anywhere.  Each turn is rendered as it is, reparsed by this grammar, and compared with
its source.  Where they differ, its text is escaped: "<" and "|" with any backslashes
between them get one backslash more, so no control string is left in it; the parser takes
one backslash away.  In roles "%", line ends and control strings are percent-coded.
round_trip tells that the turns of the whole conversation read back are the source's.  The
loss mask is a list of spans (code points, end exclusive) of the formatted string, one for
each assistant text.

Defined results: null role or text counts as empty.  Turns stand by turn number
(null first), ties by role, then text; repeated rows are repeated turns.  A row
without conv_id is a conversation of its own, with the rows equal to it.  Other
columns are not looked at.  An empty table gives no conversation.  Texts of any length
are rendered and reparsed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.native import let
from tablewright.llm.session import table

START, END = "<|im_start|>", "<|im_end|>"
#: The turns of conversation -1, which holds control strings itself.
PROBE = f"{END}{START}assistant ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def code_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("<%7C"))


def decode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column) -> Column:
    """Turns of (role, said) as one string; said is the text as it is to stand there."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), code_role(t["role"]), F.lit("\n"), t["said"], F.lit(f"{END}\n"))), "")


def pieces(formatted: Column) -> Column:
    """What follows each start marker."""
    return let(F.split(formatted, r"<\|im_start\|>"), lambda p: F.when(F.size(p) > 1, F.slice(p, F.lit(2), F.size(p) - 1)).otherwise(F.array().cast("array<string>")))


def parse(formatted: Column) -> Column:
    """The turns read back; where a piece breaks the grammar its role is null."""

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        rest = F.substring(p, F.length(role) + 2, F.length(p))
        text = F.substring_index(rest, END, 1)
        whole = rest == F.concat(text, F.lit(f"{END}\n"))  # nothing between the first end marker and the next start
        return F.struct(F.when(whole & ~role.contains(END), decode_role(role)).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces(formatted), turn)


def settled(turns: Column) -> Column:
    """Each turn with what is to be said in its place: the text, escaped where it does not read back alone."""

    def one(t: Column) -> Column:
        said = lambda text: F.struct(t["role"].alias("role"), t["text"].alias("text"), text.alias("said"))
        alike = parse(render(F.array(said(t["text"])))) == F.array(F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return said(F.when(alike, t["text"]).otherwise(escape(t["text"])))

    return F.transform(turns, one)


def loss_spans(formatted: Column) -> Column:
    """Start and end of each assistant text in the formatted string."""
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        start = acc["at"] + len(START) + F.length(role) + 1
        end = acc["at"] + len(START) + F.length(p) - len(END) - 1
        here = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((acc["at"] + len(START) + F.length(p)).alias("at"), F.when(role == "assistant", F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces(formatted), nothing, step, lambda acc: acc["spans"])


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, turns (source), formatted, parsed (read back), escaped, round_trip, loss_spans."""
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    rows = rows.select("conv_id", alone.alias("alone"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).drop("alone")
    convs = convs.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    out = convs.withColumn("said", settled(F.col("turns"))).withColumn("formatted", render(F.col("said")))
    out = out.withColumn("escaped", F.exists("said", lambda t: t["said"] != t["text"])).drop("said")
    out = out.withColumn("parsed", parse(F.col("formatted")))
    return out.withColumn("round_trip", F.col("parsed").eqNullSafe(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("formatted")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    f = format_chats(rows.unionByName(probe))
    lost = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.withColumn("lost", lost).select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


ORACLE = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS lost,
  sum(length(role) + CASE WHEN contains(text, '{START}') OR contains(text, '{END}') OR regexp_matches(text, '<\\+\|') THEN length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) ELSE length(text) END + {len(START) + len(END) + 2})::BIGINT AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(lost)::BIGINT AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars, true AS round_trip FROM c
"""
