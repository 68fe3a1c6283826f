"""Groups of spelling variants by pivotal grams.

Two words are near if one inserted, deleted or replaced code point turns one into the
other.  Bigrams are ordered by how many places hold them, rarest first.  A word's prefix
is its PREFIX = 2 * EDITS + 1 rarest bigrams (and every further place of the last one's
bigram); its pivots are EDITS + 1 disjoint bigrams of these with the smallest total count,
chosen by dynamic programming.  One edit touches one of two disjoint bigrams at most, so of
two near words the one whose prefix ends earlier has a pivot in the other's prefix.

A pivot that is left alone lies on one side of the edit, and its other side is equal in both
words.  So the index holds, for each bigram of a prefix, the text from the word's start up to
it, with the word's length, and the text from it to the end, with its position, either once
alone and once with the letter at the word's other end; a pivot asks for its own text, with lengths and
positions up to EDITS away.  An edit before both pivots leaves the first one and all behind it, one behind both
the second and all before it.  Of any other edit the first pivot's beginning and the word's last
letter, or the second one's ending and the first letter, stay (if the pivots leave such a letter out).
Text is indexed by 64-bit hashes; of the pairs that meet those whose letters can be one edit apart
are verified by edit distance within the join, so a collision adds nothing.

Letters are 26 and 64, so there are 8,100 bigrams at most, whatever the corpus; their
counts alone come to the driver.  Words follow their form to a word at least RATIO times as
frequent, so a chain is no longer than the digits of the largest count, and jumping along
it twice as far in each round ends after a few rounds.

Defined results: null text has no words; a null doc_id counts as empty text before the
colon.  Rows that repeat count as often as they stand there.  Words of any length are compared whole.
An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.session import cut, prepared, table
from tablewright.llm.words import BASE, INVERSE, U64, mix, power

EDITS = 1
PREFIX = 2 * EDITS + 1
LEAST_LENGTH, LEAST_COUNT, RATIO, DROP = 7, 2, 10, 31
RUN = f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = 26 + 64
#: Word keys made at once.
BATCH_WORDS = 20_000


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, some of which lose a letter by their digest, and how often each occurs."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("d", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % DROP == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 0x80, codes - ord("a"), codes - 0xC0 + 26).astype(np.int64)


def _spelt(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words, end to end, and where each word starts."""
    each = words.to_pylist()
    start = np.zeros(len(each) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in each], out=start[1:])
    return letters(np.frombuffer("".join(each).encode("utf-32-le"), dtype=np.uint32)), start


def _bigrams(codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among all letters, word, bigram) of each bigram."""
    word = np.repeat(np.arange(len(start) - 1), np.diff(start))
    place = np.flatnonzero(word[:-1] == word[1:])
    return place, word[place], codes[place] * LETTERS + codes[place + 1]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS * LETTERS, dtype=np.int64)
    for batch in batches:
        total += np.bincount(_bigrams(*_spelt(batch.column("word")))[2], minlength=len(total))
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["gram", "places"])


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many places hold each of the 8,100 bigrams."""
    total = np.zeros(LETTERS * LETTERS, dtype=np.int64)
    for gram, places in words.select("word").mapInArrow(_gram_counts, "gram long, places long").groupBy("gram").agg(F.sum("places")).collect():
        total[gram] = places
    return total


def choose(places: np.ndarray, weights: np.ndarray, wanted: int = EDITS + 1) -> np.ndarray:
    """For each row, the columns of the disjoint bigrams with the smallest total weight (rows x wanted).

    places, weights: rows x bigrams, by place.  best[k][i] is the smallest weight of k + 1
    disjoint bigrams of which i is the last; it is reached from best[k - 1][j] with j ending before i.
    """
    rows, n = places.shape
    best, came = [weights.astype(float)], []
    for _ in range(1, wanted):
        last, now, link = best[-1], np.full((rows, n), np.inf), np.zeros((rows, n), dtype=np.int64)
        for i in range(n):
            for j in range(i):
                cost = np.where(places[:, j] + 2 <= places[:, i], last[:, j] + weights[:, i], np.inf)
                better = cost < now[:, i]
                now[better, i], link[better, i] = cost[better], j
        best.append(now)
        came.append(link)
    picked = [np.argmin(best[-1], axis=1)]
    for link in reversed(came):
        picked.append(link[np.arange(rows), picked[-1]])
    return np.stack(picked[::-1], axis=1)


def keys(words: pa.Array, counts: np.ndarray, pivots: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, key, rank of the prefix' last bigram) of the words' pivots, or of their prefixes."""
    codes, start = _spelt(words)
    place, word, gram = _bigrams(codes, start)
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    order = np.lexsort((place, rank[gram], word))
    first = np.searchsorted(word, np.arange(len(start) - 1))
    lead = order[first[:, None] + np.arange(PREFIX)]  # bigrams of each word's prefix, rarest first
    last = rank[gram[lead[:, -1]]]
    if pivots:
        lead = np.sort(lead, axis=1)
        chosen = np.take_along_axis(lead, choose(place[lead], counts[gram[lead]]), axis=1)
        take, offsets = chosen.reshape(-1), range(-EDITS, EDITS + 1)
    else:
        take, offsets = np.flatnonzero(rank[gram] <= last[word]), (0,)
    place, word = place[take], word[take]
    sums = np.zeros(len(codes) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((codes + 1).astype(U64) * power(BASE, len(codes)), out=sums[1:])
        back = power(INVERSE, len(codes) + 1)
        begin, end = start[word], start[word + 1]
        left = mix((sums[place + 2] - sums[begin]) * back[begin])
        right = mix((sums[end] - sums[place]) * back[place] + U64(1))
        head, tail, none = codes[begin] + 1, codes[end - 1] + 1, np.zeros(len(word), dtype=np.int64)
        if pivots:
            one, two = np.arange(0, len(word), 2), np.arange(1, len(word), 2)  # first and second pivot of each word
            asked = [(right[one], place[one] - begin[one], none[one]), (left[two], end[two] - begin[two], none[two])]
            asked.append((left[one], end[one] - begin[one], np.where(place[two] + 2 < end[two], tail[one], 0)))
            asked.append((right[two], place[two] - begin[two], np.where(place[one] > begin[one], head[two], 0)))
            of = word[one]
        else:
            asked = [(side, number, letter) for side, number, ends in ((left, end - begin, tail), (right, place - begin, head)) for letter in (none, ends)]
            of = word
        made = [mix(side + (number + k).astype(U64) * U64(BASE) + letter.astype(U64) * U64(INVERSE)) for k in offsets for side, number, letter in asked]
    return np.tile(of, len(made)), np.concatenate(made), np.tile(last[of], len(made))


def bags(words: pa.Array) -> np.ndarray:
    """64 bits of each word's letters, of which one edit changes two at most.

    Whether a to z occur, whether they occur twice, and whether letters of each of 12 classes of the others occur.
    """
    codes, start = _spelt(words)
    word = np.repeat(np.arange(len(start) - 1), np.diff(start))
    held = np.bincount(word * LETTERS + codes, minlength=(len(start) - 1) * LETTERS).reshape(-1, LETTERS)
    bits = [held[:, :26] >= 1, held[:, :26] >= 2, *[(held[:, 26 + k :: 12] > 0).any(axis=1)[:, None] for k in range(12)]]
    return np.concatenate(bits, axis=1) @ (U64(1) << np.arange(64, dtype=U64))


def _keyed(counts: np.ndarray, pivots: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_WORDS):
                batch = whole.slice(at, BATCH_WORDS)
                word, key, last = keys(batch.column("word"), counts, pivots)
                bag = bags(batch.column("word")).view(np.int64)[word]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("word").take(word), batch.column("n").take(word), pa.array(last), pa.array(bag)], ["key", "word", "n", "last", "bag"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, n): both directions of every pair of near words, with near's count."""
    counts, schema = gram_counts(words), "key long, word string, n long, last long, bag long"
    asks = words.mapInArrow(_keyed(counts, True), schema).alias("a")
    held = words.mapInArrow(_keyed(counts, False), schema).alias("b")
    alike = F.bit_count(F.col("a.bag").bitwiseXOR(F.col("b.bag"))) <= 2 * EDITS
    met = asks.join(held, (F.col("a.key") == F.col("b.key")) & (F.col("a.last") <= F.col("b.last")) & alike & (F.levenshtein("a.word", "b.word", EDITS) == EDITS))
    ab = F.struct(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("n"))
    ba = F.struct(F.col("b.word").alias("word"), F.col("a.word").alias("near"), F.col("a.n").alias("n"))
    return met.select(F.explode(F.array(ab, ba)).alias("p")).select("p.*").distinct()


def variants(words: DataFrame) -> DataFrame:
    """words (word, n) with form, root, n_near and form_n."""
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("top"))
    known = words.join(near, "word", "left")
    formed = F.coalesce(-F.col("top.less") >= RATIO * F.col("n"), F.lit(False))
    known = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("top.near")).alias("form"), F.when(formed, -F.col("top.less")).alias("form_n")))
    hops = cut(known.where("form is not null").select("word", F.col("form").alias("to")))
    while True:
        ahead = hops.select(F.col("word").alias("to"), F.col("to").alias("next"))
        if hops.join(ahead, "to", "left_semi").isEmpty():
            break
        hops = cut(hops.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to")))
    return known.join(hops, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its near words, its form and the root its forms lead to."""
    return variants(cut(counted(table(prepared(spark), sf_dir, "documents"))))
