"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades, and ordered
thresholds cut its score: P(grade <= k) = sigmoid(theta_k - w.x).  The model gives the
expected grade and the tail probability P(grade >= k) for selection.

Features of the whole text: hashed words and hashed word shapes (letters, digits and
symbols as classes, runs collapsed), each by the square root of its share of the text,
and the shares of repeated words.  Ratings: 0 poor, 1 fine but toxic, 2 fine; a document
is kept where P(grade >= 1) >= KEEP.

The model is fitted on a bounded sample: at most SAMPLE labelled documents, those with
the smallest digests of their ids.  Scoring reads every document.

Defined results: null text counts as empty; an empty text has no features and is scored
by the thresholds alone, unless the ratings decide otherwise it is not kept (EMPTY).
Repeated rows get equal scores.  Labels without a document or without a quality are not
used; of repeated labels of a document the lowest counts.  Without any labels, or with
labels of one grade only, every non-empty document is kept.  Columns of the documents
stay; expected_grade, p_keep and kept are added and replace columns of these names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.session import prepared, table
from tablewright.llm.words import U64, chunks, mix, segment, string_lists

SAMPLE = 6000
WORD_BITS, SHAPE_BITS, EXTRA = 15, 12, 16
WIDTH = (1 << WORD_BITS) + (1 << SHAPE_BITS) + EXTRA
KEEP, EMPTY = 0.5, False
RIDGE, STEPS = 2e-4, 150

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 1
_TABLE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64, 256, dtype=U64, endpoint=False)


def shapes(words) -> np.ndarray:
    """A hash of each word's shape: classes of its bytes with runs collapsed, at most eight runs told apart by order."""
    c = _CLASS[words.raw]
    fresh = np.ones(len(c), dtype=bool)
    fresh[1:] = c[1:] != c[:-1]
    fresh[words.starts] = True
    run = np.cumsum(fresh)
    first = run - 1
    base = np.zeros(len(c), dtype=np.int64)
    base[words.starts] = first[words.starts]
    base = np.maximum.accumulate(base)
    place = np.minimum(first - base, 7)
    value = np.where(fresh, mix(_TABLE[c] + place.astype(U64)), U64(0))
    total = np.concatenate(([U64(0)], np.cumsum(value)))
    return mix(total[words.ends] - total[words.starts])


def features(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: indices, values, and how many each document has."""
    n = len(words.first) - 1
    count = np.diff(words.first)
    h = words.prefix_hash()
    word = (h >> U64(64 - WORD_BITS)).astype(np.int64)
    shape = (shapes(words) >> U64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)
    doc = words.doc
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    sums = np.concatenate(([0.0], np.cumsum(again)))
    adjacent = (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(count, 1)
    key = np.concatenate((doc * WIDTH + word, doc * WIDTH + shape))
    found, times = np.unique(key, return_counts=True)
    row = found // WIDTH
    distinct = np.bincount(row[found % WIDTH < (1 << WORD_BITS)], minlength=n) / np.maximum(count, 1)
    extra = np.zeros((n, EXTRA))
    extra[np.arange(n), np.minimum((adjacent * 6).astype(int), 5)] = 1
    extra[np.arange(n), 6 + np.minimum((distinct * 6).astype(int), 5)] = 1
    extra[count == 0] = 0
    at, which = np.nonzero(extra)
    index = np.concatenate((found % WIDTH, which + WIDTH - EXTRA))
    value = np.concatenate((np.sqrt(times / np.maximum(count[row], 1)), np.full(len(at), 0.5)))
    rows = np.concatenate((row, at))
    order = np.argsort(rows, kind="stable")
    return index[order], value[order], np.bincount(rows, minlength=n)


def _rows(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column("text")):
                index, value, size = features(segment(raw, offsets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grade").slice(a, b - a), string_lists(index.astype(np.int32), size, pa.int32()), string_lists(value.astype(np.float32), size, pa.float32())],
                    names=["grade", "index", "value"],
                )


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(index: np.ndarray, value: np.ndarray, size: np.ndarray, grade: np.ndarray, grades: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and grades - 1 ordered thresholds, by accelerated gradient steps on the penalised likelihood."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    w, theta = np.zeros(WIDTH), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1)
    # thresholds as a first one and logarithms of the gaps, so they stay ordered
    par = np.concatenate((theta[:1], np.log(np.diff(theta))))
    m, v = np.zeros(WIDTH + len(par)), np.zeros(WIDTH + len(par))
    for step in range(1, steps + 1):
        gaps = np.exp(par[1:])
        theta = np.concatenate((par[:1], par[0] + np.cumsum(gaps)))
        z = np.bincount(row, value * w[index], minlength=n)
        cut = np.concatenate((np.full((n, 1), -np.inf), theta[None, :] - z[:, None], np.full((n, 1), np.inf)), axis=1)
        at = np.arange(n)
        up, down = sigmoid(cut[at, grade + 1]), sigmoid(cut[at, grade])
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up) / p, down * (1 - down) / p  # d log p / d upper cut, - d / d lower cut
        gz = -(du - dd)
        gw = np.bincount(index, value * gz[row], minlength=WIDTH) / n - RIDGE * w
        gt = np.zeros(grades + 1)
        np.add.at(gt, grade + 1, du)
        np.add.at(gt, grade, -dd)
        gt = gt[1:-1] / n
        gp = np.concatenate(([gt.sum()], [gt[k:].sum() * gaps[k - 1] for k in range(1, len(gt))]))
        g = np.concatenate((gw, gp))
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        move = 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8) * min(1.0, 3 * (1 - step / (steps + 1)))
        w, par = w + move[:WIDTH], par + move[WIDTH:]
    return w, np.concatenate((par[:1], par[0] + np.cumsum(np.exp(par[1:]))))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels: 0 poor, 1 fine but toxic, 2 fine."""
    grade = F.when(F.col("quality") < 1, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    known = labels.where("quality is not null and doc_id is not null")
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """A fitted model (weights, thresholds), or None where there is nothing to tell apart."""
    prepared(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = grades.join(text.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = text.join(F.broadcast(chosen), "doc_id")  # sample rows of two numbers
    got = chosen.dropDuplicates(["doc_id"]).orderBy("doc_id").select("text", F.col("grade").cast("int").alias("grade")).mapInArrow(_rows, "grade int, index array<int>, value array<float>").toArrow()
    if not len(got) or len(set(got.column("grade").to_pylist())) < 2:
        return None
    index, value = (got.column(c).combine_chunks() for c in ("index", "value"))
    size = np.diff(index.offsets.to_numpy())
    grade = got.column("grade").to_numpy()
    levels = np.unique(grade)
    w, theta = fit(index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64), size, np.searchsorted(levels, grade), len(levels))
    return w, theta


ADDED = ("expected_grade", "p_keep", "kept")


def scorer(model, keep: float):
    def score(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                column = batch.column("text").cast(pa.string())
                for a, b, raw, offsets in chunks(column):
                    words = segment(raw, offsets)
                    index, value, size = features(words)
                    if model is None:
                        grade, tail = np.zeros(b - a), np.ones(b - a)
                    else:
                        w, theta = model
                        z = np.bincount(np.repeat(np.arange(b - a), size), value * w[index], minlength=b - a)
                        above = 1 - sigmoid(theta[None, :] - z[:, None])  # P(grade > k)
                        grade, tail = above.sum(axis=1), above[:, 0]
                    kept = np.where(np.diff(words.first) == 0, EMPTY, tail >= keep)
                    part = batch.slice(a, b - a)
                    arrays = [part.column(i) for i in range(part.num_columns)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(grade), pa.array(tail), pa.array(kept)], names=[*batch.schema.names, *ADDED])

    return score


def classify(docs: DataFrame, model, keep: float = KEEP) -> DataFrame:
    """docs with expected_grade, p_keep and kept."""
    prepared(docs.sparkSession)
    own = docs.drop(*ADDED)
    fields = [T.StructField("expected_grade", T.DoubleType()), T.StructField("p_keep", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return own.mapInArrow(scorer(model, keep), T.StructType([*own.schema.fields, *fields]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "p_keep", "kept")
