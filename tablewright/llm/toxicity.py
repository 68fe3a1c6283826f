"""Toxic spans by a linear-chain conditional random field.

Each token is tagged 0 (clean) or 1 (toxic).  A token's potential is a sum of hashed
weights of its core (without punctuation at the end), its beginnings and its ending; tags
of neighbours are tied by a 2 x 2 transition table.  Token labels come from document
labels: every token of a clean document is tagged 0, and a toxic document has at least
one token tagged 1, so training maximises log P(all 0) over clean documents and
log(1 - P(all 0)) over toxic ones, both exact by forward-backward sums.  The document's
score is 1 - P(all 0 | text); tokens whose forward-backward marginal reaches SPAN are
joined to spans (code points, end exclusive).

Products of the 2 x 2 potentials are reduced in a balanced tree over each document and
swept back for the marginals, so whole texts of any length take a few array operations.

The model is fitted on a bounded sample: at most SAMPLE documents of each label, those
with the smallest digests of their ids, and of these, label by label in that order, whole
texts of at most SAMPLE_CHARS / 2 characters (the first of a label in any case); none with
crc32(doc_id) mod 4 = 2.  Scoring
reads every document.

Defined results: null text counts as empty; a text without words scores 0.  Equal texts
score alike.  Labels without a document or without a value are not used; of repeated
labels the highest counts.  Without labels of both kinds every score is 0.  An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.session import prepared, table
from tablewright.llm.words import U64, chunks, mix, segment

SAMPLE = 1500
#: Characters of the sample's texts: documents of the sample are taken in digest order until these are full.
SAMPLE_CHARS = 12_000_000
#: Documents whose gradient is worked out at once.
PART = 200
BITS = 18
SPAN, THRESHOLD = 0.5, 0.3
START_BIAS, RIDGE, STEPS = -7.0, 1e-3, 40
_TRAIL = np.zeros(256, dtype=bool)
_TRAIL[[ord(c) for c in ".,;:!?)\"'"]] = True


def token_features(words) -> np.ndarray:
    """Hashed features, tokens x 6."""
    for _ in range(2):  # punctuation at the end does not tell words apart
        last = words.data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
        words.ends = words.ends - (_TRAIL[last] & (words.ends - words.starts > 1))
    kinds = [words.prefix_hash(), words.prefix_hash(4), words.prefix_hash(5), words.prefix_hash(6), words.prefix_hash(8), words.suffix_hash(5)]
    return np.stack([(mix(h + U64(k * 0x9E37 + 1)) >> U64(64 - BITS)).astype(np.int32) for k, h in enumerate(kinds)], axis=1)


class Chain:
    """Forward-backward sums of a batch of documents, from token potentials u of tag 1 (tag 0 has 0)."""

    def __init__(self, u: np.ndarray, first: np.ndarray, trans: np.ndarray):
        self.first, self.t = first, np.exp(trans)
        e = np.exp(np.clip(u, -30, 30))
        m = np.empty((4, len(u)))
        m[0], m[1], m[2], m[3] = self.t[0, 0], self.t[0, 1] * e, self.t[1, 0], self.t[1, 1] * e
        scale = m.max(axis=0) if len(u) else np.zeros(0)
        m /= scale
        size = np.diff(first)
        log = np.log(scale)
        sums = np.concatenate(([0.0], np.cumsum(log)))
        self.log = sums[first[1:]] - sums[first[:-1]]
        self.levels = []
        docs = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(u)) - np.repeat(first[:-1], size)
        while len(docs) and size.max() > 1:
            even = place % 2 == 0
            left = np.flatnonzero(even)
            paired = place[left] + 1 < size[docs[left]]
            right = left[paired] + 1
            up = m[:, left].copy()
            a, b = m[:, left[paired]], m[:, right]
            c = np.empty_like(a)
            c[0], c[1] = a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3]
            c[2], c[3] = a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]
            s = c.max(axis=0)
            c /= s
            self.log += np.bincount(docs[left[paired]], np.log(s), minlength=len(size))
            up[:, paired] = c
            self.levels.append((m, left, paired, right))
            docs, place, m, size = docs[left], place[left] // 2, up, (size + 1) // 2
        self.m, self.docs = m, docs
        self.log_z = np.zeros(len(self.log))
        self.log_z[docs] = np.log(np.maximum(m[0] + m[1], 1e-300))
        self.log_z += self.log
        self.clean = np.diff(first) * trans[0, 0]  # log weight of the path of zeros

    def log_p_clean(self) -> np.ndarray:
        return np.minimum(self.clean - self.log_z, -1e-12) * (np.diff(self.first) > 0)

    def marginals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(tag 1) of each token, and of each place before a token the pairwise P(1,1), P(0,1)."""
        f, b = np.zeros((2, len(self.docs))), np.ones((2, len(self.docs)))
        f[0] = 1
        m = self.m
        for below, left, paired, right in reversed(self.levels):
            fb, bb = np.empty((2, below.shape[1])), np.empty((2, below.shape[1]))
            fb[:, left], bb[:, left] = f, b
            a = below[:, left[paired]]
            fr = np.stack((f[0, paired] * a[0] + f[1, paired] * a[2], f[0, paired] * a[1] + f[1, paired] * a[3]))
            fb[:, right] = fr / fr.max(axis=0)
            bb[:, right] = b[:, paired]
            r = below[:, right]
            bl = np.stack((r[0] * b[0, paired] + r[1] * b[1, paired], r[2] * b[0, paired] + r[3] * b[1, paired]))
            bb[:, left[paired]] = bl / bl.max(axis=0)
            f, b, m = fb, bb, below
        p00, p01, p10, p11 = f[0] * m[0] * b[0], f[0] * m[1] * b[1], f[1] * m[2] * b[0], f[1] * m[3] * b[1]
        z = p00 + p01 + p10 + p11
        return (p01 + p11) / z, p11 / z, p10 / z


def potentials(index: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[-1] + weights[index].sum(axis=1)


def fit(index: np.ndarray, first: np.ndarray, toxic: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last is the bias of tag 1) and transitions, by accelerated gradient steps."""
    n = len(first) - 1
    w = np.zeros((1 << BITS) + 1)
    w[-1] = START_BIAS
    trans = np.zeros((2, 2))
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    # the gradient is a sum over documents: a few at a time, so the driver holds the work space of those only
    parts = [(lo, min(lo + PART, n)) for lo in range(0, n, PART)]
    for step in range(1, steps + 1):
        gw, gt = np.zeros(len(w)), np.zeros(2)
        for lo, hi in parts:
            tokens = index[first[lo] : first[hi]]
            chain = Chain(potentials(tokens, w), first[lo : hi + 1] - first[lo], trans)
            p_clean = np.exp(chain.log_p_clean())
            p1, p11, p10 = chain.marginals()
            # expected tags given the label less expected tags
            factor = np.where(toxic[lo:hi] == 1, p_clean / np.maximum(1 - p_clean, 1e-9), -1.0)
            each = np.repeat(factor, np.diff(first[lo : hi + 1]))
            g = p1 * each
            for k in range(index.shape[1]):
                gw[:-1] += np.bincount(tokens[:, k], g, minlength=len(w) - 1)
            gw[-1] += g.sum()
            gt += (p11 * each).sum(), (p10 * each).sum()
        grad = np.concatenate((gw, gt)) / n
        grad[: len(w) - 1] -= RIDGE * w[:-1] / 10
        m, v = 0.85 * m + 0.15 * grad, 0.97 * v + 0.03 * grad * grad
        move = 0.5 * (m / (1 - 0.85**step)) / (np.sqrt(v / (1 - 0.97**step)) + 1e-7) * min(1.0, 3 * (1 - step / (steps + 1)))
        move[: len(w) - 1][gw[:-1] == 0] *= 0.1
        w += move[: len(w)]
        w[-1] = min(w[-1], -3.0)
        trans[1, 1] += move[-2]
        trans[1, 0] += move[-1]
        trans[1] = np.clip(trans[1], -4, 4)
    return w.astype(np.float32), trans


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of the sample."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long_ = text.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    some = known.join(long_, "doc_id").withColumn("digest", F.xxhash64("doc_id"))
    chosen = []
    for k in (0, 1):
        rows, chars = some.where(F.col("toxic") == k).orderBy("digest", "doc_id").limit(sample).collect(), 0  # sample rows of a few numbers
        for r in rows:
            chars += r.chars
            if chars <= SAMPLE_CHARS // 2 or not any(x[1] == k for x in chosen):
                chosen.append((r.doc_id, k))
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    # of rows with one id the longest text, ties by the text
    best = text.join(F.broadcast(chosen), "doc_id").withColumn("order", F.struct(F.length("text").alias("n"), F.col("text").alias("t")))
    return best.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("order").getField("t").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(weights, transitions), or None where labels do not tell anything apart."""
    prepared(docs.sparkSession)
    got = labelled(docs, labels, sample).orderBy("doc_id").toArrow()
    toxic = got.column("toxic").to_numpy()
    if len(set(toxic.tolist())) < 2:
        return None
    index, size = [], []
    with np.errstate(over="ignore"):
        for _, _, raw, offsets in chunks(got.column("text")):
            words = segment(raw, offsets)
            size.append(np.diff(words.first))
            index.append(token_features(words))
    return fit(np.concatenate(index), np.concatenate(([0], np.cumsum(np.concatenate(size)))), toxic)


SCORED = "doc_id long, score double, spans array<struct<start:int,end:int,weight:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))


def scorer(model):
    def score(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, raw, offsets in chunks(batch.column("text")):
                    n = b - a
                    value, spans = np.zeros(n), [[] for _ in range(n)]
                    words = segment(raw, offsets)
                    if model is not None and len(words.starts):
                        w, trans = model
                        whole = words.ends
                        chain = Chain(potentials(token_features(words), w), words.first, trans)
                        value = 1 - np.exp(chain.log_p_clean())
                        value[np.diff(words.first) == 0] = 0
                        value = np.clip(np.round(value, 9), 0, 1)
                        if (value >= THRESHOLD).any():
                            p1 = chain.marginals()[0]
                            hit = np.flatnonzero((p1 >= SPAN) & (value[words.doc] >= THRESHOLD))
                            # code points before a byte: the bytes that do not continue a character
                            points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                            for i in hit.tolist():
                                d = int(words.doc[i])
                                zero = points[offsets[d]]
                                s, e, own = int(points[words.starts[i]] - zero), int(points[whole[i]] - zero), spans[d]
                                if own and own[-1]["last"] == i - 1:
                                    own[-1].update(end=e, last=i, weight=max(own[-1]["weight"], float(p1[i])))
                                else:
                                    own.append({"start": s, "end": e, "weight": float(p1[i]), "last": i})
                    told = [[{k: x[k] for k in ("start", "end", "weight")} for x in own] for own in spans]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), pa.array(value), pa.array(told, _SPAN)], names=["doc_id", "score", "spans"])

    return score


def tag(docs: DataFrame, model) -> DataFrame:
    """doc_id, score and the offending spans."""
    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scorer(model), SCORED)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    offsets = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), offsets.alias("offsets"))
