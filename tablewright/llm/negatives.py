"""Hard negatives by lists that the anchors of a cluster share.

1. Anchors are put into clusters by angle: spherical k-means on at most SAMPLE of them gives
   the centres (one for PER_CLUSTER anchors, MOST at most), and every anchor goes to its nearest one.
   A cluster's width is the largest angle between its centre and a member.
2. A candidate i at angle t from the centre of a cluster of width w has at most the product
   |i| * cos(max(0, t - w)) with any member of norm 1.  Once for each cluster all candidates
   are sorted by this bound, into BINS bins of equal height; a histogram of the bins cuts the list into
   slices that grow by GROWTH.
3. Every member walks its cluster's list from the top, slice by slice.  It stops once the next
   bound, times its norm, is under what it already holds: the last of its positives in the
   first walk; in the second, for each positive, the last of its negatives, or the
   lower end of the band.  Only slices that an open member asks for are dealt out.
   Within a slice a task goes down its part of the list in steps of STRIDE and stops by the same rule.

A slice of a list is dealt by the id into blocks of about BLOCK rows; a task holds one block and
reads members as a stream.  So no task grows with a cluster, a list, or a group of copies.
The bound is widened by SLACK against rounding, and equal products do not end a walk, so ties by id are exact.

Defined results: see vectors.  Products are sums of doubles and are exact while they are whole
numbers under 2**53; op13's scores are null beyond a long, and rows with a component that
overflows when multiplied take no part.  An anchor without another row of its label, and a positive without
a row in its band, give no rows; a positive whose product is negative has an empty band.  An
anchor or candidate of norm 0 has products 0 and takes part.  An empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.session import cut, prepared, table
from tablewright.llm.vectors import FLOATS, matrix, streamed, usable

SAMPLE, PER_CLUSTER, MOST, ROUNDS = 4096, 256, 64, 12
BINS, FIRST, GROWTH = 256, 16_384, 4
BLOCK, STRIDE = 16_384, 2048
SLACK = 1e-6
_MEMBER = "cluster int, id long, label long, vector array<double>, norm double"
_LISTED = "cluster int, bin int, bound double, id long, label long, vector array<double>"


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    n = norms(x)[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centres(sample: np.ndarray, clusters: int, seed: int = 11) -> np.ndarray:
    """Unit centres by spherical k-means; fewer where the sample has fewer directions."""
    z = unit(sample)
    z = z[np.random.default_rng(seed).permutation(len(z))]
    held = z[:1]
    while len(held) < clusters:  # the one farthest from all taken so far comes next
        far = (z @ held.T).max(axis=1)
        if far.min() > 1 - 1e-12:
            break
        held = np.concatenate([held, z[np.argmin(far)][None]])
    for _ in range(ROUNDS):
        near = np.argmax(z @ held.T, axis=1)
        sums = np.zeros_like(held)
        np.add.at(sums, near, z)
        held = np.where(norms(sums)[:, None] > 0, unit(sums), held)
    return held


def angles(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angle of each row to each centre; 0 for a row of norm 0."""
    z = unit(x)
    return np.where(norms(z)[:, None] > 0, np.arccos(np.clip(z @ centre.T, -1, 1)), 0.0)


def bounds(x: np.ndarray, centre: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The largest product of each row with a member of norm 1 of each cluster (rows x clusters)."""
    return norms(x)[:, None] * np.cos(np.maximum(0.0, angles(x, centre) - widths - SLACK))


def bins(bound: np.ndarray, top: float) -> np.ndarray:
    """Bins from the largest bound down; top is the largest norm."""
    return np.clip(np.floor((1 - bound / top) / 2 * BINS), 0, BINS - 1).astype(np.int64) if top > 0 else np.zeros(bound.shape, dtype=np.int64)


def ceiling(bin_: int, top: float) -> float:
    """No bound of this bin or a later one is over it."""
    return top * (1 - 2 * bin_ / BINS) + SLACK * top if bin_ else float("inf")


def _assigned(centre: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"))
            if len(x):
                apart = angles(x, centre)
                cluster = np.argmin(apart, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), *[batch.column(c) for c in ("id", "label", "vector")], pa.array(norms(x)), pa.array(apart[np.arange(len(x)), cluster])], ["cluster", "id", "label", "vector", "norm", "apart"])

    return run


def _heights(centre: np.ndarray, widths: np.ndarray, top: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centre) * BINS, dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column("vector"))
            if len(x):
                total += np.bincount((np.arange(len(centre)) * BINS + bins(bounds(x, centre, widths), top)).reshape(-1), minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["at", "n"])

    return run


def _slice(centre: np.ndarray, widths: np.ndarray, top: float, spans: dict[int, tuple[int, int]]) -> Callable:
    """Rows of the slices: for each open cluster, those whose bins are in its span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"))
            if not len(x):
                continue
            bound = bounds(x, centre, widths)
            bin_ = bins(bound, top)
            for c, (low, high) in spans.items():
                rows = np.flatnonzero((bin_[:, c] >= low) & (bin_[:, c] < high))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c), pa.int32()), pa.array(bin_[rows, c], pa.int32()), pa.array(bound[rows, c]), *[batch.column(k).take(pa.array(rows)) for k in ("id", "label", "vector")]], ["cluster", "bin", "bound", "id", "label", "vector"])

    return run


def _load(parts: list[pa.RecordBatch]) -> tuple:
    whole = pa.Table.from_batches(parts)
    bound = whole.column("bound").to_numpy()
    order = np.argsort(-bound, kind="stable")
    return (bound + SLACK * np.abs(bound))[order], whole.column("id").to_numpy()[order], whole.column("label").to_numpy()[order], matrix(whole.column("vector"))[order]


def first(score: np.ndarray, ids: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the wanted highest scores, ties by smaller id."""
    return np.lexsort((ids, -score))[:wanted]


def _positives(wanted: int) -> Callable:
    def ask(block: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        over, ids, labels, vectors = block
        out: list[tuple[int, int, float]] = []
        own, label, norm = (rows.column(c).to_numpy() for c in ("id", "label", "norm"))
        least, members = rows.column("least").to_numpy(), matrix(rows.column("vector"))
        kept_score, kept_id = [np.zeros(0)] * len(own), [np.zeros(0, np.int64)] * len(own)
        alive = np.arange(len(own))
        for at in range(0, len(ids), STRIDE):
            # what is at or above the last held so far is walked, for ties by id
            alive = np.array([i for i in alive if norm[i] * over[at] >= max(least[i], kept_score[i][-1] if len(kept_score[i]) == wanted else -np.inf)], dtype=np.int64)
            if not len(alive):
                break
            product = members[alive] @ vectors[at : at + STRIDE].T
            for i, p in zip(alive.tolist(), product):
                same = np.flatnonzero((labels[at : at + STRIDE] == label[i]) & (ids[at : at + STRIDE] != own[i]) & (p >= least[i]))
                if len(same):
                    score, who = np.concatenate([kept_score[i], p[same]]), np.concatenate([kept_id[i], ids[at : at + STRIDE][same]])
                    best = first(score, who, wanted)
                    kept_score[i], kept_id[i] = score[best], who[best]
        for i in range(len(own)):
            out += [(int(own[i]), int(w), float(s)) for s, w in zip(kept_score[i], kept_id[i])]
        if out:
            a, b, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["anchor_id", "positive_id", "positive_score"])

    return ask


def _negatives(wanted: int, low: int, high: int) -> Callable:
    def ask(block: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        over, ids, labels, vectors = block
        out: list[tuple[int, int, float, int, float]] = []
        own, label, norm = (rows.column(c).to_numpy() for c in ("id", "label", "norm"))
        positives, members = rows.column("positives").to_pylist(), matrix(rows.column("vector"))
        # for each positive: (its product, least product still wanted, scores and ids held)
        state = [[[p["score"], max(p["least"], low * p["score"] / high), np.zeros(0), np.zeros(0, np.int64)] for p in some] for some in positives]
        alive = np.arange(len(own))
        for at in range(0, len(ids), STRIDE):
            most = norm * over[at]
            alive = np.array([i for i in alive if any(most[i] >= least for _, least, _, _ in state[i])], dtype=np.int64)
            if not len(alive):
                break
            product = members[alive] @ vectors[at : at + STRIDE].T
            for i, p in zip(alive.tolist(), product):
                other = np.flatnonzero((labels[at : at + STRIDE] != label[i]) & (p >= min(x[1] for x in state[i]) - SLACK) & (p <= max(x[0] for x in state[i])))
                if not len(other):
                    continue
                p, who = p[other], ids[at : at + STRIDE][other]
                for x in state[i]:
                    fits = (low * x[0] <= high * p) & (p <= x[0]) & (p >= x[1] - SLACK)
                    if fits.any():
                        score, held = np.concatenate([x[2], p[fits]]), np.concatenate([x[3], who[fits]])
                        best = first(score, held, wanted)
                        x[2], x[3] = score[best], held[best]
                        if len(best) == wanted:
                            x[1] = max(x[1], x[2][-1])
        for i, some in enumerate(positives):
            for p, x in zip(some, state[i]):
                out += [(int(own[i]), p["id"], p["score"], int(w), float(s)) for s, w in zip(x[2], x[3])]
        if out:
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return ask


class Lists:
    """The clusters' centres and widths, and how many rows each bin of each cluster's list has."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        n, dims = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
        most = max(64, min(SAMPLE, FLOATS // dims))
        sample = np.array([r.vector for r in anchors.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").collect()])
        self.rows, self.centre = rows, centres(sample, min(MOST, -(-n // PER_CLUSTER)))
        self.members = cut(anchors.mapInArrow(_assigned(self.centre), _MEMBER + ", apart double"))
        self.widths = np.zeros(len(self.centre))
        for c, apart in self.members.groupBy("cluster").agg(F.max("apart")).collect():
            self.widths[c] = apart
        squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        self.top = float(rows.agg(F.max(F.sqrt(squares))).first()[0])
        self.sizes = np.zeros((len(self.centre), BINS), dtype=np.int64)
        for at, rows_ in rows.mapInArrow(_heights(self.centre, self.widths, self.top), "at long, n long").groupBy("at").agg(F.sum("n")).collect():
            self.sizes[at // BINS, at % BINS] = rows_
        self.slices = [self._cut(c) for c in range(len(self.centre))]

    def _cut(self, c: int) -> list[tuple[int, int]]:
        """Spans of bins that grow from FIRST rows by GROWTH; a bin is never divided."""
        out, low, held, wanted = [], 0, 0, FIRST
        for b in range(BINS):
            held += self.sizes[c, b]
            if held >= wanted or b == BINS - 1:
                out.append((low, b + 1))
                low, held, wanted = b + 1, 0, wanted * GROWTH
        return out

    def ceilings(self, step: int) -> list[float]:
        """For each cluster, what no bound of its list exceeds from this slice on; minus infinity past its end."""
        return [ceiling(s[step][0], self.top) if step < len(s) else float("-inf") for s in self.slices]

    def walked(self, open_: DataFrame, step: int, ask: Callable, schema: str) -> DataFrame:
        """What open members (kind 1 columns besides _MEMBER's) find in this slice of their lists."""
        clusters = [r[0] for r in open_.select("cluster").distinct().collect()]
        spans = {c: self.slices[c][step] for c in clusters if step < len(self.slices[c])}
        counts = {c: int(self.sizes[c, a:b].sum()) for c, (a, b) in spans.items()}
        blocks = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, max(1, -(-n // BLOCK)))])[F.col("cluster")]
        listed = self.rows.mapInArrow(_slice(self.centre, self.widths, self.top, spans), _LISTED)
        listed = listed.withColumn("block", F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")).withColumn("kind", F.lit(0))
        asks = open_.where(F.col("cluster").isin(list(spans))).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("kind", F.lit(1))
        met = asks.unionByName(listed, allowMissingColumns=True)
        lead = ["cluster", "block", "kind"]
        met = met.select(*lead, *[c for c in met.columns if c not in lead]).repartition("cluster", "block").sortWithinPartitions(*lead)
        return met.mapInArrow(streamed(_load, ask, 2), schema)


def _walk(lists: Lists, state: Callable, ask: Callable, schema: str, best: Callable) -> DataFrame | None:
    """Walks all members down their lists; state(found, ceilings) gives the members still open."""
    found, step = None, 0
    while True:
        open_ = cut(state(found, lists.ceilings(step)))
        if open_.isEmpty():
            return found
        new = lists.walked(open_, step, ask, schema)
        found = cut(best(new if found is None else found.unionByName(new)))
        step += 1


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: id, label, vector; is_anchor: on id.  An anchor's positives are the rows of its
    label with the highest products; a positive's negatives are the rows of other labels with
    the highest products s that satisfy low * positive <= high * s <= high * positive.
    """
    rows = cut(rows)
    anchors = rows.where(is_anchor)
    if anchors.isEmpty():
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    lists = Lists(rows, anchors)
    members = lists.members.drop("apart")

    def limit(ceilings: list[float]) -> Column:
        return F.col("norm") * F.element_at(F.lit(ceilings), F.col("cluster") + 1)

    def of_label(found: DataFrame | None, ceilings: list[float]) -> DataFrame:
        if found is None:
            return members.withColumn("least", F.lit(float("-inf")))
        held = found.groupBy(F.col("anchor_id").alias("id")).agg(F.count("*").alias("n"), F.min("positive_score").alias("last"))
        least = F.when(F.col("n") == positives, F.col("last")).otherwise(F.lit(float("-inf")))
        left = members.join(held, "id", "left").withColumn("least", F.coalesce(least, F.lit(float("-inf"))))
        # past the end of its list every limit is minus infinity, or not a number for norm 0
        there = F.element_at(F.lit(ceilings), F.col("cluster") + 1) > float("-inf")
        return left.where(there & (limit(ceilings) >= F.col("least"))).select(*members.columns, "least")

    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    ranked = lambda df: df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place")
    pairs = _walk(lists, of_label, _positives(positives), "anchor_id long, positive_id long, positive_score double", ranked)
    pairs = pairs.where("positive_score >= 0")

    def in_band(found: DataFrame | None, ceilings: list[float]) -> DataFrame:
        if found is None:
            held = pairs.withColumn("least", F.lit(float("-inf")))
        else:
            some = found.groupBy("anchor_id", "positive_id").agg(F.count("*").alias("n"), F.min("negative_score").alias("last"))
            held = pairs.join(some, ["anchor_id", "positive_id"], "left").withColumn("least", F.coalesce(F.when(F.col("n") == negatives, F.col("last")), F.lit(float("-inf"))))
        left = members.join(held.withColumnRenamed("anchor_id", "id"), "id")
        there = F.element_at(F.lit(ceilings), F.col("cluster") + 1) > float("-inf")
        asked = F.greatest(F.col("least"), F.col("positive_score") * low / high)
        left = left.where(there & (limit(ceilings) >= asked - SLACK))
        each = F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"), "least")
        some = left.groupBy("id").agg(F.collect_list(each).alias("positives"))  # no more than the positives of an anchor
        return members.join(some, "id").select(*members.columns, "positives")

    by_pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    closest = lambda df: df.withColumn("place", F.row_number().over(by_pair)).where(F.col("place") <= negatives).drop("place")
    found = _walk(lists, in_band, _negatives(negatives, low, high), "anchor_id long, positive_id long, positive_score double, negative_id long, negative_score double", closest)
    if found is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = lambda c: F.col(c).try_cast("long").alias(c)
    return found.select("anchor_id", "positive_id", F.row_number().over(by_pair).alias("rank"), "negative_id", whole("positive_score"), whole("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every row whose vec_id is divisible by 100."""
    rows = usable(table(prepared(spark), sf_dir, "embeddings"), "vec_id", "embedding", F.col("label").cast("long").alias("label"))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # doubles of 2**52 and more are whole
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * 256).cast("double")).otherwise(x * 256))
    rows = rows.select("id", label.alias("label"), whole.alias("vector")).where(~F.exists("vector", lambda x: F.abs(x) == float("inf")))
    return hard_negatives(rows, F.col("id") % 100 == 0)


ORACLE = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), met AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, m.other_id AS negative_id, p.positive_score, m.score AS negative_score
FROM positive p JOIN met m ON m.anchor_id = p.anchor_id AND NOT m.same
 AND 80 * p.positive_score <= 100 * m.score AND 100 * m.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY m.score DESC, m.other_id)
QUALIFY row_number() OVER w <= 5
"""
