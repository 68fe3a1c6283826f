"""Nearest neighbours by inner product with multi-index hashing.

1. Vectors are stretched by one component, sqrt(M^2 - |x|^2) with M the largest norm, and
   queries by 0: the cosine of the stretched vectors then orders as the inner product does.
2. Codes of BITS bits: on a sample of at most SAMPLE rows, principal directions and the
   rotation that loses least by taking signs (ITQ) are learned; where the directions are fewer
   than the bits, further rotations follow.
3. A code is cut into TABLES substrings, each the key of an index of all rows.  An index is
   dealt by the leading bits of the substring into parts of about PART_ROWS rows, and hot parts by
   a digest of the id as well.
4. A query with radius R asks, by the pigeonhole rule, table i for all substrings within
   R // TABLES (one less beyond table R mod TABLES); it goes only to parts that hold any.  So
   every code within R is found in some table; of the tables that hold it, the first one
   reports it.  Found vectors are ranked by their inner products on the original numbers.
5. The radius grows until it covers what can still matter: from its 20th best product so far
   a query has the angle beyond which no row is wanted, and the sample tells at which
   Hamming distance QUANTILE of the vectors at that angle lie.  A query that has found fewer
   rows than wanted goes on to the whole code length, so that no row is out of reach.

A task holds one part of one index and reads its queries as a stream, so neither grows with
the table.  Products are summed by component in order: equal vectors have equal scores
wherever they lie, and ties go to the smaller id.

Defined results: see vectors; vectors of norm 0 take no part either.  A query with fewer
candidates than wanted gets all of them, one without any gets no row.  An empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.session import cut, prepared, small, table
from tablewright.llm.vectors import FLOATS, matrix, streamed, usable

BITS, TABLES = 64, 4
WIDTH = BITS // TABLES
#: Rows that the codes are learned on, at most (fewer where vectors are long).
SAMPLE, ROUNDS = 4096, 30
PART_ROWS = 32_768
QUANTILE = 0.95
#: The radius grows by so much at most from round to round.
STEP = 6
#: Products this close to the last one wanted are summed again in order.
SLACK = 1e-9
_ONES = np.array([bin(i).count("1") for i in range(1 << WIDTH)], dtype=np.uint8)
_FOUND = "query_id long, vec_id long, score double"


class Codes:
    """Learned binary codes, and the Hamming distance to expect at each angle."""

    def __init__(self, sample: np.ndarray, norm: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.norm = norm
        z = self.stretched(sample)
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        directions = np.linalg.svd(z, full_matrices=False)[2][:BITS].T
        made, bits = [], 0
        while bits < BITS:
            turn = np.linalg.qr(rng.normal(size=(directions.shape[1],) * 2))[0]
            v = z @ directions
            for _ in range(ROUNDS):
                u, _, vt = np.linalg.svd(np.sign(v @ turn).T @ v)
                turn = vt.T @ u.T
            made.append(directions @ turn)
            bits += turn.shape[1]
        self.planes = np.concatenate(made, axis=1)[:, :BITS]
        self.reach = self._reach(z, rng)

    def stretched(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1, keepdims=True), 0))], axis=1)

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        full = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self.stretched(x)
        return (full @ self.planes > 0) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64))

    def _reach(self, z: np.ndarray, rng: np.random.Generator) -> list[int]:
        """For each degree from 0 to 180, the Hamming distance that QUANTILE of pairs at that angle keep to."""
        n = 2000
        a, b = z[rng.integers(0, len(z), n)], z[rng.integers(0, len(z), n)] + 1e-3 * rng.normal(size=(n, z.shape[1]))
        side = b - (a * b).sum(axis=1, keepdims=True) * a
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        low, out = a @ self.planes > 0, []
        for degree in range(181):
            other = (np.cos(np.radians(degree)) * a + np.sin(np.radians(degree)) * side) @ self.planes > 0
            out.append(int(np.ceil(np.quantile((low != other).sum(axis=1), QUANTILE))))
        return np.maximum.accumulate(out).tolist()

    def first_radius(self, sample: np.ndarray, rows: int, wanted: int) -> int:
        """The largest radius at which a query is expected to find no more than the wanted rows."""
        codes = self.of(sample)
        far = np.bitwise_count(codes[: len(codes) // 2, None] ^ codes[None, len(codes) // 2 :])
        share = np.cumsum(np.bincount(far.reshape(-1), minlength=BITS + 1)) / max(far.size, 1)
        return int(np.searchsorted(share * rows, wanted, "right").clip(1, BITS)) - 1


def radii(radius: np.ndarray) -> np.ndarray:
    """How far each table's substring may be from the query's, -1 where the table is not asked (queries x TABLES)."""
    return radius[:, None] // TABLES - (np.arange(TABLES) > radius[:, None] % TABLES)


def substrings(codes: np.ndarray) -> np.ndarray:
    return (codes[..., None] >> (np.arange(TABLES, dtype=np.uint64) * np.uint64(WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def _coded(codes: Codes, query: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"))
            c = codes.of(x, query) if len(x) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(c.view(np.int64)), batch.column("vector")], ["id", "code", "vector"])

    return run


def _routes(bits: int) -> Callable:
    """The parts of each table that hold a substring within a query's radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.arange(1 << bits)
        for batch in batches:
            code = batch.column("code").to_numpy().view(np.uint64)
            if not len(code):
                continue
            allowed = radii(batch.column("radius").to_numpy().astype(np.int64))
            near = _ONES[(substrings(code) >> (WIDTH - bits))[:, :, None] ^ parts] <= allowed[:, :, None]
            query, tab, part = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array(tab, pa.int32()), pa.array(part, pa.int32()), *[batch.column(c).take(pa.array(query)) for c in ("id", "code", "vector", "radius", "done", "least")]], ["tab", "part", "id", "code", "vector", "radius", "done", "least"])

    return run


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed by component from the first to the last."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def _load(parts: list[pa.RecordBatch]) -> tuple:
    whole = pa.Table.from_batches(parts)
    tab = whole.column("tab")[0].as_py()
    code = whole.column("code").to_numpy().view(np.uint64)
    sub = substrings(code)[:, tab]
    order = np.argsort(sub, kind="stable")
    values, counts = np.unique(sub, return_counts=True)
    return tab, values, counts, code[order], whole.column("id").to_numpy()[order], matrix(whole.column("vector"))[order]


def _ask(wanted: int) -> Callable:
    def ask(block: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tab, values, counts, code, ids, vectors = block
        own, asked = rows.column("id").to_numpy(), rows.column("code").to_numpy().view(np.uint64)
        radius, done = rows.column("radius").to_numpy(), rows.column("done").to_numpy()
        least = rows.column("least").to_numpy(zero_copy_only=False)
        allowed, subs, queries = radii(radius.astype(np.int64)), substrings(asked), matrix(rows.column("vector"))
        query, place = [], []
        for i in range(len(own)):
            hit = np.flatnonzero(np.repeat(_ONES[values ^ subs[i, tab]] <= allowed[i, tab], counts))
            apart = code[hit] ^ asked[i]
            far = np.bitwise_count(apart)
            keep = (far <= radius[i]) & (far > done[i]) & (ids[hit] != own[i])
            hit, apart = hit[keep], apart[keep]
            if tab:
                seen = (_ONES[substrings(apart)[:, :tab]] <= allowed[i, :tab]).any(axis=1)
                hit = hit[~seen]
            if len(hit):
                product = vectors[hit] @ queries[i]
                slack = SLACK * (1 + np.abs(product).max())
                floor = least[i] if len(hit) <= wanted else max(least[i], np.partition(product, len(hit) - wanted)[len(hit) - wanted])
                hit = hit[product >= floor - slack]
                place.append(hit)
                query.append(np.full(len(hit), i))
        if not query:
            return
        query, place = np.concatenate(query), np.concatenate(place)
        score = np.concatenate([in_order(vectors[place[a : a + 4096]], queries[query[a : a + 4096]]) for a in range(0, len(place), 4096)]) if len(place) else np.zeros(0)
        order = np.lexsort((ids[place], -score, query))
        query, place, score = query[order], place[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = rank < wanted
        yield pa.RecordBatch.from_arrays([pa.array(own[query[best]]), pa.array(ids[place[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    return ask


def _index(rows: DataFrame, codes: Codes, bits: int) -> DataFrame:
    """Every row in each of its tables: tab, part, salts of that part, salt, id, code, vector."""
    coded = rows.mapInArrow(_coded(codes, False), "id long, code long, vector array<double>")
    sub = lambda i: F.shiftrightunsigned("code", WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))
    places = F.array(*[F.struct(F.lit(i).alias("tab"), F.shiftright(sub(i), WIDTH - bits).cast("int").alias("part")) for i in range(TABLES)])
    return coded.withColumn("at", F.explode(places)).select("at.tab", "at.part", "id", "code", "vector")


def nearest(rows: DataFrame, is_query: Column, wanted: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the wanted nearest rows of each query; rows: id, vector; is_query: on id."""
    rows = cut(rows.where(F.exists("vector", lambda x: x != 0)))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    size = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(squares)).alias("norm"), F.max(F.size("vector")).alias("dims")).first()
    if not size.n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(64, min(SAMPLE, FLOATS // size.dims))
    sample = np.array([r.vector for r in rows.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").collect()])
    codes = Codes(sample, size.norm)
    bits = min(WIDTH, max(0, int(np.ceil(np.log2(size.n / PART_ROWS)))))
    index = cut(_index(rows, codes, bits))
    # hot parts are dealt further; there are TABLES * 2**WIDTH parts at most
    salts = small(cut(index.groupBy("tab", "part").agg(F.ceil(F.count("*") / (2 * PART_ROWS)).cast("int").alias("salts"))))
    empty = F.lit(None)
    blocks = index.join(salts, ["tab", "part"]).select("tab", "part", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("kind"), "id", "code", "vector", empty.cast("int").alias("radius"), empty.cast("int").alias("done"), empty.cast("double").alias("least"))

    reach = F.lit(codes.reach)
    first = min(BITS, codes.first_radius(sample, size.n, wanted) if len(sample) > 1 else BITS)
    open_ = rows.where(is_query).mapInArrow(_coded(codes, True), "id long, code long, vector array<double>")
    open_ = open_.select("*", F.lit(first).alias("radius"), F.lit(-1).alias("done"), F.lit(float("-inf")).alias("least"))
    open_, found = cut(open_), None
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    while True:
        routed = open_.mapInArrow(_routes(bits), "tab int, part int, id long, code long, vector array<double>, radius int, done int, least double")
        asks = routed.join(salts, ["tab", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        met = blocks.unionByName(asks.select("tab", "part", "salt", F.lit(1).alias("kind"), "id", "code", "vector", "radius", "done", "least"))
        met = met.repartition("tab", "part", "salt").sortWithinPartitions("tab", "part", "salt", "kind")
        new = met.mapInArrow(streamed(_load, _ask(wanted), 3), _FOUND)
        every = new if found is None else found.unionByName(new)
        found = cut(every.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= wanted).select("query_id", "vec_id", "score"))
        # a query is open while its radius is under the one its last product asks for
        last = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        state = open_.join(last.withColumnRenamed("query_id", "id"), "id", "left")
        full = F.coalesce(F.col("n") >= wanted, F.lit(False))
        norm = F.sqrt(squares) * F.lit(size.norm)
        angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("last") / norm))))
        needed = F.when(full, F.element_at(reach, F.ceil(angle).cast("int") + 1)).otherwise(F.lit(BITS))
        step = F.when(full & (needed <= F.col("radius") + STEP + 2), needed).otherwise(F.least(needed, F.col("radius") + STEP))
        state = state.where(needed > F.col("radius")).select("id", "code", "vector", step.cast("int").alias("radius"), F.col("radius").alias("done"), F.when(full, F.col("last")).otherwise(F.lit(float("-inf"))).alias("least"))
        open_ = cut(state)
        if open_.isEmpty():
            return found.select("query_id", F.row_number().over(by_query).alias("rank"), "vec_id", "score")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    return nearest(usable(table(prepared(spark), sf_dir, "embeddings"), "vec_id", "embedding"), F.col("id") % 20 == 0)
