"""Near-duplicate classes by SetSketch registers.

A document's set holds its distinct five-word shingles.  SetSketch keeps, for
each of REGISTERS registers, the smallest of exponentially distributed hash
values of the set's elements, on an exponentially spaced, truncated integer
scale: registers of a union are the larger registers of the parts, and two sets
agree in a register with a probability that grows with their Jaccard similarity.

1. Sketch: one pass over the texts.
2. Exact copies: documents with the same set form a class; its smallest id stands for it.
3. Bands: BANDS groups of ROWS register values.  A pair at similarity 0.75 misses
   every band with a probability under 1e-10.
4. Pivots: in each band bucket all members are compared with one member, so the
   pairs are as many as the rows.  A pair whose joint register likelihood rules out
   the threshold goes by its registers alone; only for the others are shingle sets
   fetched and compared.  A pivot's body travels once for STAR members, not once a pair.
5. Rest: members of a bucket that are in different components after that meet in
   groups, in which pairs within a component are never compared and a pair is
   compared only if it shares one of its rarest shingles (two sets at 0.75 share one
   of the first n - ceil(0.75 n) + 1 in order of rarity).  Buckets whose pivots are in one
   component form one group, so a document comes once and not once a bucket, unless
   going bucket by bucket moves fewer rows.  Groups over BLOCK documents are split: the members
   outside the largest component, in blocks, meet each other and the blocks of the
   largest component, which are never compared among themselves.
6. Components by repeated contraction of the link graph.

Defined results: null or empty text, or text without words: set size 0, linked
with nothing.  Rows that share a doc_id are one document: whatever one of its texts
is linked with, all are linked with; each row comes back with its own n_shingles and
the common component_id.  A null doc_id takes no part in links: its component_id is
null and it is kept.  An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.session import cut, prepared, small, table
from tablewright.llm.words import U64, binaries, chunks, mix, segment, string_lists

SHINGLE = 5
REGISTERS, ROWS = 256, 4
BANDS = REGISTERS // ROWS
#: Base and offset of the exponentially spaced register scale; registers are cut off at 0 and 65535.
SCALE, OFFSET = 1.02, 200.0
#: Similarity threshold, as a fraction of integers.
NUM, DEN = 75, 100
#: A pair is ruled out when the threshold is this many log-likelihood units under the best similarity (six sigma).
RULED_OUT = 18.0
#: A pivot's body travels once for about so many members of its buckets, and so many shingles.
STAR, STAR_SHINGLES = 1024, 1_000_000
#: A block of an open group holds about so many documents, and so many shingles.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000


def shingles(words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, flat, and each document's count."""
    h = words.prefix_hash()
    first = words.first
    with np.errstate(over="ignore"):
        size = max(len(h) - n + 1, 0)
        rolled = np.zeros(size, dtype=U64)
        for k in range(n):
            rolled = rolled * U64(0xD6E8FEB86659FD93) + h[k : k + size]
        rolled = mix(rolled)
    out, counts = [], np.zeros(len(first) - 1, dtype=np.int64)
    for d in range(len(first) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= n:
            s = np.sort(rolled[a : b - n + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            with np.errstate(over="ignore"):
                x = U64(b - a)
                for v in h[a:b]:
                    x = x * U64(0xD6E8FEB86659FD93) + v
                s = mix(np.array([x], dtype=U64) ^ U64(0xA5A5A5A5A5A5A5A5))
        else:
            continue
        out.append(s)
        counts[d] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, U64)), counts


def registers(flat: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (documents x m, uint16) of flat element hashes.

    Each element's hash seeds a Poisson process of rate m whose arrivals fall on
    registers at random, so the first arrival in each register is exponential and
    independent of the others.  An element stops once its next arrival is later than
    the largest register minimum, so large sets cost about one arrival an element.
    """
    docs = np.repeat(np.arange(len(counts)), counts)
    low = np.full((len(counts), m), np.inf)
    flat_low = low.reshape(-1)
    state, when = flat.copy(), np.zeros(len(flat))
    with np.errstate(over="ignore", divide="ignore"):
        while len(state):
            state = state + U64(0x9E3779B97F4A7C15)
            r = mix(state)
            when = when - np.log(((r >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
            alive = when < low.max(axis=1)[docs]
            state, when, docs, r = state[alive], when[alive], docs[alive], r[alive]
            np.minimum.at(flat_low, docs * m + (r & U64(m - 1)).astype(np.int64), when)
        k = np.floor(1 + OFFSET - np.log(low) / np.log(SCALE))
    return np.clip(np.nan_to_num(k, neginf=0), 0, 65535).astype(np.uint16)


def band_keys(reg: np.ndarray) -> np.ndarray:
    """One 64-bit key for each document and band."""
    v = reg.reshape(len(reg), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64), (len(reg), BANDS)).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key * U64(65537) + v[:, :, k])
    return key


def _sketch(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for a, b, raw, offsets in chunks(column):
                flat, counts = shingles(segment(raw, offsets))
                reg = registers(flat, counts)
                ends = np.concatenate(([0], np.cumsum(counts)))
                h1, h2 = np.concatenate(([U64(0)], np.cumsum(flat))), np.concatenate(([U64(0)], np.cumsum(mix(flat ^ U64(0x5851F42D4C957F2D)))))
                s1, s2 = h1[ends[1:]] - h1[ends[:-1]], h2[ends[1:]] - h2[ends[:-1]]
                some = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[a:b].cast(pa.int64()),
                        pa.array(counts),
                        pa.array(s1.view(np.int64)),
                        pa.array(s2.view(np.int64)),
                        binaries([r.tobytes() if ok else b"" for r, ok in zip(reg, some)]),
                    ],
                    names=["doc_id", "n_shingles", "s1", "s2", "reg"],
                )


def _buckets(batches):
    """(node, n, bands) from registers."""
    for batch in batches:
        reg = np.frombuffer(b"".join(batch.column("reg").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        with np.errstate(over="ignore"):
            keys = band_keys(reg)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), string_lists(keys.view(np.int64).reshape(-1), np.full(len(reg), BANDS), pa.int64())], names=["node", "n", "bands"])


SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, reg binary"


def sketches(docs: DataFrame) -> DataFrame:
    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketch, SKETCH)


def possible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the joint likelihood of two documents' registers leaves the threshold possible.

    With u and v the shares of both set sizes, a register of the first is larger with
    probability p(u - vJ) and of the second with p(v - uJ); the counts of larger, smaller
    and equal registers thus have a likelihood in J.  It is compared on a grid.
    """
    up, down = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - up - down
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def likelihood(j):
        with np.errstate(divide="ignore", invalid="ignore"):
            p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)
            a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
            return up * np.log(a) + down * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for f in np.linspace(0.0, 1.0, 81):
        j = most * f
        value = likelihood(j)
        better = value > best
        best[better], at[better] = value[better], j[better]
    edge = likelihood(np.minimum(NUM / DEN, most))
    return (at >= NUM / DEN) | (best - edge < RULED_OUT)


def _sets(batches):
    """(node, body): each document's sorted shingle hashes as bytes."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column("text")):
                flat, counts = shingles(segment(raw, offsets))
                bodies = [s.tobytes() for s in np.split(flat, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), binaries(bodies)], names=["node", "body"])


def _alike(pivot: list[bytes], body: list[bytes], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether registers leave a pair of each row possible."""
    ra, rb = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (pivot, body))
    return possible(ra, rb, na.astype(float), nb.astype(float))


def _linked(pivot: list[bytes], body: list[bytes], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the pair of each row is linked, on full sets."""
    out = np.zeros(len(body), dtype=bool)
    for i, (x, y) in enumerate(zip(pivot, body)):
        both = np.concatenate((np.frombuffer(x, U64), np.frombuffer(y, U64)))
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        out[i] = DEN * shared >= NUM * (na[i] + nb[i] - shared)
    return out


def _stars(test):
    """Pairs (a, b, n_b) that pass the test, from rows in order of (a, part, side): the pivot, then its members."""

    def run(batches):
        held: list[tuple[int, int, bytes]] = []  # the pivot's texts so far: mostly one
        for batch in batches:
            a, side, node, n = (batch.column(c).to_numpy() for c in ("a", "side", "node", "n"))
            body = batch.column("body").to_pylist()
            left: list[tuple[int, int, bytes]] = []
            right = []
            for i in range(len(a)):
                if side[i] == 0:
                    if held and held[0][0] != a[i] or i and side[i - 1] == 1:
                        held = []
                    held.append((int(a[i]), int(n[i]), body[i]))
                elif held and held[0][0] == a[i]:
                    left += held
                    right += [i] * len(held)
            if not right:
                continue
            at = np.array(right)
            na = np.array([x[1] for x in left])
            ok = test([x[2] for x in left], [body[i] for i in right], na, n[at])
            at = at[ok]
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(node[at]), pa.array(n[at])], names=["a", "b", "n_b"])

    return run


def _tested(pairs: DataFrame, bodies: DataFrame, test) -> DataFrame:
    """The pairs (a pivot, b) that pass the test on their bodies; bodies: node, n, body.

    Pivots may be hot, so their members are dealt to parts of bounded size and the pivot's body to each part once.
    """
    size = pairs.groupBy("a").agg(F.count("*").alias("rows"), F.sum("n_b").alias("n_all"))
    parts = F.greatest(F.ceil(F.col("rows") / STAR), F.ceil(F.col("n_all") / STAR_SHINGLES)).cast("long")
    size = size.select("a", parts.alias("parts"))
    member = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("node"))
    member = member.join(bodies, "node").select("a", "part", F.lit(1).alias("side"), "node", "n", "body")
    pivot = size.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("node", F.col("a"))
    pivot = pivot.join(bodies, "node").select("a", "part", F.lit(0).alias("side"), "node", "n", "body")
    rows = pivot.unionAll(member).repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return rows.mapInArrow(_stars(test), "a long, b long, n_b long")


def _block(table_: pa.Table) -> pa.Table:
    """A spanning forest of the links between components (a, b), among members of two blocks of a group, on full sets.

    Shingles are ranked by rarity in the group; a member meets those that have one of its rarest in theirs.
    """
    comps, side = (table_.column(c).to_numpy() for c in ("comp", "side"))
    same_block = bool(table_.column("same_block")[0].as_py())
    sets = [np.frombuffer(x, U64) for x in table_.column("body").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    code = rank[code]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    code = [np.sort(code[bounds[i] : bounds[i + 1]]) for i in range(len(sets))]
    lead = sizes - -(-NUM * sizes // DEN) + 1
    leads = np.concatenate([c[:k] for c, k in zip(code, lead)])
    owner = np.repeat(np.arange(len(sets)), lead)
    order = np.argsort(leads, kind="stable")
    owner, begin = owner[order], np.searchsorted(leads[order], np.arange(len(times) + 1))
    parent: dict[int, int] = {}

    def root(c):
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    a, b = [], []
    mark = np.zeros(len(times), dtype=bool)
    for i in np.flatnonzero(side == 0).tolist():
        met = [owner[begin[c] : begin[c + 1]] for c in code[i][: lead[i]].tolist()]
        other = np.unique(np.concatenate(met))
        other = other[other > i] if same_block else other[side[other] == 1]
        other = other[(comps[other] != comps[i]) & (DEN * np.minimum(sizes[other], sizes[i]) >= NUM * np.maximum(sizes[other], sizes[i]))]
        if not len(other):
            continue
        mark[code[i]] = True
        for at in range(0, len(other), 256):
            some = other[at : at + 256]
            start = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            shared = np.add.reduceat(mark[np.concatenate([code[j] for j in some])], start, dtype=np.int64)
            for j in some[DEN * shared >= NUM * (sizes[i] + sizes[some] - shared)].tolist():
                x, y = root(int(comps[i])), root(int(comps[j]))
                if x != y:
                    parent[x] = y
                    a.append(comps[i])
                    b.append(comps[j])
        mark[code[i]] = False
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node reachable, for every node with a link.

    Each round every node moves to its smallest neighbour and the graph is contracted
    along these moves; the edge list shrinks until none is left.  The moves are followed
    from first to last at the end.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        move = cut(both(edges).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")))
        if labels is None:
            labels = move.select(F.col("u").alias("node"), F.col("to").alias("comp"))
        else:
            labels = labels.join(move.withColumnRenamed("u", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        ends = edges.join(move.select(F.col("u").alias("a"), F.col("to").alias("ta")), "a").join(move.select(F.col("u").alias("b"), F.col("to").alias("tb")), "b")
        edges = cut(ends.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b"))
    return cut(labels)


def _sized(members: DataFrame) -> DataFrame:
    """For each group: its largest component, its blocks of other members and of the largest, and the rows these make."""
    group = ("kind", "hub", "gid")
    each = members.groupBy(*group, "comp").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    of = each.groupBy(*group).agg(F.max(F.struct("docs", "n", "comp")).alias("top"), F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    blocks = lambda docs, n: F.greatest(F.ceil(docs / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("long")
    one = (F.col("docs") <= BLOCK) & (F.col("n") <= BLOCK_SHINGLES)
    of = of.withColumn("left", F.when(one, F.lit(1).cast("long")).otherwise(blocks(F.col("docs") - F.col("top.docs"), F.col("n") - F.col("top.n"))))
    of = of.withColumn("right", F.when(one, F.lit(0).cast("long")).otherwise(blocks(F.col("top.docs"), F.col("top.n"))))
    rows = F.when(one, F.col("docs")).otherwise((F.col("docs") - F.col("top.docs")) * (F.col("left") + F.col("right")) + F.col("top.docs") * F.col("left"))
    return of.select(*group, F.col("top.comp").alias("top"), "left", "right", rows.alias("rows"))


def _rest(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """Links (a, b) between components among the members of open buckets: key, hub (the pivot's component), node, n, comp."""
    # kind 0: all buckets of a hub as one group; kind 1: each bucket its own
    members = open_.select(F.lit(0).alias("kind"), "hub", F.col("hub").alias("gid"), "node", "n", "comp").distinct()
    members = cut(members.unionAll(open_.select(F.lit(1).alias("kind"), "hub", F.col("key").alias("gid"), "node", "n", "comp")))
    sizes = cut(_sized(members))
    take = sizes.groupBy("hub").agg((F.sum(F.when(F.col("kind") == 0, F.col("rows"))) > F.sum(F.when(F.col("kind") == 1, F.col("rows")))).cast("int").alias("kind"))
    chosen = members.join(sizes.join(take, ["hub", "kind"]).drop("hub", "rows"), ["kind", "gid"])
    large = (F.col("right") > 0) & (F.col("comp") == F.col("top"))
    digest = F.xxhash64("node", "gid")
    at = F.when(large, F.col("left") + F.pmod(digest, F.col("right"))).otherwise(F.pmod(digest, F.col("left")))
    last = F.when(large, F.col("left")).otherwise(F.col("left") + F.col("right")) - 1
    spread = chosen.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    spread = spread.select("kind", "gid", "node", "comp", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), (F.col("at") > F.col("other")).cast("int").alias("side"))
    members = spread.join(_bodies(docs, members.where("kind = 0")), "node").withColumn("same_block", F.col("i") == F.col("j"))
    return members.groupBy("kind", "gid", "i", "j").applyInArrow(_block, "a long, b long")


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, body) of the wanted nodes."""
    ids = small(cut(wanted.select(F.col("node").alias("doc_id")).distinct()))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "node long, body binary").where(F.length("body") > 0)


def _repeated(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of doc_ids that come with several texts to the classes of these."""
    rows, ids = sketch.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return sketch.sparkSession.createDataFrame([], "a long, b long")
    again = sketch.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id")
    return sketch.join(again, "doc_id", "left_semi").join(classes, ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, and class_id (its exact copies' smallest id)."""
    sketch = cut(sketches(docs))
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = cut(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id")))
    # each class once, under its smallest id, in each of its buckets
    rep = some.join(classes.select("s1", "s2", F.col("class_id").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi")
    rep = rep.select("doc_id", F.col("n_shingles").alias("n"), "reg")
    rows = rep.mapInArrow(_buckets, "node long, n long, bands array<long>").select("node", "n", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("n_bucket"), F.min(F.struct("node", "n")).alias("pivot")).where("n_bucket > 1")
    bucket = cut(rows.join(full.select("key", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("n_pivot")), "key"))
    near = f"{DEN} * least(n, n_pivot) >= {NUM} * greatest(n, n_pivot)"
    pairs = bucket.where("node <> pivot").where(near).select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("n").alias("n_b")).distinct()
    alike = cut(_tested(pairs, rep.select(F.col("doc_id").alias("node"), "n", F.col("reg").alias("body")), _alike))
    bodies = cut(_bodies(docs, alike.select(F.col("a").alias("node")).unionAll(alike.select(F.col("b").alias("node")))))
    bodies = bodies.select("node", (F.length("body") / 8).cast("long").alias("n"), "body")
    links = cut(_tested(alike, bodies, _linked).select("a", "b").unionAll(_repeated(some, classes)))
    comp = components(links)

    # what the pivots leave open: buckets with members, the pivot aside, in several components
    own = lambda c, name: F.coalesce(F.col(name), F.col(c)).alias(name)
    open_ = bucket.where("node <> pivot").join(comp, "node", "left").join(comp.select(F.col("node").alias("pivot"), F.col("comp").alias("hub")), "pivot", "left")
    open_ = open_.select("key", "node", "n", own("node", "comp"), own("pivot", "hub"))
    several = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = cut(open_.join(several, "key"))
    named = classes.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left").select("s1", "s2", "class_id", own("class_id", "comp"))
    if not open_.isEmpty():
        joined = components(_rest(docs, open_)).select(F.col("node").alias("comp"), F.col("comp").alias("now"))
        named = named.join(joined, "comp", "left").select("s1", "s2", "class_id", F.coalesce("now", "comp").alias("comp"))
    out = sketch.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(prepared(spark), sf_dir, "documents"))
