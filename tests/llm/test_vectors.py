"""Nearest neighbours and hard negatives against brute force."""

import numpy as np
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from tablewright.llm import nearest, negatives, queries, vectors

DIR = "/root/testdata/sf0.01"
ROWS = "vec_id long, embedding array<float>, label int"


def table(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.label for r in rows])


def made(kind, n, dims, seed=0):
    """Vectors of several kinds: clusters, equal rows, very different norms."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    if kind == "clusters":
        x = 3 * rng.normal(size=(8, dims))[rng.integers(0, 8, n)] + 0.3 * x
    if kind == "copies":
        x = x[rng.integers(0, n // 6, n)]
    if kind == "norms":
        x *= rng.lognormal(0, 0.5, size=(n, 1))
    return x.astype(np.float32).astype(np.float64)


def true_nearest(ids, x, queries_, wanted):
    out = {}
    for q in queries_:
        score = nearest.in_order(x, np.broadcast_to(x[q], x.shape))
        order = [i for i in np.lexsort((ids, -score)) if i != q][:wanted]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def read(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def test_nearest_query_recall_and_scores(spark):
    ids, x, _ = table(spark)
    df = queries.queries()["op12_nearest"](spark, DIR)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = read(df), true_nearest(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(s == nearest.in_order(x[[q]], x[[i]])[0] for i, s in rows)


@pytest.mark.parametrize("kind,dims,part", [("clusters", 48, 150), ("copies", 20, 10_000), ("norms", 96, 300)])
def test_nearest_on_made_vectors(spark, monkeypatch, kind, dims, part):
    """Several parts and salts, fewer and more dimensions than bits, equal rows."""
    monkeypatch.setattr(nearest, "PART_ROWS", part)
    x = made(kind, 1500, dims)
    ids = np.arange(len(x)) * 3
    rows = vectors.usable(spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], ROWS), "vec_id", "embedding")
    got, want = read(nearest.nearest(rows, F.col("id") % 20 == 0, 7)), true_nearest(ids, x, np.flatnonzero(ids % 20 == 0), 7)
    assert recall(got, want) >= 0.9 and got.keys() == want.keys()
    if kind == "copies":  # equal vectors are found with each other, the smaller id first
        same = [q for q, w in want.items() if w[0][1] == w[-1][1]]
        assert all(got[q] == want[q] for q in same)


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for _ in range(20):
        i = rng.integers(len(codes))
        flips = rng.permutation(64)[: rng.integers(0, 25)]
        codes[rng.integers(len(codes))] = codes[i] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
    for radius in (0, 3, 7, 10, 23, 24, 64):
        allowed = nearest.radii(np.array([radius]))[0]
        near = nearest._ONES[nearest.substrings(codes[:, None] ^ codes[None, :300])] <= allowed
        within = np.bitwise_count(codes[:, None] ^ codes[None, :300]) <= radius
        assert (near.any(axis=2) | ~within).all()


def test_reach_grows_with_the_angle():
    codes = nearest.Codes(made("clusters", 500, 64), 20.0)
    assert codes.reach == sorted(codes.reach) and codes.reach[0] < 8 and 25 <= codes.reach[90] <= 48 and len(codes.reach) == 181


ODD = [(1, [1.0, 2.0], 3), (2, None, 3), (3, [], 3), (4, [0.0, 0.0], 3), (5, [1.0, None], 3), (6, [float("nan"), 1.0], 3), (7, [float("inf"), 1.0], 3), (8, [1.0, 2.0, 3.0], 3), (None, [1.0, 1.0], 3), (20, [1.0, 1.0], None), (20, [1.0, 1.0], None), (40, [-1.0, 1.0], 4), (100, [2.0, 1.0], 3), (100, [3.0, 1.0], 3), (200, [1e30, 1e30], 4)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ROWS).withColumns({c: F.lit("x") for c in ("id", "vector", "code", "radius", "kind", "cluster", "block", "least", "norm", "score", "rank")})


def test_nearest_odd_rows(spark, odd):
    """Rows without an id or a usable vector take no part; of a repeated id one row stays; few candidates are all returned."""
    got = read(nearest.nearest(vectors.usable(odd, "vec_id", "embedding"), F.col("id") % 20 == 0))
    kept = {1: [1, 2], 20: [1, 1], 40: [-1, 1], 100: [2, 1], 200: [np.float64(np.float32(1e30))] * 2}
    want = true_nearest(np.array(list(kept)), np.array(list(kept.values()), dtype=float), [1, 2, 3, 4], 20)
    assert got == want
    one = spark.createDataFrame([(20, [1.0], 1)], ROWS)
    assert nearest.nearest(vectors.usable(one, "vec_id", "embedding"), F.lit(True)).count() == 0
    assert nearest.nearest(vectors.usable(one.limit(0), "vec_id", "embedding"), F.lit(True)).count() == 0


def true_negatives(ids, x, label, anchors, low=80, high=100):
    out = []
    for a in anchors:
        score = x @ x[a]
        order = [i for i in np.lexsort((ids, -score)) if i != a]
        for p in [i for i in order if label[i] == label[a]][:5]:
            fits = [i for i in order if label[i] != label[a] and low * score[p] <= high * score[i] <= high * score[p]][:5]
            out += [(int(ids[a]), int(ids[p]), k + 1, int(ids[i]), int(score[p]), int(score[i])) for k, i in enumerate(fits)]
    return sorted(out)


def test_negatives_sql(spark):
    assert compare(queries.queries()["op13_negatives"](spark, DIR), duck(DIR), negatives.ORACLE) > 50


@pytest.mark.parametrize("kind", ["clusters", "copies", "norms"])
def test_negatives_on_made_vectors(spark, monkeypatch, kind):
    """Several clusters, slices, blocks and steps; ties by id; walks that end early."""
    for name, value in (("PER_CLUSTER", 20), ("FIRST", 60), ("BLOCK", 100), ("STRIDE", 32)):
        monkeypatch.setattr(negatives, name, value)
    x = np.floor(made(kind, 1200, 12) * 4)
    ids, label = np.random.default_rng(4).permutation(5000)[:1200], np.random.default_rng(2).integers(0, 4, 1200)
    rows = spark.createDataFrame([(int(i), int(k), v.tolist()) for i, k, v in zip(ids, label, x)], "id long, label long, vector array<double>")
    got = sorted(map(tuple, negatives.hard_negatives(rows, F.col("id") % 10 == 0).collect()))
    assert got == true_negatives(ids, x, label, np.flatnonzero(ids % 10 == 0))


def test_walks_of_clustered_anchors_end_early(spark, monkeypatch):
    """On clustered vectors members stop after few slices: most of the lists is never dealt out."""
    for name, value in (("PER_CLUSTER", 10), ("FIRST", 40)):
        monkeypatch.setattr(negatives, name, value)
    x, label = made("clusters", 2000, 32, 5), np.random.default_rng(2).integers(0, 4, 2000)
    rows = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x))], "id long, label long, vector array<double>")
    lists = negatives.Lists(rows, rows.where("id % 25 = 0"))
    dealt, walked = [], negatives.Lists.walked
    monkeypatch.setattr(negatives.Lists, "walked", lambda self, open_, step, *a: dealt.extend(self.sizes[c, slice(*self.slices[c][step])].sum() for c in {r[0] for r in open_.select("cluster").collect()} if step < len(self.slices[c])) or walked(self, open_, step, *a))
    negatives.hard_negatives(rows, F.col("id") % 25 == 0).count()
    assert sum(dealt) < 0.6 * 2 * lists.sizes.sum()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, a = rng.normal(size=(400, 9)), rng.normal(size=(60, 9))
    centre = negatives.centres(a, 4)
    apart = negatives.angles(a, centre)
    own = np.argmin(apart, axis=1)
    widths = np.array([apart[own == c, c].max(initial=0) for c in range(len(centre))])
    bound = negatives.bounds(x, centre, widths)
    assert ((x @ a.T) <= negatives.norms(a) * bound[:, own] + 1e-9).all()


def test_negatives_odd_rows(spark, odd):
    rows = vectors.usable(odd, "vec_id", "embedding", F.col("label").cast("long").alias("label"))
    kept = {1: ([1, 2], 3), 4: ([0, 0], 3), 40: ([-1, 1], 4), 100: ([2, 1], 3), 200: ([1e3, 1e3], 4)}
    rows = rows.withColumn("vector", F.when(F.col("id") == 200, F.array(F.lit(1e3), F.lit(1e3))).otherwise(F.col("vector")))
    got = sorted(map(tuple, negatives.hard_negatives(rows, F.lit(True)).collect()))
    ids, x, label = np.array(list(kept)), np.array([v for v, _ in kept.values()], dtype=float), np.array([k for _, k in kept.values()])
    assert got == true_negatives(ids, x, label, range(len(ids)))
    assert negatives.hard_negatives(rows, F.lit(False)).count() == 0
    assert negatives.hard_negatives(rows.limit(0), F.lit(True)).count() == 0
