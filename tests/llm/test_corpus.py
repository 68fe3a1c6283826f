"""Corpus operators against brute force, round trips and edge rows."""

import binascii
import collections
import hashlib
import itertools
import math
import random
import types
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from tablewright.llm import audio, chat, lm, minhash, mixing, packing, pii, quality, queries, rules, subwords, toxicity
from tablewright.llm.words import segment

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, long, tied and repeated rows, and columns of clashing names."""
    rows = [(1, "plain words here", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "en", "b", 4), (5, LONG, "en", "b", 1), (6, "twin text of six words here", "en", "a", 1), (7, "twin text of six words here", "en", "a", 1), (7, "twin text of six words here", "en", "a", 1), (None, "no id", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("kept", "score", "term", "key", "node", "comp", "label", "mix_key", "curve", "spans", "_parts", "_u", "_text", "_base", "_key", "row", "cdf", "count", "id")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def words(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    compare(queries.queries()[name](spark, DIR), duck(DIR), queries.oracle_sql()[name])


def shingle_set(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def true_components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (root(i), len(s)) for i, s in sets.items()}


def test_minhash_against_all_pairs(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (3, 8, 30, 120)]
    docs = []
    for i in range(160):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: (c, n, c == i) for i, (c, n) in true_components(docs).items()}


def near_group(rng, groups, copies, words_=60, changes=8):
    docs = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(words_)]
        for _ in range(copies):
            w = list(base)
            for k in rng.sample(range(words_), rng.randrange(changes)):
                w[k] = f"n{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    return docs


@pytest.mark.parametrize("block", [7, 40, 4096])
def test_minhash_open_buckets_in_several_blocks_and_sides(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "STAR", 5)
    docs = near_group(random.Random(block), 4, 70)
    true = {i: c for i, (c, _) in true_components(docs).items()}
    assert 4 < len(set(true.values())) < 250  # some buckets stay open
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == true


def test_minhash_block_against_all_pairs():
    rng = random.Random(3)
    sets = []
    for g in range(12):
        base = rng.sample(range(g * 1000, g * 1000 + 900), 80)
        sets += [sorted(set(rng.sample(base, 70)) | {10**6 * (len(sets) + k) for k in range(rng.randrange(8))}) for _ in range(12)]
    n, bodies = len(sets), [np.array(s, np.uint64).tobytes() for s in sets]
    comp = np.arange(n) // 2  # neighbours are joined already
    linked = lambda i, j: 100 * len({*sets[i]} & {*sets[j]}) >= 75 * len({*sets[i]} | {*sets[j]})
    for same, side in ((True, np.zeros(n, int)), (False, np.arange(n) % 3 // 2)):
        rows = pa.table({"node": np.arange(n), "comp": comp, "side": side, "same_block": [same] * n, "body": pa.array(bodies, pa.binary())})
        got = minhash._block(rows).to_pydict()
        want = [(i, j) for i in range(n) for j in range(i) if (same or side[i] != side[j]) and comp[i] != comp[j] and linked(i, j)]
        assert len(got["a"]) < n and len(want) > 50
        assert true_labels(comp.tolist(), zip(got["a"], got["b"])) == true_labels(comp.tolist(), [(comp[a], comp[b]) for a, b in want])


def true_labels(nodes, pairs):
    label = {x: x for x in nodes}
    for a, b in pairs:
        lo, hi = sorted((label[a], label[b]))
        label = {k: lo if v == hi else v for k, v in label.items()}
    return label


def test_minhash_rows_of_one_id_are_one_document(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, one), (5, one), (5, two), (9, two), (9, two), (7, "alone in its own words here")]
    got = sorted(tuple(r)[:4] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 26, 1, True), (5, 26, 1, False), (5, 26, 1, False), (7, 2, 7, True), (9, 26, 1, False), (9, 26, 1, False)]


def test_registers_do_not_rule_out_linked_pairs():
    rng = np.random.default_rng(8)
    flat, sizes = [], []
    for _ in range(1500):
        n = int(rng.integers(40, 300))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        keep = -(-6 * n // 7)  # two sets of n with 6/7 n in common have a similarity of 0.75
        y = np.concatenate((x[:keep], rng.integers(0, 2**63, n - keep).astype(np.uint64)))
        flat += [x, y]
        sizes += [n, n]
    with np.errstate(over="ignore"):
        reg = minhash.registers(np.concatenate(flat), np.array(sizes))
    n = np.array(sizes[::2], float)
    assert minhash.possible(reg[::2], reg[1::2], n, n).all()
    same = (minhash.band_keys(reg[::2]) == minhash.band_keys(reg[1::2])).sum(axis=1)
    assert same.min() > 0 and same.mean() > 15


def test_minhash_odd_rows(odd, empty):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect())
    assert len(got) == 9 and (2, 0, 2, True) in got and (4, 0, 4, True) in got and (5, 1, 5, True) in got and (-1, 1, None, True) in got
    assert got.count((7, 2, 6, False)) == 2
    assert minhash.near_duplicates(empty).count() == 0


def test_registers_merge_and_estimate():
    with np.errstate(over="ignore"):
        rng = np.random.default_rng(0)
        x = rng.integers(0, 2**63, 1200).astype(np.uint64)
        a, b = x[:1000], x[200:]
        reg = minhash.registers(np.concatenate((a, b, x)), np.array([1000, 1000, 1200]))
    assert (np.maximum(reg[0], reg[1]) == reg[2]).all()
    assert abs((reg[0] == reg[1]).mean() - 800 / 1200) < 0.12
    n = np.array([1000.0])
    assert minhash.possible(reg[:1], reg[1:2], n, n)[0]
    assert not minhash.possible(reg[:1], minhash.registers(x[1000:].repeat(1), np.array([200])), n, np.array([200.0]))[0]


def test_mixing_means_and_edges(spark, odd, empty):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("ten chars!").alias("text"), F.when(F.col("id") % 4 == 0, "s").otherwise("t").alias("source"))
    weights = spark.createDataFrame([("s", 3.0), ("t", 1.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.mix(docs, weights).groupBy("source").count().collect()}
    assert abs(n["s"] - 3000) < 250 and abs(n["t"] - 1000) < 150
    big = mixing.mix(docs.where("doc_id < 40"), weights, budget=400_000.0).count()
    assert abs(big - 40_000) < 1500  # rates far over one part
    out = mixing.mix(odd)
    assert out.columns[-1] == "mix_key" and out.where("doc_id = 7").count() % 2 == 0
    assert mixing.mix(empty).count() == 0
    with pytest.raises(Exception):
        mixing.mix(docs, spark.createDataFrame([("s", -1.0)], "source string, weight double")).count()


def true_spans(t):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def good(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in patterns for m in re.finditer(p, t) if good(k, m[0])]


HARD = ["a@b.c_d@e.f x@y.z.", "a@b.c..d e@f..g", "1.2.3.4.5.6.7.8 300.1.2.3 001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 4 1", "+1 (555) 010-9999 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é😀 bob@x.org é +49 30 1234567", "@" * 50 + "a" * 5000, "a.b" * 3000 + "@c.d" + ".e" * 4000, "1." * 5000, "", None]


def test_pii_base_spans(spark):
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice("ab1.@+-() 5é_%") for _ in range(200)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in pii.detect(df).select("row.doc_id", "_base").collect():
        got[r.doc_id] = [f"{k}:{s.start}:{s.end}" for k in pii.KINDS for s in r["_base"][k]]
    assert got == {i: true_spans(t or "") for i, t in enumerate(texts)}


def test_pii_terms_and_redaction(spark, odd, empty):
    rows = [(i, f"common words n{i} z{i} for bob@x.org project Quixotal, today", None, None, 9) for i in range(5)] + [(100 + i, f"common words for today project q{i} r{i}", "en", "s", 1) for i in range(2000)]
    out = {r.doc_id: r for r in pii.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[0].text == "common words n0 z0 for [EMAIL] project [REMOVED], today" and out[0].n_chars == len(out[0].text)
    assert out[100].text == rows[5][1]
    same = pii.redact(odd)
    assert same.columns == odd.columns and same.where("text is null").count() == 1 and same.where("doc_id = 5").first().text == LONG
    assert pii.redact(empty).count() == 0


def test_pii_terms_against_plain_counts(spark):
    rng = random.Random(11)
    texts = []
    for i in range(400):
        words_ = [f"w{rng.randrange(60)}" for _ in range(12)]
        k = rng.randrange(12)
        if k < 6:
            words_.insert(rng.randrange(12), f"user{k}@mail.example")
            words_ += [f"tell{k}" for _ in range(2) if rng.random() < 0.8] + [f"hint{k}"]
        elif k < 8:
            words_.append(f"hint{k - 6}")
        texts.append(" ".join(words_))
    texts += [*texts[:30], "mailto:user0@mail.example glued", None]
    n, n_t, n_c, n_tc = len({t or "" for t in texts}), collections.Counter(), collections.Counter(), collections.Counter()
    for t in {t or "" for t in texts}:
        of, rest = set(re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)), re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", " ", t)
        own = {w.strip(pii.EDGE).lower() for w in rest.split()} - {""}
        n_t.update(own)
        n_c.update(of)
        n_tc.update((c, w) for c in of for w in own)
    want: dict[str, bool] = {}
    for (c, w), k in n_tc.items():
        ic = math.log2(n / n_c[c])
        ratio = math.log2(k * n / (n_t[w] * n_c[c])) / ic
        if k >= 2 and ratio >= 0.7 and k * ic >= 12:
            want[w] = want.get(w, False) or ratio >= 0.95
    assert len(want) > 5 and len(set(want.values())) == 2
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce("t", F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    got = pii.disclosing(df, generalise=0.7, remove=0.95, support=2, evidence=12.0)[0].collect()
    assert {r.term: r.removed for r in got} == want


def test_quality_grades_in_order(spark, odd, empty):
    rng = random.Random(4)
    good, mid, bad = ([f"{c}{i}" for i in range(40)] for c in "gmb")
    docs = [(i, " ".join(rng.choice((bad, mid, good)[i % 3] + good[:5]) for _ in range(60)), i % 3) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string, g int")
    model = quality.train(df, df.where("doc_id < 150").select("doc_id", F.col("g").alias("grade")))
    assert (np.diff(model[1]) > 0).all()
    rest = [r for r in quality.classify(df, model).collect() if r.doc_id >= 150]
    assert np.mean([round(r.expected_grade) == r.g for r in rest]) > 0.95
    assert all(r.kept == (r.p_keep >= 0.5) for r in rest)
    out = quality.classify(odd, model)
    assert out.count() == 9 and not any(r.kept for r in out.where("doc_id in (2, 3, 4)").collect())
    assert quality.train(empty, quality.graded(spark.createDataFrame([], "doc_id long, quality int, toxic int"))) is None
    assert quality.classify(empty, None).count() == 0


def test_quality_gradient_against_likelihood():
    rng = np.random.default_rng(6)
    n, grades = 40, 3
    size = rng.integers(1, 6, n)
    index, value, grade = rng.integers(0, 12, size.sum()), rng.random(size.sum()), rng.integers(0, grades, n)
    w, theta = quality.fit(index, value, size, grade, grades, steps=1500)
    row = np.repeat(np.arange(n), size)

    def penalised(w_, theta_):
        z = np.bincount(row, value * w_[index], minlength=n)
        p = np.diff(np.concatenate((np.zeros((n, 1)), 1 / (1 + np.exp(-(theta_[None] - z[:, None]))), np.ones((n, 1))), axis=1), axis=1)
        return np.log(p[np.arange(n), grade]).mean() - quality.RIDGE / 2 * (w_**2).sum()

    best = penalised(w, theta)
    for i in range(12):  # no step away from what was fitted does better
        for step in (-0.2, 0.2):
            other = w.copy()
            other[i] += step
            assert penalised(other, theta) < best + 1e-6
    for step in ((0.2, 0), (-0.2, 0), (0, 0.2), (0, -0.2)):
        assert penalised(w, theta + np.array(step)) < best + 1e-6


def test_toxicity_sample_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 100)
    docs = spark.createDataFrame([(i, "x" * 30) for i in range(40)] + [(3, "y" * 31), (100, "z" * 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(100, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled(docs, labels).collect()
    assert all(sum(len(r.text) for r in got if r.toxic == k) <= 50 or sum(r.toxic == k for r in got) == 1 for k in (0, 1))
    assert {r.toxic for r in got} == {0, 1} and not any(binascii.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


def test_lm_base_and_probability(spark, odd, empty, documents):
    for df in (documents, odd):
        docs = df.select("doc_id", "text").collect()
        train = lambda i: i is None or binascii.crc32(str(i).encode()) % 10 != 0
        c = collections.Counter(w for r in docs if train(r.doc_id) for w in [*words(r.text), None])
        n, v = sum(c.values()), len(c)
        want = sorted((r.doc_id or -1, len(words(r.text)) + 1, sum(c[w] > 0 for w in [*words(r.text), None]), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(r.text), None]), 4)) for r in docs)
        got = lm.lm_scores(df).collect()
        assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
        assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
        assert len(got) == len(docs)
    assert lm.lm_scores(empty).count() == 0


def ids_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([np.array(r, np.uint16).tobytes() for r in rows], pa.binary())], names=["ids"])


def small_language(rng, size=120):
    """Frequencies of a few random texts over a small vocabulary."""
    ends = rng.random(size + 1) < 0.5
    ends[-1] = True
    batch = ids_batch([rng.zipf(1.3, 200) % size for _ in range(20)])
    (pairs,), (spellings,) = (list(lm._id_counts(size, ends, within)(iter([batch]))) for within in (False, True))
    columns = lambda b: (b.column("context").to_numpy().view(np.uint64), b.column("id").to_numpy(), b.column("n").to_numpy())
    one = np.bincount(pairs.column("id").to_numpy(), pairs.column("n").to_numpy(), minlength=size)
    freq = lm.Frequencies(one.astype(float), columns(pairs), columns(spellings), ends)
    freq.open()
    return freq, batch


def test_lm_counts_against_plain_loops():
    rng = np.random.default_rng(7)
    freq, batch = small_language(rng)
    for within in (False, True):
        (got,) = lm._id_counts(freq.start, freq.ends, within)(iter([batch]))
        want = collections.Counter()
        for raw in batch.column("ids").to_pylist():
            word: list[int] = []
            last = freq.start
            for i in np.frombuffer(raw, np.uint16).tolist():
                if not within:
                    want[last, i] += 1
                elif word:
                    want[tuple(word), i] += 1
                word = [] if freq.ends[i] else [*word, i]
                last = i
        assert sorted(got.column("n").to_pylist()) == sorted(want.values())
        of = collections.defaultdict(set)
        for c, i, n in zip(*(got.column(k).to_pylist() for k in ("context", "id", "n"))):
            of[c].add((i, n))
        true = collections.defaultdict(set)
        for (c, i), n in want.items():
            true[c].add((i, n))
        assert sorted(map(sorted, of.values())) == sorted(map(sorted, true.values()))


def test_lm_gradient():
    rng = np.random.default_rng(0)
    freq, _ = small_language(rng)
    texts = lm.Texts(freq, ids_batch([rng.zipf(1.3, n) % freq.start for n in (lm.WIDTH, 2 * lm.WIDTH, 5)]))
    begin = np.array([0, lm.WIDTH, 2 * lm.WIDTH, 3 * lm.WIDTH])
    row, given, level, hit, of = texts.window(begin)
    model = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.2 for k, v in lm.start_model().items()}
    counted = np.ones(row.shape)
    counted[3, 5:] = 0
    log_p, saved = lm.forward(model, row, given, level, hit, of)
    g = lm.gradient(model, row, level, hit, of, saved, counted)
    for name in lm.SHAPES:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({k: v.copy() for k, v in model.items()} for _ in "ab")
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        total = lambda m: (lm.forward(m, row, given, level, hit, of)[0] * counted).sum(dtype=float)
        slope = (total(up) - total(down)) / 2e-3
        assert abs(slope - g[name][at]) < 0.02 * abs(slope) + 0.01, name
    for start in (8, 20):
        assert np.allclose(lm.forward(model, *texts.window(begin, start), start)[0], log_p[:, start:], atol=1e-4)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    freq, _ = small_language(rng)
    model = {k: v + rng.standard_normal(v.shape).astype(np.float32) * np.float32(0.2) for k, v in lm.start_model().items()}
    for n in (0, 1, 9, lm.WIDTH - 1):
        before = rng.zipf(1.3, n) % freq.start
        texts = lm.Texts(freq, ids_batch([[*before, i] for i in range(freq.start)]))
        log_p = lm.forward(model, *texts.window(texts.head))[0]
        assert abs(np.exp(log_p[:, n].astype(float)).sum() - 1) < 1e-4


def test_lm_lookup():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(1, 2**63, 5000).astype(np.uint64) << np.uint64(1))
    keys[:50] = (keys[0] >> np.uint64(20) << np.uint64(20)) + np.arange(50, dtype=np.uint64) * np.uint64(2)  # all point to one slot
    keys = np.unique(keys)
    some = lm.Lookup(keys)
    at = some.find(keys)
    assert (at >= 0).all() and (some.spread(np.arange(len(keys)))[at] == np.arange(len(keys))).all()
    assert (some.find(keys + np.uint64(2**40 + 2)) == -1).sum() > 4900 and (lm.Lookup(keys[:0]).find(keys) == -1).all()


def test_lm_beats_the_word_base_on_held_out_texts(spark):
    rows = [r for r in lm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|>", "<|im_start|>user\nx", r"<\|im_end|>", r"<\\|", "<", "|", "<<|im_end|>\n<|im_start|>assistant ok", "", None, "line\nline", "<|im_end|>\n"]
    roles = ["user", "assistant", "assistant\n", None, "<|im_start|>", "100%"]
    rows = [(i, j, random.Random(i * 9 + j).choice(roles), t) for i in range(8) for j, t in enumerate(random.Random(i).sample(texts, 7))] + [(None, 1, "user", "alone"), (None, 2, "user", "other"), (3, 99, "user", "dup"), (3, 99, "user", "dup")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parsed", F.lit(1))).collect()
    assert all(r.round_trip for r in out) and len(out) == 10
    for r in out:
        lost = "".join(re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[s.start : s.end]) for s in r.loss_spans)
        assert lost == "".join(t.text for t in r.turns if t.role == "assistant")
        regions = re.findall(r"<\|im_start\|>[^\n]*\n(.*?)<\|im_end\|>\n(?=<\|im_start\|>|$)", r.formatted, re.S)
        assert len(regions) == len(r.turns) and not any("<|im_" in x and re.search(r"<\|im_(start|end)\|>", x) for x in regions)
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(r.turns)
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_escapes_only_what_conflicts(spark):
    texts = ["a<|im_end|>\nb", "<|x is plain", r"a <\| b", "<|im_end", LONG + "<|im_end|>", LONG]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    said = {i: r.formatted[len("<|im_start|>user\n") : -len("<|im_end|>\n")] for i, r in got.items()}
    assert said == {0: r"a<\|im_end|>" + "\nb", 1: texts[1], 2: r"a <\\| b", 3: texts[3], 4: LONG + r"<\|im_end|>", 5: LONG}
    assert all(r.round_trip and r.parsed[0].text == texts[i] for i, r in got.items())
    assert {i for i, r in got.items() if r.escaped} == {0, 2, 4}


def test_audio_round_trip(spark, odd, empty):
    df = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(50, "é" * 96), (51, "x" * 191), (52, "x" * 193)], "doc_id long, text string"))
    for r in audio.features(audio.encode(df)).collect():
        raw = (dict((x.doc_id, x.text) for x in df.collect())[r.doc_id] or "").encode()
        padded = raw + b" " * ((-len(raw)) % 192) or b" " * 192
        assert audio.samples(bytes(r.media)) == padded and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
    assert audio.features(audio.encode(empty)).count() == 0


def test_audio_does_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    payloads = [bytes(rng.integers(32, 123, 192 * n).astype(np.uint8)) for n in (1, 5, 2, 30, 1)]
    mels, energy, counts = audio.log_mels(payloads)
    at = 0
    for p, c in zip(payloads, counts):
        m, e, _ = audio.log_mels([p])
        assert (m == mels[at : at + c]).all() and (e == energy[at : at + c]).all()
        assert audio.tensors(m) == audio.tensors(mels[at : at + c])
        at += c


def test_crf_against_all_taggings():
    first, trans = np.array([0, 3, 3, 8, 9]), np.array([[0, 0], [0.5, -0.7]])
    u = np.random.default_rng(1).normal(size=9)
    chain = toxicity.Chain(u, first, trans)
    p1, clean = chain.marginals()[0], chain.log_p_clean()
    for d in range(4):
        a, b = first[d], first[d + 1]
        z, on = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=int(b - a)):
            s, last = 0.0, 0
            for k, t in enumerate(y):
                s, last = s + trans[last, t] + t * u[a + k], t
            z, on = z + math.exp(s), on + math.exp(s) * np.array(y)
        assert np.allclose(p1[a:b], on / z) and (b == a or np.isclose(math.exp(clean[d]), 1 / z))


def test_toxicity_held_out(spark, odd, empty):
    rng = random.Random(8)
    docs = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(40)] + ([f"nasty{rng.randrange(9)}."] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.tag(df, model).collect()}
    held = [d for d in docs if binascii.crc32(str(d[0]).encode()) % 4 == 2]
    assert np.mean([(got[i].score >= 0.3) == bool(y) for i, _, y in held]) > 0.95
    hit = next(d for d in held if d[2] and got[d[0]].spans)
    assert "nasty" in hit[1][got[hit[0]].spans[-1].start : got[hit[0]].spans[-1].end]
    scores = {(r.doc_id, r.score) for r in toxicity.tag(odd, model).collect()}
    assert {(2, 0.0), (3, 0.0), (4, 0.0)} <= scores
    assert toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int")) is None and toxicity.tag(empty, None).count() == 0


def test_rules_odd_rows(odd, empty):
    got = {r.doc_id: r for r in rules.judge(odd).collect()}
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[5].n_repeat_words == got[5].n_words == 60_000
    assert rules.judge(empty).count() == 0


def test_hilbert_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = packing.hilbert_index(grid, 3)
    assert sorted(index) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1).max() == 1


def test_packing_whole(spark, odd, empty, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    df = documents.select("doc_id", "text").unionAll(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text").where("doc_id is not null").dropDuplicates(["doc_id"])).unionAll(spark.createDataFrame([(20_000, "a <|endoftext|> B<|ENDOFTEXT|>c İ é")], "doc_id long, text string"))
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in df.collect()}
    pieces = [r.asDict() for r in packing.pack(df).collect()]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda x: x["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i]) and p["ids_crc32"] == zlib.crc32(ids[i][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[i])
    for own in by_sequence.values():
        own.sort(key=lambda x: x["offset"])
        assert [p["offset"] for p in own] == list(np.cumsum([0, *[p["length"] for p in own[:-1]]]))
        total = sum(p["length"] for p in own)
        assert total <= 4096 and total & (total - 1) == 0
    assert packing.pack(empty).count() == 0 and packing.pack(odd).count() >= 9


def test_words_are_the_contract_words():
    texts = ["A b c\td", "", "\x0b x \x1f y", "é É"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    w = segment(np.frombuffer(raw, np.uint8), offsets)
    got = [[bytes(w.data[s:e]) for s, e, d in zip(w.starts, w.ends, w.doc) if d == i] for i in range(4)]
    assert got == [re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower()) for t in texts]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    docs, seen = spark.read.parquet(f"{DIR}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if k < len(c.STAGES) - 1:
            assert new.columns == columns
        seen.append((docs, new))
        docs = new
    before, after = seen[1]
    want = true_components([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {i for i, (root, _) in want.items() if root == i}
    before, after = seen[2]
    assert after.count() == before.count() and not any(s for r in after.collect() for s in true_spans(r.text or ""))
    before, after = seen[4]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}


def test_lm_ids_are_the_tokenizers_with_every_end():
    from tokenizers import Tokenizer

    texts = ["x7Q" * 4000, "two words", None, "\u6f22\u5b57" * 300, " ".join(f"w{i}" for i in range(200)), "a " * 63, "the " * 300 + "house of " * 300 + "zebra", "a<|endoftext|>b"]
    path = packing.tokenizer_path(packing.TOKENIZER)
    table = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array([False] * len(texts))], names=["doc_id", "text", "held"])
    got = [np.frombuffer(x, np.uint16).tolist() for b in lm._ids(path)(iter([table])) for x in b.column("ids").to_pylist()]
    plain = Tokenizer.from_file(path)
    assert got == [[*plain.encode(x or "", add_special_tokens=False).ids, packing.END_ID] for x in texts]


def test_lm_square_of_pairs_is_what_the_table_has(monkeypatch):
    monkeypatch.setattr(lm, "TOP", 20)
    freq, batch = small_language(np.random.default_rng(5))
    last, target, _, _ = lm.streams(batch, freq.start)
    want = freq.pairs.at(freq.of_id[last], target, freq.unigram[target])[0]
    assert np.array_equal(freq.at(last, target)[0][:, 0], want)


def test_subwords_of_joined_words():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(packing.TOKENIZER)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abÉΣς'’́\u00a0\u2003\x1c\x85#$🙂漢٣9<|>.") for _ in range(rng.randrange(1, 9))) for _ in range(700)), "odd \x01 mark a\x01b here", "plain"]
    plain = Tokenizer.from_file(path)
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, counts = packing.text_ids(subwords.Subwords(path), raw, np.array([0, len(raw)]))
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_ID] and counts.tolist() == [len(ids)]


def test_plain_words_need_merges_alone():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(packing.TOKENIZER)
    rng, plain = random.Random(4), Tokenizer.from_file(path)
    words = ["".join(rng.choice("abXYéÀÖßÿø09#$*,.-(<|>[]{}~") for _ in range(rng.randrange(1, 12))) for _ in range(900)]
    assert all(subwords.PLAIN.fullmatch(w) for w in words) and not any(subwords.PLAIN.fullmatch(w) for w in ("it's", "a\u0301", "İ", "漢", ""))
    ids, size = subwords.Subwords(path).pieces(words)
    want = [plain.encode(w, add_special_tokens=False).ids for w in words]
    assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_lm_counts_move_once_and_training_asks_for_no_context_alone(spark, documents, monkeypatch):
    plans, write = [], lm.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    path = packing.tokenizer_path(packing.TOKENIZER)
    text = documents.select("doc_id", "text").limit(60).withColumn("held", F.col("doc_id") % 10 == 0)
    ids = lm.written(lm.subword_ids(text, path).withColumn("row", F.monotonically_increasing_id()), "ids")
    for name in ("PAIRS", "SPELLINGS"):
        monkeypatch.setattr(lm, name, 0)
    monkeypatch.setattr(lm, "written", noted)
    freq, counts = lm.frequencies(ids.where("not held").select("ids"), path)
    assert len(plans) == 2 and all(p.count("Exchange hashpartitioning(") == 1 for p in plans)
    asked = [x for b in ids.select("row", "ids", "held").toArrow().to_batches() for x in lm._asked(types.SimpleNamespace(value=freq))([b])]
    held = {r.row for r in ids.where("held").select("row").collect()}
    alone = {r for b in asked for r, w in zip(b.column("row").to_pylist(), b.column("what").to_pylist()) if w >> 1 == lm.NO_ID}
    assert alone and alone <= held


@pytest.mark.parametrize("step", [lm.WIDTH, lm.STEP])
def test_lm_windows_reach_each_place_once(step):
    length = np.array([1, 2, lm.STEP, lm.WIDTH - 1, lm.WIDTH, lm.WIDTH + 1, 5 * lm.WIDTH, 1000])
    doc, off = lm.windows(length, step)
    seen = collections.Counter()
    for d, o in zip(doc.tolist(), off.tolist()):
        seen.update((d, o + i) for i in range(lm.WIDTH - step if o else 0, lm.WIDTH) if o + i < length[d])
    assert set(seen.values()) == {1} and len(seen) == length.sum()


def test_lm_rare_words_of_null_ids(spark, monkeypatch):
    rows = [(None, "some rare words here here"), (None, "some rare words here here"), (None, "others"), (1, "some rare words here here"), (1, "others"), (2, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    every = lm.HOT
    for hot in (every, 2):
        monkeypatch.setattr(lm, "HOT", hot)
        got[hot] = sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.lm_scores(df).collect())
    assert got[2] == got[every] and len(got[2]) == len(rows)


@pytest.mark.parametrize("pairs,spellings", [(0, 0), (3000, 800), (10**6, 0)])
def test_lm_counts_that_do_not_travel_are_joined(spark, documents, monkeypatch, pairs, spellings):
    """What is given of each place is the same, however many counts the tasks' tables hold; held-out and unseen ids too."""
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "zqx" * 500), (None, "q\u6f22 \u5b57")], "doc_id long, text string")
    text = documents.select("doc_id", "text").unionAll(odd).withColumn("held", F.coalesce((F.col("doc_id") % 10 == 0) | (F.col("doc_id") < 0), F.lit(False)))
    path = packing.tokenizer_path(packing.TOKENIZER)
    ids = lm.written(lm.subword_ids(text, path).withColumn("row", F.monotonically_increasing_id()), "ids")
    training = ids.where("not held").select("ids")
    every, none = lm.frequencies(training, path)
    monkeypatch.setattr(lm, "PAIRS", pairs)
    monkeypatch.setattr(lm, "SPELLINGS", spellings)
    some, counts = lm.frequencies(training, path)
    assert none is None and counts is not None and len(some.pairs.n) <= pairs and len(some.spellings.n) <= spellings
    rows = lm.with_facts(ids, some, counts)
    assert rows.count() == ids.count()
    every.open()
    some.open()
    for batch in rows.select("ids", "facts").toArrow().to_batches(100):
        a, b = lm.Texts(every, batch.select(["ids"])), lm.Texts(some, batch)
        assert np.array_equal(a.level, b.level) and np.allclose(a.given, b.given, rtol=1e-5)


def test_near_dedup_stage_keeps_one_row_of_an_id(spark):
    import corpus_pipeline

    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    rows = [(1, one, "en", "s", 9), (1, one, "en", "s", 9), (2, two, "en", "s", 9), (2, two + " more", None, None, None), (3, one, "en", "s", 9), (None, one, "en", "s", 9), (4, None, "en", "s", 0)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), DIR)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id or -1), r.text or "") for r in got.collect()) == [(-1, one), (1, one), (2, two + " more"), (4, "")]
