"""Spelling variants against all pairs of words."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import queries, spelling

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def edited(a, b):
    """Whether one edit of a code point makes b of a."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def counts(docs):
    found = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def expected(n, pairs):
    near = collections.defaultdict(set)
    for a, b in pairs:
        if edited(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top and n[top] >= 10 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    n = counts(docs)
    by = collections.defaultdict(list)
    for w in sorted(n):
        by[len(w)].append(w)
    pairs = itertools.chain.from_iterable(itertools.chain(itertools.combinations(v, 2), itertools.product(v, by.get(k + 1, []))) for k, v in sorted(by.items()))
    found = queries.queries()["op11_spelling"](spark, DIR)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(found) == expected(n, pairs)


@pytest.mark.parametrize("letters", ["ab", "aé", "abcdefgh"])
def test_words_of_few_letters(spark, letters):
    """Bigrams that repeat within words and tie between them."""
    rng = random.Random(letters)
    n = {}
    for _ in range(120):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 11)))
        for _ in range(6):
            n.setdefault(w, rng.choice([2, 3, 25, 400]))
            k, kind = rng.randrange(len(w)), rng.randrange(3)
            w = w[:k] + (rng.choice(letters) if kind else "") + w[k + (kind != 1) :]
            w = w if len(w) >= 7 else w + letters[0] * 7
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(spelling.variants(words)) == expected(n, itertools.combinations(n, 2))


def test_long_words_and_chains(spark):
    long = "ab" * 4000
    n = {long: 2, long + "a": 30, "aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "z" * 3000: 4, "z" * 3001: 3}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    rows = {r.word: r for r in spelling.variants(words).collect()}
    assert rows["aaaaaaa"].root == "aaabbbb" and rows["aaaaaaa"].form == "aaaaaab"
    assert rows[long].form == long + "a" and rows["z" * 3000].form is None and rows["z" * 3000].n_near == 1


def test_odd_rows(spark):
    rows = [(1, "Letters LETTERS letters", "x"), (2, None, "x"), (3, "", None), (None, "lettérs lettérs", "x"), (4, "short words only", "x"), (4, "letters " * 50_000, "x"), (4, "letters " * 50_000, "x"), (5, "q" * 9000 + " " + "q" * 9000, None)]
    docs = spark.createDataFrame(rows, DOCS)
    docs = docs.withColumns({c: F.lit("y") for c in ("word", "n", "key", "h", "d", "run", "form", "last", "to")})
    n = counts([r[:2] for r in rows])
    assert got(spelling.variants(spelling.counted(docs))) == expected(n, itertools.combinations(n, 2))
    assert spelling.variants(spelling.counted(docs.limit(0))).count() == 0


def test_pivots_are_disjoint_and_cheapest():
    rng = np.random.default_rng(3)
    places = np.sort(np.array([rng.choice(12, 5, replace=False) for _ in range(200)]), axis=1)
    weights = rng.integers(1, 50, places.shape)
    for wanted in (2, 3):
        usable = [i for i, p in enumerate(places) if any(all(b - a >= 2 for a, b in zip(c, c[1:])) for c in itertools.combinations(p, wanted))]
        picked = spelling.choose(places[usable], weights[usable], wanted)
        for p, w, k in zip(places[usable], weights[usable], picked):
            costs = {c: w[list(c)].sum() for c in itertools.combinations(range(5), wanted) if all(p[b] - p[a] >= 2 for a, b in zip(c, c[1:]))}
            assert costs[tuple(k)] == min(costs.values())
