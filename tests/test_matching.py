"""Pairing of large keys against the shortest-path solution of one task."""

import random

import numpy as np
import pytest

from tablewright.operators import score
from tablewright.operators.matching import best_pairs


def sides(seed, rows, columns, values, keys=1):
    rng = random.Random(seed)
    draw = lambda: [(k, *(rng.choice("abcdefghijklmnopqrstuvwxyz"[:v]) for v in values[:columns]), rng.choice((1, 1, 1, 2, 5))) for k in range(keys) for _ in range(rng.randrange(rows // 2, rows))]
    fold = lambda x: [(*r, n) for r, n in {r[:-1]: sum(q[-1] for q in x if q[:-1] == r[:-1]) for r in x}.items()]
    return fold(draw()), fold(draw())


def transported(g, r):
    """(pairs, equal cells) of all keys by transport()."""
    pairs = total = 0
    for k in {x[0] for x in g} & {x[0] for x in r}:
        a, b = [x for x in g if x[0] == k], [x for x in r if x[0] == k]
        w = np.array([[sum(p == q for p, q in zip(x[1:-1], y[1:-1])) for y in b] for x in a])
        flow = score.transport(w, np.array([x[-1] for x in a]), np.array([y[-1] for y in b]))
        pairs, total = pairs + flow.sum(), total + (flow * w).sum()
    return pairs, total


@pytest.mark.parametrize("seed,rows,columns,values,keys", [(2, 24, 2, (2, 9), 1), (4, 12, 3, (2, 2, 3), 2)])
def test_total_is_that_of_one_task(spark, seed, rows, columns, values, keys):
    g, r = sides(seed, rows, columns, values, keys)
    names = [f"c{i}" for i in range(columns)]
    schema = ", ".join(["k int", *(f"{c} string" for c in names), "n long"])
    found = {x.column: x.n for x in best_pairs(spark.createDataFrame(g, schema), spark.createDataFrame(r, schema), ["k"], ["k", *names], "n").collect()}
    pairs, total = transported(g, r)
    assert found["k"] == pairs and sum(found[c] for c in names) == total


def test_nothing_in_common_and_key_columns_alone(spark):
    g = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "k int, x string, n long")
    r = spark.createDataFrame([(1, "c", 1), (2, "a", 9)], "k int, x string, n long")
    assert {x.column: x.n for x in best_pairs(g, r, ["k"], ["k", "x"], "n").collect()} == {"k": 1, "x": 0}
    assert {x.column: x.n for x in best_pairs(g, r, ["k"], ["k"], "n").collect()} == {"k": 1}


def test_cells_of_a_large_key(spark, monkeypatch):
    """A key beyond a task's pairs gives the same total as within one."""
    g, r = sides(9, 20, 2, (9, 26), 1)
    names = ["k", "c0", "c1"]
    a = spark.createDataFrame([x[:-1] for x in g for _ in range(x[-1])], "k int, c0 string, c1 string")
    b = spark.createDataFrame([x[:-1] for x in r for _ in range(x[-1])], "k int, c0 string, c1 string")
    within = {x.column: x.matched for x in score.cells(a, b, ["k"], names).collect()}
    monkeypatch.setattr(score, "TASK_PAIRS", 100)
    beyond = {x.column: x.matched for x in score.cells(a, b, ["k"], names).collect()}
    assert sum(within.values()) == sum(beyond.values()) and within["k"] == beyond["k"]


def test_scores_of_tables_that_cannot_be_aligned(spark):
    """Without a key, or with a key column missing on a side, the schema scores and rows are counted on both sides."""
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "stay_id int, x string")
    other = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    for keys, result, schema in ((["stay_id"], other, 0.666667), ([], gold, 1.0)):
        row = score.file_score(gold, result, keys).first()
        assert (row.schema_f1, row.key_f1, row.cell_f1, row.exact_f1, row.score) == (schema, 0, 0, 0, round(0.1 * schema, 6))
        assert (row.gold_rows, row.result_rows) == (2, result.count())
        columns = {x.column: x for x in score.column_scores(gold, result, keys).collect()}
        assert all(x.matched == 0 and x.column_f1 == 0 and x.gold_cells == 2 and x.result_cells == result.count() for x in columns.values())
    none = score.column_scores(gold, spark.createDataFrame([(1,)], "z int"), ["stay_id"]).collect()
    assert all(x.status == "missing_column" and x.matched == 0 and x.result_cells == 1 for x in none)
