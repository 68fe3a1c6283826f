"""Operators on small hand-made tables: acceptance numbers, edges and properties."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.cells import f1, format_pattern, normal_cell, safe_name
from tablewright.operators import cohort, constraints, delta, events, features, gates, inject, profile, repair, score, splits
from tablewright.plans import gates_queries
from tablewright.sources import packages


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(df):
    return df.first().asDict()


def test_normal_cell_edges(spark):
    values = ["1200.000", "0.5000", " -0 ", "-0.0000001", "NaN", None, "null", "1 days 02:30:00", "-1 days 23:00:00", "A  b C", "1_000", "1e3", "0.00000050"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(normal_cell(F.col("v"))).collect()]
    assert got == ["1200", "0.5", "0", "0", "", "", "", "26.5", "-1", "a b c", "1_000", "1000", "0.000001"]


def test_patterns_and_names(spark):
    df = spark.createDataFrame([("Ab-12 _x", " a-b  c! ")], "p string, n string")
    assert tuple(df.select(format_pattern(F.col("p")), safe_name(F.col("n")), safe_name(F.lit("--"))).first()) == ("Aa-9_a", "A_B_C", "UNK")


def test_constraints_edges(spark):
    df = spark.createDataFrame([(1, "a", "5", None), (1, "a", "x", "2"), (2, " ", "", "1"), (None, "b\n", "9", "3")], "id int, g string, v string, w string")
    flag = lambda c: [r[0] for r in df.select(c).collect()]
    assert flag(constraints.not_null(["g"])) == [False, False, True, False]
    assert flag(constraints.in_range("v", 0, 6)) == [False, True, False, True]
    assert flag(constraints.full_match("g", "[ab]")) == [False, False, False, True]
    assert {(r.id, r.violates) for r in constraints.unique(df, ["id"]).collect()} == {(1, True), (2, False), (None, False)}
    with pytest.raises(ValueError):
        constraints.report(df, [{"name": "x", "type": "nonsense"}])


def test_group_limit(spark):
    df = spark.range(30).select(F.col("id"), F.col("id").alias("v"))
    with pytest.raises(ValueError):
        profile.profile_by_group(df, ["id"], ["v"], 10)


def test_readmission_order_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, 1, "2020-01-01 00:00:00", "2020-01-02 00:00:00"), (2, 1, "2020-01-20 00:00:00", "2020-01-21 00:00:00"), (3, 1, "2020-06-01 00:00:00", None), (4, None, "2020-06-01 00:00:00", "2020-06-02 00:00:00")],
        "stay_id int, subject_id int, intime string, outtime string",
    ).selectExpr("stay_id", "subject_id", "timestamp(intime) intime", "timestamp(outtime) outtime")
    assert rows(cohort.label_readmission(df, "stay_id").select("stay_id", "label")) == [(1, 1), (2, 0), (3, 0), (4, 0)]


def test_delta_fixture(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id int, value string, other int")
    b = spark.createDataFrame([(2, "z", 2), (3, "w", 3)], "id int, value string, other int")
    assert one(delta.keyed(a, b, ["id"])) == {"inserted_rows": 1, "deleted_rows": 1, "changed_rows": 1, "changed_cells": 1}
    assert one(delta.keyed(a, a.orderBy(F.desc("id")), ["id"]))["changed_cells"] == 0
    assert rows(delta.examples(a, b, ["id"])) == [(2, "value", "y", "z")]


def test_score_acceptance_numbers(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "stay_id int, value string")
    wrong = spark.createDataFrame([(2, "B "), (1, "c")], "stay_id int, value string")
    s = one(score.file_score(gold, wrong, ["stay_id"]))
    assert (s["cell_f1"], s["exact_f1"], s["key_f1"], s["score"]) == (0.75, 0.5, 1.0, 0.75)
    assert one(score.file_score(gold, gold, ["stay_id"]))["score"] == 1.0
    assert one(score.file_score(gold, gold.select("value"), ["stay_id"]))["key_f1"] == 0.0
    files = score.package_files({"cohort/c": gold, "csv/l": gold, **{f"features/f{i}": gold for i in range(5)}, **{f"summary/s{i}": gold for i in range(10)}}, {"cohort/c": wrong, "csv/l": gold, **{f"features/f{i}": gold for i in range(5)}, **{f"summary/s{i}": gold for i in range(10)}}, {p: ["stay_id"] for p in ["cohort/c", "csv/l", *[f"features/f{i}" for i in range(5)], *[f"summary/s{i}" for i in range(10)]]}, unique=True)
    assert {r.part: r.score for r in score.balanced(files).collect()}["package"] == 0.9625


def test_score_duplicate_keys(spark):
    gold = spark.createDataFrame([(301, "A01", "alpha"), (301, "B02", "beta")], "stay_id int, code string, value string")
    result = spark.createDataFrame([(301, "B02", "beta"), (301, "A01", "wrong")], "stay_id int, code string, value string")
    assert dict(rows(score.cells(gold, result, ["stay_id"], ["code", "value"]))) == {"code": 2, "value": 1}
    assert one(score.exact_rows(gold, result, ["stay_id", "code", "value"]))["matched"] == 1


def test_assignment_against_all_pairings():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = map(int, rng.integers(1, 5, 2))
        w = rng.integers(0, 4, (n, m))
        pairs = score.assignment(w)
        k = min(n, m)
        best = max(sum(w[i, j] for i, j in zip(a, b)) for a in itertools.permutations(range(n), k) for b in itertools.combinations(range(m), k)) if n * m else 0
        best = max(best, max(sum(w[i, j] for i, j in zip(a, b)) for a in itertools.combinations(range(n), k) for b in itertools.permutations(range(m), k)))
        assert len(pairs) == k == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert sum(w[i, j] for i, j in pairs) == best


def test_scores_do_not_depend_on_row_order(spark):
    random.seed(1)
    data = [(i % 7, random.choice("abc"), random.choice("xy")) for i in range(60)]
    result = [(k, v if random.random() < 0.8 else "q", w) for k, v, w in data]
    df = lambda x: spark.createDataFrame(x, "k int, v string, w string")
    first = one(score.file_score(df(data), df(result), ["k"]))
    random.shuffle(result)
    assert one(score.file_score(df(data), df(result), ["k"])) == first


def test_f1_of_empty_sides(spark):
    assert spark.range(1).select(f1(F.lit(0), F.lit(0), F.lit(0))).first()[0] == 1.0


def test_split_small_strata(spark):
    df = spark.createDataFrame([(i, "big") for i in range(10)] + [(100, "two"), (101, "two"), (200, "one")], "id int, s string")
    got = {}
    for r in splits.by_ratio(df, "id", 0.7, 0.1, "x", "s").collect():
        got.setdefault("big" if r.id < 100 else "two" if r.id < 200 else "one", []).append(r.split)
    assert sorted(got["two"]) == ["train", "validation"] and got["one"] == ["train"]
    assert sorted(got["big"]) == ["test"] * 2 + ["train"] * 7 + ["validation"]


def test_nested_prefix_grows(spark):
    keys = spark.range(50).withColumnRenamed("id", "k")
    small = {r.k for r in splits.nested_prefix(keys, "k", 10, "s").collect()}
    assert small <= {r.k for r in splits.nested_prefix(keys, "k", 20, "s").collect()} and len(small) == 10


def test_coverage_select_covers_all(spark):
    data = [(k, f"c{k % 2}", f"s{(k * 3 + j) % 6}") for k in range(12) for j in range(1 + k % 3)]
    got = splits.coverage_select(spark.createDataFrame(data, "k long, error_class string, error_subtype string"), "k", 4, "s").collect()
    chosen = {r.k for r in got}
    assert len({s for k, _, s in data if k in chosen}) == 6


def test_pivot_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "A-B"), (2, "c")], "k int, v string")
    f = features.top_flags(df, "k", "v", "f_", 3)
    assert f.columns == ["k", "f_A_B", "f_A_B_2", "f_C"] and rows(f) == [(1, 1, 1, 0), (2, 0, 0, 1)]


def test_promotion_nulls_the_rest(spark):
    df = spark.createDataFrame([("1", "x")] * 4 + [("n/a", "1")], "a string, b string")
    assert rows(features.promote(df, []))[0][0] in (1.0, None) and dict(features.promote(df, []).dtypes) == {"a": "double", "b": "string"}


def test_repair_fixture(spark):
    t = "stay_id int, value string"
    clean, dirty = spark.createDataFrame([(1, "a"), (2, "b")], t), spark.createDataFrame([(1, "x"), (2, "b"), (9, "new")], t)
    h = lambda a, b: spark.createDataFrame([(a, b)], t).select(repair.row_hash(["stay_id", "value"])).first()[0]
    log = spark.createDataFrame([("t", h(1, "a"), h(1, "x")), ("t", None, h(9, "new"))], "path string, clean_hash string, dirty_hash string")
    result = spark.createDataFrame([(1, "a"), (3, "odd")], t)
    m = repair.multiset({"t": clean}, {"t": dirty}, {"t": result})
    got, kept = one(repair.metrics(repair.status(log, m))), one(repair.preservation(m, log))
    assert (got["exact"], got["recall"], got["inserted_deletion_rate"]) == (2, 1.0, 1.0)
    assert (kept["collateral"], kept["preservation_rate"]) == (2, 0.0)
    same = repair.multiset({"t": clean}, {"t": dirty}, {"t": dirty})
    assert one(repair.metrics(repair.status(log, same)))["missed"] == 2


def test_inject_then_undo(spark):
    stays = spark.createDataFrame([(13, 1, 5, "2100-01-01 00:00:00", "2100-01-05 00:00:00"), (23, 2, 6, "2100-02-01 00:00:00", "2100-02-05 00:00:00")], "stay_id long, hadm_id long, subject_id long, intime string, outtime string")
    chart = spark.createDataFrame([(1, "13", "7", "x"), (2, "13", "8", "3"), (3, "23", "7", "5")], "_row_index long, stay_id string, itemid string, valuenum string")
    req = spark.createDataFrame([(1, 13, "c", "sentinel_chart_value"), (2, 13, "c", "unit_scale_error"), (3, 23, "c", "duplicate_row"), (4, 99, "c", "duplicate_row")], "source_error_id long, canonical_stay_id long, error_class string, error_subtype string")
    dirty, log = inject.inject("chartevents", chart, stays, req)
    assert rows(dirty) == [(1, "13", "7", "-99900.0"), (2, "13", "8", "3"), (3, "23", "7", "5"), (3, "23", "7", "5")]
    assert sorted((r.source_error_id, r.clean_value, r.dirty_value) for r in log.collect()) == [(1, "x", "-999"), (2, "-999", "-99900.0"), (3, None, None)]
    assert [r.source_error_id for r in inject.unresolved(req, log).collect()] == [4]


def test_empty_tables_do_not_fail(spark):
    df = spark.createDataFrame([], "k int, v string")
    assert one(score.file_score(df, df, ["k"]))["score"] == 1.0
    assert one(delta.multiset(df, df)) == {"inserted_rows": 0, "deleted_rows": 0}
    assert splits.by_ratio(df, "k", 0.7, 0.1, "s").count() == 0
    assert one(profile.profile_table(df))["n_rows"] == 0


def test_coverage_select_takes_all_of_lineitem(spark):
    d = "/root/testdata/sf0.001"
    assert gates_queries.errors(spark, d).count() == spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert rows(gates_queries.coverage_select(spark, d)) == rows(splits.coverage_select(gates_queries.errors(spark, d), "stay_id", 8, "s5"))


def test_transport_against_assignment():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n, m = map(int, rng.integers(1, 6, 2))
        w, a, b = rng.integers(0, 4, (n, m)), rng.integers(1, 5, n), rng.integers(1, 5, m)
        flow = score.transport(w, a, b)
        whole = np.repeat(np.repeat(w, a, axis=0), b, axis=1)
        assert (flow >= 0).all() and (flow.sum(axis=1) <= a).all() and (flow.sum(axis=0) <= b).all() and flow.sum() == min(a.sum(), b.sum())
        assert (flow * w).sum() == sum(whole[i, j] for i, j in score.assignment(whole))


def test_score_hot_key_is_paired(spark):
    gold = spark.range(1500).select(F.lit(1).alias("k"), F.concat(F.lit("a"), (F.col("id") % 30).cast("string")).alias("x"), F.concat(F.lit("g"), (F.col("id") % 20).cast("string")).alias("y"))
    result = gold.select("k", "x", F.concat(F.lit("r"), F.col("y")).alias("y"))
    assert dict(rows(score.cells(gold, result, ["k"], ["k", "x", "y"]))) == {"k": 1500, "x": 1500, "y": 0}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_vocabulary_places_do_not_depend_on_the_ranges(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(60_000).select(F.md5((F.col("id") % 40_000).cast("string")).alias("v")).repartition(5)
        out = events.vocabulary(df, "v")
        assert out.agg(F.count_distinct("idx"), F.min("idx"), F.max("idx")).first() == (40_000, 0, 39_999)
        first = out.orderBy("idx").limit(3).collect()
        assert [r.value for r in first] == sorted(r.v for r in df.distinct().collect())[:3]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_one_row_of_a_key_however_rows_are_dealt(spark):
    rows = [(k, f"v{i}", i) for k in range(4) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, v string, n int")
    want = None
    for n in (1, 2, 7):
        got = sorted(tuple(r) for r in features.assemble(df.select("k").distinct(), [df.repartition(n, "n")], "k").collect())
        want = want or got
        assert got == want and len(got) == 4
    nulls = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x", 2)], "k int, v string, n int")
    assert sorted(map(str, features.first_by_digest(nulls, ["k"]).collect())) == sorted(["Row(k=1, v=None, n=None)", "Row(k=None, v='x', n=2)"])


def test_shares_of_nothing_are_whole(spark):
    empty = spark.createDataFrame([], "path string, clean_hash string, dirty_hash string, status string")
    assert repair.metrics(empty).first()[-2:] == (1.0, 1.0)
    updates = spark.createDataFrame([("t", "a", "b", "missed")], empty.schema)
    assert repair.metrics(updates).first()[-2:] == (0.0, 1.0)
    rows = spark.createDataFrame([("t", "a", 1, 0, 0)], "path string, hash string, clean int, dirty int, result int")
    assert repair.preservation(rows, updates).first().preservation_rate == 1.0


def test_inspect_tells_long_values_apart(spark):
    df = spark.createDataFrame([("x" * 600 + str(i),) for i in range(5)], "v string")
    assert profile.inspect(df).first().distinct_values == 5


def test_later_requests_see_what_earlier_ones_left(spark):
    rows = spark.createDataFrame([(i, str(i % 2), "7", "2000-01-01 00:00:00", "5") for i in range(4)], "_row_index long, stay_id string, itemid string, charttime string, valuenum string")
    stays = spark.createDataFrame([(0, 10, 1, "2000-01-01 00:00:00", "2000-01-03 00:00:00"), (1, 11, 2, "2000-01-01 00:00:00", "2000-01-03 00:00:00")], "stay_id long, hadm_id long, subject_id long, intime string, outtime string")
    kinds = ["unit_scale_error", "label_leakage_feature", "unit_scale_error", "duplicate_row", "chart_itemid_alias_split"]
    requests = spark.createDataFrame([(i, 1, "c", k) for i, k in enumerate(kinds)], "source_error_id long, canonical_stay_id long, error_class string, error_subtype string")
    dirty, log = inject.inject("chartevents", rows, stays, requests)
    got = sorted((r.itemid, r.valuenum) for r in dirty.where("_row_index = 1").collect())
    assert got == [("7", "50000.0"), ("990045", "50000.0"), ("999001", "0")] and dirty.count() == 6
    assert [(r.error_subtype, r.clean_value, r.dirty_value) for r in log.orderBy("source_error_id").collect()] == [
        ("unit_scale_error", "5", "500.0"), ("label_leakage_feature", None, None), ("unit_scale_error", "500.0", "50000.0"), ("duplicate_row", None, None), ("chart_itemid_alias_split", "7", "990045"),
    ]


def test_quotas_of_many_strata(spark):
    sizes = spark.createDataFrame([(f"s{i}", 1 + i % 3) for i in range(50)], "_s string, n long")
    got = splits.quotas(sizes, 37).collect()
    assert sum(r.quota for r in got) == 37 and all(0 <= r.quota <= 3 for r in got)
    assert sum(r.quota for r in splits.quotas(sizes, 10_000).collect()) >= 99 and splits.quotas(sizes.limit(0), 5).count() == 0


def test_gate_of_an_empty_and_a_placeholder_table(spark):
    keys = spark.createDataFrame([(1,), (2,)], "stay_id int")
    expected = {p: spark.createDataFrame([], "stay_id int, v string") for p in ("cohort/a", "features/b", "csv/c")}
    result = {"cohort/a": expected["cohort/a"], "features/b": spark.createDataFrame([(1, "TODO"), (3, None)], "stay_id int, v string"), "csv/c": spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "stay_id int, v string")}
    got = {(r.path, r.issue): r["count"] for r in gates.business_gate(expected, result, {p: ["stay_id"] for p in expected}, keys, "stay_id").collect()}
    assert got == {("cohort/a", "empty"): 1, ("cohort/a", "uncovered_keys"): 2, ("features/b", "placeholder_only"): 1, ("features/b", "unknown_keys"): 1, ("csv/c", "duplicate_keys"): 1, ("csv/c", "duplicate_business_keys"): 1}


def test_json_lists_objects_and_rows(spark, tmp_path):
    for name, text in (("list", '[{"a": 1}, {"a": 2}]'), ("rows", '{"rows": [{"a": 1}, {"a": 2}], "n": 2}'), ("one", '{"a": 1}')):
        (tmp_path / name).write_text(text)
        got = [r.a for r in packages.read_json_rows(spark, str(tmp_path / name)).select("a").collect()]
        assert got == ([1] if name == "one" else [1, 2])


def test_roots_optional_tables_and_unreadable_files(spark, tmp_path):
    base = tmp_path / "x" / "mimiciv" / "3.1" / "hosp"
    base.mkdir(parents=True)
    (base / "d.csv").write_text("a,b\n1,2\n")
    root = packages.resolve_root(spark, str(tmp_path / "x"))
    assert root.endswith("x/mimiciv/3.1")
    assert packages.read_optional(spark, root, "hosp/d.csv", ["b", "zz"]).collect()[0].asDict() == {"b": "2"}
    assert packages.read_optional(spark, root, "hosp/none.csv") is None
    import gzip

    (base / "e.csv.gz").write_bytes(gzip.compress(b"a\n7\n"))
    assert packages.read_optional(spark, root, "hosp/e.csv").first().a == "7"
    with pytest.raises(ValueError):
        packages.resolve_root(spark, str(tmp_path))
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    assert packages.read_or_none(spark, str(tmp_path / "bad.parquet")) is None
    gold = {"cohort/a": spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")}
    row = score.package_files(gold, {"cohort/a": None}, {"cohort/a": ["k"]}).first()
    assert (row.status, row.score, row.gold_rows) == ("unreadable", 0.0, 2)


def test_csv_sink_and_discovery(spark, tmp_path):
    root = str(tmp_path / "package")
    packages.write_csv(spark.createDataFrame([(1, 0, 'say "hi", twice')], "stay_id int, label int, note string"), f"{root}/cohort/b.csv")
    packages.write_csv(spark.createDataFrame([(1,)], "stay_id int"), f"{root}/cohort/a.csv", gzip=False)
    packages.write_csv(spark.createDataFrame([(1,)], "stay_id int"), f"{root}/features/f.csv")
    got = {(r.path, r.role, r.is_primary) for r in packages.discover(spark, root, "stay_id", ["label"]).collect()}
    assert got == {("cohort/a.csv", "cohort", False), ("cohort/b.csv", "cohort", True), ("features/f.csv", "feature", False)}
    back = packages.read_strings(spark, f"{root}/cohort/b.csv").first()
    assert back.asDict() == {"stay_id": "1", "label": "0", "note": 'say "hi", twice'}
    with pytest.raises(Exception):
        packages.write_csv(spark.range(1), f"{root}/cohort/a.csv")
    (tmp_path / "package" / "metadata.json").write_text('{"tables": [{"path": "cohort/b.csv", "role": "cohort"}, {"path": "x.csv", "role": "other"}]}')
    assert {(r.path, r.is_primary) for r in packages.discover(spark, root, "stay_id", ["label"]).collect()} == {("cohort/b.csv", True), ("x.csv", False)}


def test_quantiles_against_sorted_lists(spark):
    rng = random.Random(3)
    data = [(g, rng.choice([None, rng.randrange(20) / 2, 3.0])) for g in ("a", "b", None) for _ in range(rng.randrange(30, 80))] + [("one", 5.0), ("none", None)]
    got = {r.g: r.q for r in profile.quantiles(spark.createDataFrame(data, "g string, x double"), ["g"], "x", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    for g in ("a", "b", None, "one"):
        assert np.allclose(got[g], np.quantile([x for k, x in data if k == g and x is not None], [0, 0.25, 0.5, 0.9, 1]))
    assert "none" not in got


def test_multiset_preconditions(spark):
    t = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        repair.multiset({"x": t}, {"y": t}, {"x": t})
    with pytest.raises(ValueError):
        repair.multiset({"x": t}, {"x": t}, {"x": t.withColumnRenamed("a", "b")})
