"""Operators built for large keys, files and packages: bounds, pruning and refusals, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.cells import normal_cell
from tablewright.operators import delta, events, features, inject, profile, score, splits
from tablewright.operators.windows import in_windows
from tablewright.sources import packages


def test_windows_of_one_hot_key_against_every_pair(spark):
    rng = random.Random(2)
    e = [(rng.choice((1, 1, 1, 2, None)), i, rng.choice((None, *range(0, 40_000)))) for i in range(1500)]
    w = [(rng.choice((1, 1, 1, 2, None)), i, a := rng.randrange(40_000), a + rng.choice((-50, 0, 10, 600, 5000))) for i in range(60)]
    at = lambda c: F.timestamp_seconds(F.col(c)).alias(c)
    left = spark.createDataFrame(e, "k int, event int, t long").select("k", "event", at("t"))
    right = spark.createDataFrame(w, "k int, window int, a long, b long").select("k", "window", at("a"), at("b"))
    got = sorted((r.event, r.window) for r in in_windows(left, right, ["k"], "t", "a", "b", 700).collect())
    want = sorted((i, j) for k, i, t in e for q, j, a, b in w if k is not None and k == q and t is not None and a <= t <= b)
    assert got == want and len(want) > 300


def test_one_key_of_a_keyed_sink_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "dynamic")
    df = spark.range(2000).select((F.col("id") % 300).alias("stay_id"), F.col("id").alias("x"))
    packages.write_by_key(df, path, "stay_id", 16)
    one = packages.read_key(spark, path, "stay_id", 7, 16)
    assert sorted(r.x for r in one.collect()) == [x for x in range(2000) if x % 300 == 7]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(stay_id,7)" in plan
    folder = lambda f: f.split("part=")[1].split("/")[0]
    assert len({folder(f) for f in spark.read.parquet(path).inputFiles()}) == 16
    assert len({folder(r[0]) for r in one.select(F.input_file_name()).distinct().collect()}) == 1
    assert spark.read.parquet(path).count() == 2000


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    rows = run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("rest", "rest")
    return rows, found


def test_coverage_jobs_do_not_grow_with_k(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(120), f"c{rng.randrange(3)}", f"s{rng.randrange(7)}") for _ in range(400)]
    df = spark.createDataFrame(rows, "stay_id long, error_class string, error_subtype string").cache()
    few, a = jobs_of(spark, "few", lambda: splits.coverage_select(df, "stay_id", 12, "x").orderBy("place").collect())
    many, b = jobs_of(spark, "many", lambda: splits.coverage_select(df, "stay_id", 90, "x").orderBy("place").collect())
    assert [r.place for r in many] == list(range(1, len(many) + 1)) and many[:12] == few and b <= a + 4
    assert len({r.stay_id for r in many}) == 90
    every = splits.coverage_select(df, "stay_id", 10_000, "x").count()
    assert every == len({r[0] for r in rows})


@pytest.mark.parametrize("n", [0, 1, 1999, 2000, 2001, 4096, 9000])
def test_inspection_counts_exactly_up_to_its_cap(spark, n):
    df = spark.range(n + 50).select(F.when(F.col("id") < n, F.concat(F.lit("value "), F.col("id").cast("string"))).alias("x"))
    row = profile.inspect(df.unionAll(df)).first()
    assert (row.distinct_values, row.capped, row.missing, row.n_rows) == (min(n, 2000), n > 2000, 100, 2 * (n + 50))


def test_inspection_of_an_empty_table_and_its_plan(spark):
    df = spark.range(0).select(F.col("id").cast("string").alias("x"))
    assert tuple(profile.inspect(df).first())[1:] == (0, 0, 0, 0, False)
    plan = profile.inspect(spark.range(10).select("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan.split("Exchange")[1]


def test_sample_rows_do_not_depend_on_the_partitioning(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("b"))
    first = [tuple(r) for r in profile.sample_rows(df.repartition(1), 5).collect()]
    assert first == [tuple(r) for r in profile.sample_rows(df.repartition(9, "b"), 5).collect()] and len(set(first)) == 5


def test_long_lines_are_refused_with_file_and_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n"3,3",4\n5\n')
    df = packages.read_guarded(spark, str(tmp_path / "a.csv"), ["x", "y"])
    assert sorted((r.x, r.y) for r in df.where("_corrupt is null").collect()) == [("1", "2"), ("3,3", "4")] and len(df.where("_corrupt is not null").collect()) == 1
    (tmp_path / "b.csv").write_text("x,y\n" + "1,2\n" * 40 + "1,2,3\n" + "1,2\n" * 9)
    with pytest.raises(ValueError, match=r"b\.csv, line 42: more than 2 cells"):
        packages.read_guarded(spark, str(tmp_path), ["x", "y"])


def test_files_split_unless_a_quoted_cell_has_a_line_end(spark, tmp_path):
    (tmp_path / "one.csv").write_text("x,y\n" + 'a,"b ""c"""\n' * 20_000)
    (tmp_path / "two.csv").write_text('x,y\n1,"two\nlines"\n2,z\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        one, two = (packages.read_strings(spark, str(tmp_path / f"{n}.csv")) for n in ("one", "two"))
        assert one.rdd.getNumPartitions() > 3 and one.count() == 20_000 and one.first().y == 'b "c"'
        assert sorted((r.x, r.y) for r in two.collect()) == [("1", "two\nlines"), ("2", "z")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unresolved_requests_end_the_query(spark):
    requests = spark.createDataFrame([(1,), (2,)], "source_error_id long")
    log = spark.createDataFrame([(1, "a"), (2, "b")], "source_error_id long, column string")
    assert sorted(map(tuple, inject.resolved(requests, log).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="request 2 found no row"):
        inject.resolved(requests, log.where("source_error_id = 1")).collect()


def test_report_of_an_absent_cohort(spark):
    files = spark.createDataFrame([("csv/labels.csv",)], "path string")
    labels = spark.createDataFrame([(1, 0)], "stay_id long, label int")
    rows = {r.name: r for r in events.with_expected(events.validation_report(None, labels, {"chart": labels}, ([], []), {"demo": labels}, files, {"labels_exists": ("csv/", ["labels.csv"], False)}, ("a", "a"))).collect()}
    assert not rows["cohort_adults"].passed and rows["cohort_adults"].details == "absent: cohort"
    assert not rows["labels_keys_and_domain"].passed and not rows["feature_stays_in_cohort"].passed
    assert rows["stay_csv_completeness"].passed and rows["labels_exists"].passed and rows["stay_csv_completeness"].expected == '{"missing":0,"extra":0}'


def test_comparison_of_keys_that_repeat_on_one_side(spark):
    a = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a"), (3, "q")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "a"), (4, "q"), (3, "z"), (3, "q")], "k int, v string")
    row = {r.column: r for r in delta.compare(a, b, ["k"]).collect()}["v"]
    assert (row.compared, row.unequal, row.missing_rows, row.extra_rows) == (3, 0, 1, 2)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_key_filter_lets_all_hits_and_few_others_through(spark, n):
    rows = spark.range(60_000).select((F.col("id") * 7).alias("k"), F.col("id").alias("x"))
    keys = spark.range(n).select((F.col("id") * 21).alias("k"))
    filter_, blocks = features.key_blocks(keys, "k")
    let = {r.k for r in features.probed(rows, "k", filter_, blocks).collect()}
    hits = {21 * i for i in range(n) if 21 * i < 420_000}
    assert hits <= let and len(let - hits) <= 0.03 * 60_000
    assert {r.k for r in features.semi_scan_filtered(rows, keys, "k").collect()} == hits
    plan = features.probed(rows, "k", filter_, blocks)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_key_filter_too_large_to_broadcast_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(features, "MOST_BLOCKS", 1)
    keys = spark.range(10_000).select(F.col("id").alias("k"))
    assert features.key_blocks(keys, "k") is None
    assert features.semi_scan_filtered(spark.range(9_990, 10_020).select(F.col("id").alias("k")), keys, "k").count() == 10


def test_a_changed_byte_and_a_changed_row_are_found(spark, tmp_path):
    root = tmp_path / "package"
    (root / "a").mkdir(parents=True)
    (root / "a" / "one.csv").write_bytes(b"x,y\n1,2\n")
    (root / "two.csv").write_bytes(b"z\n")
    (root / "manifest.json").write_text("{}")
    before = {r.path: (r.length, r.sha256) for r in packages.file_digests(spark, str(root)).collect()}
    import hashlib

    assert before == {"a/one.csv": (8, hashlib.sha256(b"x,y\n1,2\n").hexdigest()), "two.csv": (2, hashlib.sha256(b"z\n").hexdigest())}
    (root / "a" / "one.csv").write_bytes(b"x,y\n1,3\n")
    after = {r.path: (r.length, r.sha256) for r in packages.file_digests(spark, str(root)).collect()}
    assert [p for p in before if before[p] != after[p]] == ["a/one.csv"]

    old = spark.range(3000).select("id", (F.col("id") % 5).alias("v"))
    new = old.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v"))).where("id <> 5").unionAll(spark.createDataFrame([(9, 4)], "id long, v long"))
    changed = packages.changed_leaves(packages.leaves(old, ["id"]), packages.leaves(new.repartition(7), ["id"]))
    assert changed.count() == 3
    assert sorted(map(tuple, packages.changed_keys(old, new, ["id"], changed).collect())) == [(5, 1, 0), (9, 0, 1), (77, 1, 1)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_numbers_are_counted_without_patterns(spark):
    a = spark.createDataFrame([(1, None), (1, None), (-7, 2**62), (0, 5)], "k int, v long")
    b = spark.createDataFrame([(1, None), (-7, 2**62), (0, 6)], "k long, v long")
    found = score.exact_rows(a, b, ["k", "v"])
    assert "RLIKE" not in plan(found)
    assert tuple(found.first())[:3] == (2, 4, 3)
    text = b.select(F.col("k").cast("string").alias("k"), F.when(F.col("v").isNull(), "NaN").otherwise(F.concat(F.col("v").cast("string"), F.lit(".0"))).alias("v"))
    assert tuple(score.exact_rows(a, text, ["k", "v"]).first())[:3] == (2, 4, 3)


def test_texts_that_are_no_numbers_keep_their_normal_form(spark):
    cells = ["a\tb", "a  b", "a b", " A b ", "-", "+x", ".5", "-0.0", "3 days 01:30:00", "-1 day 00:00:00", "1e2", "n\x0bm", "NaT", "9a  9"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(normal_cell(F.col("c"))).collect()]
    assert got == ["a b", "a b", "a b", "a b", "-", "+x", "0.5", "0", "73.5", "-24", "100", "n m", "", "9a 9"]


def test_rowset_recall_joins_nothing(spark):
    g, r = (spark.createDataFrame(x, "k int, s string") for x in ([(1, "a"), (1, "A"), (2, "b"), (None, None)], [(1, "a"), (None, ""), (None, ""), (3, "c")]))
    found = score.rowset_recall(g, r, ["k", "s"])
    assert "Join" not in plan(found)
    assert tuple(found.first()) == (4, 3, 0.75)


def test_what_is_equal_is_not_kept_by_a_score(spark):
    g = spark.range(1000).select("id", F.lit("a").alias("s"))
    r = g.where("id <> 5").select("id", F.when(F.col("id") % 100 == 7, "b").otherwise(F.col("s")).alias("s"))
    left = score.unequal(score.counts(g, r, ["id", "s"]))
    assert left.count() == 21
    assert dict((x.column, x.matched) for x in score.cells(g, r, ["id"], ["id", "s"]).collect()) == {"id": 999, "s": 989}


def test_one_distinct_row_that_suffices_for_a_key_is_paired_without_python(spark):
    rng = random.Random(5)
    rows = lambda n: [(rng.randrange(60), rng.choice("ab"), rng.choice("xyz")) for _ in range(n)]
    a, b = rows(300) + [(99, "a", "x"), (99, "b", "y")], rows(250) + [(99, "q", "y")] * 3
    g, r = (spark.createDataFrame(x, "k int, s string, t string") for x in (a, b))
    got = dict((x.column, x.matched) for x in score.cells(g, r, ["k"], ["s", "t"]).collect())
    want = 0
    for k in {x[0] for x in a} & {x[0] for x in b}:
        p, q = [x for x in a if x[0] == k], [x for x in b if x[0] == k]
        w = np.array([[(x[1] == y[1]) + (x[2] == y[2]) + (4 if x == y else 0) for y in q] for x in p])
        pairs = score.assignment(w)
        want += sum((p[i][1] == q[j][1]) + (p[i][2] == q[j][2]) for i, j in pairs)
    assert got["s"] + got["t"] == want
    only = score.cells(g.where("k = 99"), r.where("k = 99"), ["k"], ["s", "t"])
    assert {x.column: x.matched for x in only.collect()} == {"s": 0, "t": 1}


def test_files_without_repeated_keys_keep_what_differs_alone(spark):
    g = spark.createDataFrame([(i, "a", "x") for i in range(50)], "k int, s string, t string")
    r = spark.createDataFrame([(i, "a" if i else "b", "x") for i in range(49)] + [(77, "a", "x")], "k int, s string, t string")
    for unique in (True, False):
        row = score.file_score(g, r, ["k"], unique).first()
        assert (row.key_f1, row.exact_f1, row.cell_f1) == (0.98, 0.96, round(2 * (49 * 3 - 1) / 100 / 3, 6)), unique
        assert (row.gold_rows, row.result_rows) == (50, 50)


def test_a_log_reads_only_rows_of_wanted_stays_and_looks_up_only_those_without_one(spark):
    stays = spark.createDataFrame([(13, 1, 5, "2100-01-01 00:00:00", "2100-01-02 00:00:00"), (23, 2, 5, "2100-01-03 00:00:00", "2100-01-04 00:00:00"), (33, 3, 6, "2100-01-05 00:00:00", "2100-01-06 00:00:00")], "stay_id long, hadm_id long, subject_id long, intime string, outtime string")
    rows = spark.createDataFrame([(1, "13", "2", "5"), (2, None, "2", "3"), (3, "23", "1", "4"), (4, None, "3", "9")], "_row_index long, stay_id string, hadm_id string, amount string")
    ask = spark.createDataFrame([(7, 23, "c1", "sentinel_or_negative_med_amount"), (8, 33, "c2", "stay_hadm_mismatch"), (9, 44, "c3", "stay_hadm_mismatch")], "source_error_id long, canonical_stay_id long, error_class string, error_subtype string")
    dirty, log = inject.inject("inputevents", rows, stays, ask)
    assert sorted((r.source_error_id, r._stay, r._row_index, r.clean_value, r.dirty_value, r.error_class) for r in log.collect()) == [(7, "23", 2, "3", "-999", "c1"), (8, "33", 4, "3", "1", "c2")]
    assert sorted((r._row_index, r.hadm_id, r.amount) for r in dirty.collect()) == [(1, "2", "5"), (2, "2", "-999"), (3, "1", "4"), (4, "1", "9")]
    # the log's plan meets the requests once and the rows not again by their number
    assert "_row_index#" not in "".join(line for line in plan(log).splitlines() if "Join" in line)


def test_measures_are_laid_out_by_tasks_that_follow_the_events(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice((1, 2, 3, None)), rng.choice((7, 8, 9, None)), rng.choice(("1", "2.5", "x", None))) for _ in range(400)]
    events = spark.createDataFrame(rows, "k int, itemid int, valuenum string")
    names = [(7, "a"), (7, "b"), (8, "a"), (9, None)]
    monkeypatch.setattr(features, "TASK_ROWS", 100)
    found = features.measure_features(events, spark.createDataFrame(names, "itemid int, label string"), "k", "m", 2)
    own = [(k, i, n or str(i), v) for k, i, v in rows for j, n in names if i == j] + [(k, i, None, v) for k, i, v in rows if i is None]
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in line]
    assert dealt and f", {len(own) // 100 + 1})" in dealt[0]
    got = {r.k: r for r in found.collect()}
    assert set(got) == {1, 2, 3, None}
    for k, r in got.items():
        mine = [x for x in own if x[0] == k]
        assert (r.m_events, r.m_items) == (len(mine), len({i for _, i, _, _ in mine} - {None}))
        for item in ("a", "b"):
            values = [float(v) for _, _, n, v in mine if n == item and v not in ("x", None)]
            if f"m_{item.upper()}_count" in found.columns:
                assert r[f"m_{item.upper()}_count"] == len(values) and abs(r[f"m_{item.upper()}_mean"] - sum(values) / len(values)) < 1e-9
                assert (r[f"m_{item.upper()}_min"], r[f"m_{item.upper()}_max"]) == (min(values), max(values))


def test_each_event_of_family_tables_moves_once(spark):
    rng = random.Random(8)
    rows = [(rng.choice((None, 1, 1, 2, 3, 4)), rng.choice((None, "a", "b")), rng.choice((7, 8)), rng.choice((None, 1.5)), None) for _ in range(300)]
    df = spark.createDataFrame(rows, "visit long, x string, y int, value double, z string")
    families = {"f": (F.col("x"), F.col("value")), "g": (F.col("y"), F.col("y")), "none": (F.col("z"), F.col("y"))}
    out = events.family_tables([(df, F.col("visit"), families), (df, F.col("visit"), {"h": (F.col("x"), F.col("x"))})])
    want = []
    for family, item, value in (("f", 1, 3), ("g", 2, 2), ("h", 1, 1)):
        own = [r for r in rows if r[item] is not None]
        for i in ("*", *{r[item] for r in own}):
            at = [r for r in own if i in ("*", r[item])]
            visits, filled = len({r[0] for r in at} - {None}), sum(r[value] is not None for r in at)
            want += [(f"{family}_{kind}", str(i), n, visits, round(1 - filled / len(at), 6)) for kind, n in (("summary", len(at)), ("features", filled)) if n]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "Expand [" not in plan and final.count("ReusedExchange") == 2
    # a task counts a bounded number of items: the more events, the more tasks
    many = events.family_tables([(spark.range(3_000_000).select("id", (F.col("id") % 3).alias("x")), F.col("id"), {"f": (F.col("x"), F.col("x"))})])
    assert "hashpartitioning(place" in (p := many._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in p and ", 6), REPARTITION" in p
    with pytest.raises(ValueError):
        events.family_tables([(df, F.col("visit"), families), (df, F.col("visit"), families)])
