"""Scoring a package of tables against gold tables by keys, cells and whole rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.cells import WHOLE_TYPES, f1, first_by_digest, normal_cell, normal_whole
from tablewright.operators.matching import best_pairs
from tablewright.sources.lineage import cut

#: Weights of the four parts of a file's score.
PART_WEIGHTS = {"schema": 0.10, "key": 0.20, "cell": 0.40, "exact": 0.30}
#: Weight of a table in a package, by its folder.
FOLDER_WEIGHTS = {"cohort": 0.15, "csv": 0.05, "features": 0.12, "summary": 0.02}
#: Key columns of the package's files, of its folders, and those looked for in any other file.
FILE_KEYS = {
    "csv/labels.csv": ("stay_id",),
    "features/preproc_chart_icu.csv": ("stay_id", "itemid", "event_time_from_admit"),
    "features/preproc_diag_icu.csv": ("stay_id",),
    "features/preproc_med_icu.csv": ("subject_id", "hadm_id", "stay_id", "itemid", "starttime", "endtime", "orderid"),
    "features/preproc_out_icu.csv": ("subject_id", "hadm_id", "stay_id", "itemid", "charttime"),
    "features/preproc_proc_icu.csv": ("subject_id", "hadm_id", "stay_id", "itemid", "starttime"),
}
FOLDER_KEYS = {"cohort/": ("stay_id",), "summary/diag_": ("new_icd_code",), "summary/": ("itemid",)}
ANY_KEYS = ("stay_id", "hadm_id", "subject_id", "itemid", "new_icd_code")
LOW = 0.98
#: A key whose distinct rows left make more pairs than this is paired by Spark jobs, not by one task.
TASK_PAIRS = 40_000


def whole_columns(df: DataFrame) -> set[str]:
    return {c for c, kind in df.dtypes if kind in WHOLE_TYPES}


def normal(df: DataFrame, columns: list[str]) -> DataFrame:
    whole = whole_columns(df)
    return df.select(*[(normal_whole if c in whole else normal_cell)(F.col(c)).alias(c) for c in columns])


def schema_score(gold: list[str], result: list[str]) -> dict[str, float]:
    g, r = set(gold), set(result)
    both = len(g & r)
    precision, recall = both / max(len(r), 1), both / max(len(g), 1)
    return {"precision": round(precision, 6), "recall": round(recall, 6), "f1": round(2 * both / (len(g) + len(r)), 6) if g or r else 1.0}


def schema_report(gold: DataFrame, result: DataFrame) -> DataFrame:
    """A row for each column of either side: its non-empty cells on both, and the scores of the names."""
    s = schema_score(gold.columns, result.columns)
    names = [*gold.columns, *[c for c in result.columns if c not in gold.columns]]

    def cells_of(df: DataFrame, name: str) -> DataFrame:
        filled = [F.struct(F.lit(c).alias("column"), total((normal_cell(F.col(c)) != "").cast("int")).alias(name)) for c in df.columns]
        return df.agg(F.array(*filled).alias("r")).select(F.inline("r"))

    every = gold.sparkSession.createDataFrame([(c,) for c in names], "column string")
    out = every.join(cells_of(gold, "gold_cells"), "column", "left").join(cells_of(result, "result_cells"), "column", "left")
    return out.select("column", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gold_cells", "result_cells")], *[F.lit(s[k]).alias(k) for k in ("recall", "precision", "f1")])


def key_contract(files: DataFrame, fallback: str) -> DataFrame:
    """files (path, columns) with keys: those of the file, else of its folder, else the fallback or the first known key it has."""
    path, columns = F.lower("path"), F.col("columns")
    keys = lambda k: F.array(*map(F.lit, k))
    named = [F.when(path.startswith("cohort/") | path.endswith("/labels.csv"), keys(FOLDER_KEYS["cohort/"]))] + [F.when(path == p, keys(k)) for p, k in FILE_KEYS.items()] + [F.when(path.startswith(p), keys(k)) for p, k in FOLDER_KEYS.items()]
    first = F.slice(F.filter(keys((fallback, *ANY_KEYS)), lambda k: F.array_contains(columns, k)), 1, 1)
    return files.withColumn("keys", F.coalesce(*named, first))


def tagged(gold: DataFrame, result: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both sides in normal form with counts _g and _r."""
    side = lambda df, g, r: normal(df, columns).withColumns({"_g": F.lit(g), "_r": F.lit(r)})
    return side(gold, 1, 0).unionAll(side(result, 0, 1))


def counts(gold: DataFrame, result: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in normal form and how often each occurs; columns that are whole numbers on both sides are grouped as such and written as text after it."""
    whole = whole_columns(gold) & whole_columns(result)
    of = lambda c: F.col(c).cast("long") if c in whole else normal_cell(F.col(c))
    side = lambda df, g, r: df.select(*[of(c).alias(c) for c in columns], F.lit(g).alias("_g"), F.lit(r).alias("_r"))
    rows = side(gold, 1, 0).unionAll(side(result, 0, 1)).groupBy(*columns).agg(F.sum("_g").alias("_gold"), F.sum("_r").alias("_result"))
    return rows.select(*[normal_whole(F.col(c)).alias(c) if c in whole else c for c in columns], "_gold", "_result")


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def summed(m: DataFrame) -> DataFrame:
    return m.agg(total(F.least("_gold", "_result")).alias("matched"), total(F.col("_gold")).alias("gold_rows"), total(F.col("_result")).alias("result_rows"))


def key_structure(gold: DataFrame, result: DataFrame, keys: list[str]) -> DataFrame:
    return summed(counts(gold, result, keys)).withColumn("key_f1", f1(F.col("matched"), F.col("result_rows"), F.col("gold_rows")))


def exact_rows(gold: DataFrame, result: DataFrame, columns: list[str]) -> DataFrame:
    return summed(counts(gold, result, columns)).withColumn("exact_f1", f1(F.col("matched"), F.col("result_rows"), F.col("gold_rows")))


def cells_unique(gold: DataFrame, result: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(column, matched): equal cells of rows paired by keys that occur once on each side."""
    both = keys + [c for c in columns if c not in keys]
    a, b = normal(gold, both).alias("a"), normal(result, both).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    rows = [F.struct(F.lit(c).alias("column"), total((F.col(f"a.{c}") == F.col(f"b.{c}")).cast("int")).alias("matched")) for c in columns]
    return a.join(b, same).agg(F.array(*rows).alias("r")).select(F.inline("r"))


def paired_cells(left: DataFrame, exact: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """cells_unique() of what unequal() left and the number of equal_rows()."""
    a, b = left.where("_side = 'g'").alias("a"), left.where("_side = 'r'").alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    equal = [F.struct(F.lit(c).alias("column"), total((F.col(f"a.{c}") == F.col(f"b.{c}")).cast("int")).alias("n")) for c in columns]
    rest = a.join(b, same).agg(F.array(*equal).alias("r")).select(F.inline("r"))
    return exact.select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"), "n").unionAll(rest).groupBy("column").agg(total(F.col("n")).alias("matched"))


def assignment(weights) -> list[tuple[int, int]]:
    """Pairs of rows and columns of a weight matrix with the largest total: shortest augmenting paths."""
    import numpy as np

    flip = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if flip else weights).astype(float)
    n, m = cost.shape
    row_of, u, v = np.full(m + 1, -1), np.zeros(n), np.zeros(m + 1)
    for i in range(n):
        row_of[m], j = i, m
        least, came, done = np.full(m + 1, np.inf), np.full(m + 1, -1), np.zeros(m + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            free = ~done[:m]
            slack = cost[r] - u[r] - v[:m]
            better = free & (slack < least[:m])
            least[:m][better], came[:m][better] = slack[better], j
            candidates = np.where(free, least[:m], np.inf)
            k = int(candidates.argmin())
            step = candidates[k]
            u[row_of[done]] += step
            v[done] -= step
            least[:m][free] -= step
            j = k
        while j != m:
            row_of[j], j = row_of[came[j]], came[j]
    pairs = [(int(row_of[j]), j) for j in range(m) if row_of[j] >= 0]
    return [(b, a) if flip else (a, b) for a, b in pairs]


def transport(weights, supply, demand):
    """How often each row and column are paired, with the largest total weight and as many pairs as the smaller side has.

    assignment() for rows and columns that occur supply and demand times: shortest augmenting paths,
    each of which carries as much as it can.
    """
    import numpy as np

    flip = supply.sum() > demand.sum()
    cost = (-(weights.T if flip else weights)).astype(np.int64)
    supply, demand = (x.astype(np.int64) for x in ((demand, supply) if flip else (supply, demand)))
    n, m = cost.shape
    flow, free, far = np.zeros((n, m), np.int64), demand.copy(), np.iinfo(np.int64).max // 4
    # cost - u - v is 0 where rows and columns are paired and nowhere negative
    v = np.zeros(m, np.int64)
    u = cost.min(axis=1) if m else np.zeros(n, np.int64)
    for i in range(n):
        left = int(supply[i])
        while left:
            least, came, done = np.full(m, far), np.full(m, -1), np.zeros(m, bool)
            at_row, from_col = np.full(n, far), np.full(n, -1)
            at_row[i], fresh, at = 0, [i], 0
            while True:
                for r in fresh:
                    reach = cost[r] - u[r] - v + at
                    better = ~done & (reach < least)
                    least[better], came[better] = reach[better], r
                j = int(np.where(done, far, least).argmin())
                at, done[j] = int(least[j]), True
                if free[j]:
                    break
                fresh = np.flatnonzero((flow[:, j] > 0) & (at_row == far))
                at_row[fresh], from_col[fresh] = at, j
            seen = at_row < far
            u[seen] += at - at_row[seen]
            v[done] -= at - least[done]
            path, amount, col = [], min(left, int(free[j])), j
            while True:
                r = int(came[col])
                path.append((r, col))
                if r == i:
                    break
                col = int(from_col[r])
                amount = min(amount, int(flow[r, col]))
            for k, (r, c) in enumerate(path):
                flow[r, c] += amount
                if k + 1 < len(path):
                    flow[r, from_col[r]] -= amount
            free[j] -= amount
            left -= amount
    return flow.T if flip else flow


def unequal(rows: DataFrame) -> DataFrame:
    """What is left of counts() once equal rows are paired: (columns, _side, _n), cut from what made it, so that nothing equal is kept or counted again."""
    sides = F.expr("filter(array(struct('g' as side, _gold - _result as n), struct('r' as side, _result - _gold as n)), x -> x.n > 0)")
    every = [c for c in rows.columns if c not in ("_gold", "_result")]
    return cut(rows.where("_gold <> _result").select(*every, F.explode(sides).alias("_s")).select(*every, F.col("_s.side").alias("_side"), F.col("_s.n").alias("_n")))


def of_side(side: str, c: Column) -> Column:
    return F.when(F.col("_side") == side, c)


def equal_rows(gold: DataFrame, left: DataFrame) -> DataFrame:
    """(n): how many gold rows equal a row of the result, given what unequal() left of them."""
    return gold.agg(F.count("*").alias("n")).unionAll(left.agg(-total(of_side("g", F.col("_n"))))).agg(total(F.col("n")).alias("n"))


def cells(gold: DataFrame, result: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(column, matched) of tables with repeated keys: equal rows are paired first, the rest of a key by best assignment."""
    left = unequal(counts(gold, result, keys + [c for c in columns if c not in keys]))
    return cells_of(left, equal_rows(gold, left), keys, columns)


def cells_of(left: DataFrame, exact: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """cells() of what unequal() left and the number of equal_rows().

    Where one row of a side is left, its best partner is an aggregate over as many pairs as
    the other side has rows; where one distinct row of a side suffices for all of the other, nothing is to be chosen.
    Other keys with several rows left on both sides reach Python, as
    distinct rows and how often each is left, if these make at most TASK_PAIRS pairs; larger keys are paired by
    best_pairs(), so no task grows with a key.
    """
    every = keys + [c for c in columns if c not in keys]
    exact = exact.select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"), "n")
    group = left.groupBy(*keys).agg(*[f(of_side(side, c)).alias(n) for f, side, c, n in ((F.sum, "g", F.col("_n"), "_ng"), (F.sum, "r", F.col("_n"), "_nr"), (F.count, "g", F.lit(1), "_dg"), (F.count, "r", F.lit(1), "_dr"))])
    forced = F.expr("_dg = 1 and _ng >= _nr or _dr = 1 and _nr >= _ng")
    group = cut(group.where("_ng is not null and _nr is not null").withColumn("_pairs", F.col("_dg") * F.col("_dr")).withColumn("_way", F.when(forced, "forced").when(F.least("_ng", "_nr") == 1, "single").when(F.col("_pairs") <= TASK_PAIRS, "task").otherwise("jobs")))

    def scored(way: str) -> DataFrame:
        some = left.join(group.where(F.col("_way") == way).select(*keys), keys, "left_semi")
        a, b = some.where("_side = 'g'").alias("a"), some.where("_side = 'r'").alias("b")
        same = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
        equal = F.array(*[(F.col(f"a.{c}") == F.col(f"b.{c}")).cast("int") for c in columns])
        return a.join(b, same).select(*[F.col(f"a.{k}").alias(k) for k in keys], equal.alias("_e"), F.least("a._n", "b._n").alias("_times"))

    each = lambda value: F.array(*[F.struct(F.lit(c).alias("column"), total(value(i)).alias("n")) for i, c in enumerate(columns)]).alias("r")
    best = scored("single").groupBy(*keys).agg(F.max(F.struct(F.aggregate("_e", F.lit(0), lambda x, y: x + y).alias("n"), F.col("_e").alias("e"))).alias("_m"))
    singles = best.agg(each(lambda i: F.get("_m.e", F.lit(i)))).select(F.inline("r"))
    singles = singles.unionAll(scored("forced").agg(each(lambda i: F.get("_e", F.lit(i)) * F.col("_times"))).select(F.inline("r")))
    open_ = left.join(group.where("_way = 'task'").select(*keys), keys, "left_semi")
    large = group.where("_way = 'jobs'").select(*keys)

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g, r = (pdf[pdf._side == k].groupby(columns, as_index=False, dropna=False, sort=True)._n.sum() for k in ("g", "r"))
        equal = lambda c: g[c].to_numpy()[:, None] == r[c].to_numpy()[None, :]
        weights = np.zeros((len(g), len(r)), np.int64)
        for c in columns:
            weights += equal(c)
        flow = transport(weights, g["_n"].to_numpy(), r["_n"].to_numpy())
        i, j = flow.nonzero()
        hit = np.array([int((flow[i, j] * (g[c].to_numpy()[i] == r[c].to_numpy()[j])).sum()) for c in columns])
        return pd.DataFrame({"column": columns, "n": hit.astype("int64")})

    rest = open_.groupBy(*keys).applyInPandas(pair, "column string, n long")
    if not large.isEmpty():
        most = cut(left.join(large, keys, "left_semi"))
        g, r = (most.where(F.col("_side") == side).select(*every, "_n") for side in ("g", "r"))
        rest = rest.unionAll(best_pairs(g, r, keys, columns, "_n"))
    return exact.unionAll(singles).unionAll(rest).groupBy("column").agg(total(F.col("n")).alias("matched"))


def keyed(gold: DataFrame, result: DataFrame, keys: list[str]) -> bool:
    """Whether rows of both sides can be aligned: there is a key, and both sides have its columns."""
    return bool(keys) and all(k in gold.columns and k in result.columns for k in keys)


def file_score(gold: DataFrame, result: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """One row: schema, key, cell and exact F1 of a table and their weighted score.

    Without a key, or where a side lacks a key column, rows cannot be told apart: only the schema scores.
    """
    schema = schema_score(gold.columns, result.columns)["f1"]
    if not keyed(gold, result, keys):
        zero = {"schema_f1": schema, "key_f1": 0.0, "cell_f1": 0.0, "exact_f1": 0.0, "score": round(PART_WEIGHTS["schema"] * schema, 6)}
        side = lambda df, g: df.agg(F.count("*").alias("n")).select(F.when(F.lit(g), F.col("n")).alias("gold_rows"), F.when(F.lit(not g), F.col("n")).alias("result_rows"))
        n = side(gold, True).unionByName(side(result, False)).agg(F.max("gold_rows").alias("gold_rows"), F.max("result_rows").alias("result_rows"))
        return n.select(*[F.lit(v).alias(c) for c, v in zero.items()], "gold_rows", "result_rows")
    shared = [c for c in gold.columns if c in result.columns]
    # both sides are brought to normal form and counted once; keys, cells and exact rows are read off the number of
    # equal rows and off what is left: every key has its equal rows on both sides
    left = unequal(counts(gold, result, shared))
    same = equal_rows(gold, left)
    cell = paired_cells(left, same, keys, shared) if unique else cells_of(left, same, keys, shared)
    key = left.groupBy(*keys).agg(total(of_side("g", F.col("_n"))).alias("_gold"), total(of_side("r", F.col("_n"))).alias("_result")).agg(total(F.least("_gold", "_result")).alias("n")).unionAll(same)
    # a row that lacks a column equals no whole row
    exact = same if shared == gold.columns else same.select(F.lit(0).cast("long").alias("n"))
    named = {"gold_rows": gold.agg(F.count("*").alias("n")), "result_rows": result.agg(F.count("*").alias("n")), "k": key, "x": exact, "c": cell.select(F.col("matched").alias("n"))}
    parts = reduce(DataFrame.unionAll, (df.select(F.lit(k).alias("part"), "n") for k, df in named.items()))
    one = parts.agg(*[total(F.when(F.col("part") == k, F.col("n"))).alias(k) for k in named])
    g, r = F.col("gold_rows"), F.col("result_rows")
    whole = (g + r).cast("double")
    cell_f1 = F.when(whole == 0, 1.0).otherwise(F.round(2 * F.coalesce("c", F.lit(0)) / whole / len(gold.columns), 6))
    one = one.select(F.lit(schema).alias("schema_f1"), f1(F.col("k"), r, g).alias("key_f1"), cell_f1.alias("cell_f1"), f1(F.col("x"), r, g).alias("exact_f1"), "gold_rows", "result_rows")
    score = sum((F.col(f"{p}_f1") * w for p, w in PART_WEIGHTS.items()), F.lit(0.0))
    return one.select("schema_f1", "key_f1", "cell_f1", "exact_f1", F.round(score, 6).alias("score"), "gold_rows", "result_rows")


def column_scores(gold: DataFrame, result: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each gold column: matched cells of paired rows, precision, recall and F1; a column the result lacks has none.

    Where rows cannot be aligned (see keyed()) no cell matches.
    """
    shared = [c for c in gold.columns if c in result.columns]
    aligned = keyed(gold, result, keys)
    left = unequal(counts(gold, result, shared)) if aligned else None
    every = gold.sparkSession.createDataFrame([(c, "matched" if c in shared else "missing_column") for c in gold.columns], "column string, status string")
    whole = {"gold_cells": gold.count(), "result_cells": result.count()}
    cell = cells_of(left, equal_rows(gold, left), keys, shared) if aligned else every.select("column", F.lit(0).cast("long").alias("matched"))
    at = every.join(cell, "column", "left").withColumn("matched", F.coalesce("matched", F.lit(0)).cast("long"))
    at = at.withColumns({c: F.lit(whole[c]).cast("long") for c in ("gold_cells", "result_cells")})
    share = lambda c: F.round(F.col("matched") / F.greatest(F.col(c), F.lit(1)), 6)
    out = at.withColumn("precision", share("result_cells")).withColumn("recall", share("gold_cells"))
    return out.withColumn("column_f1", F.when(F.col("status") == "matched", f1(F.col("matched"), F.col("result_cells"), F.col("gold_cells"))).otherwise(0.0)).select("column", "status", "matched", "gold_cells", "result_cells", "precision", "recall", "column_f1")


def package_files(gold: dict[str, DataFrame], result: dict[str, DataFrame], keys: dict[str, list[str]], unique: bool = False) -> DataFrame:
    """File scores of a package; a missing file, or None for one that cannot be read, scores zero and keeps its gold rows."""
    parts = []
    for path, g in sorted(gold.items()):
        if result.get(path) is not None:
            row = file_score(g, result[path], keys[path], unique).withColumn("status", F.lit("scored"))
        else:
            row = g.agg(F.count("*").alias("gold_rows")).select(*[F.lit(0.0).alias(c) for c in ("schema_f1", "key_f1", "cell_f1", "exact_f1", "score")], "gold_rows", F.lit(0).cast("long").alias("result_rows"), F.lit("unreadable" if path in result else "missing").alias("status"))
        parts.append(row.select(F.lit(path).alias("path"), "status", "schema_f1", "key_f1", "cell_f1", "exact_f1", "score", "gold_rows", "result_rows"))
    return reduce(DataFrame.unionByName, parts)


def folder(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def balanced(files: DataFrame) -> DataFrame:
    """(part, score, coverage): scores of the groups and of the package, tables weighted by folder."""
    weight = F.coalesce(*[F.when(folder(F.col("path")) == k, F.lit(w)) for k, w in FOLDER_WEIGHTS.items()], F.lit(0.0))
    group = F.when(folder(F.col("path")).isin("cohort", "csv"), "core").when(folder(F.col("path")) == "features", "feature").otherwise("summary")
    at = files.withColumn("w", weight).withColumn("part", group)
    sums = at.select(F.explode(F.array("part", F.lit("package"))).alias("part"), "w", "score", "status")
    return sums.groupBy("part").agg(F.round(F.sum(F.col("w") * F.col("score")) / F.sum("w"), 6).alias("score"), F.round(F.avg((F.col("status") == "scored").cast("double")), 6).alias("coverage"))


def equal_weight(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("score"))


def match_files(gold: DataFrame, result: DataFrame) -> DataFrame:
    """(gold_path, result_path, status) of two lists of paths: the same path first, then a base name that is unique on both sides."""
    base = lambda c: F.substring_index(F.col(c), "/", -1)
    g, r = gold.select(F.col("path").alias("gold_path")).distinct(), result.select(F.col("path").alias("result_path")).distinct()
    exact = g.join(r, F.col("gold_path") == F.col("result_path"))
    g2 = g.join(exact.select("gold_path"), "gold_path", "left_anti").withColumn("b", base("gold_path"))
    r2 = r.join(exact.select("result_path"), "result_path", "left_anti").withColumn("b", base("result_path"))
    names = r2.groupBy("b").agg(F.count("*").alias("n"), F.min("result_path").alias("result_path"))
    claims = g2.groupBy("b").agg(F.count("*").alias("m"))
    rest = g2.join(names, "b", "left").join(claims, "b").select("gold_path", F.when((F.col("n") == 1) & (F.col("m") == 1), F.col("result_path")).alias("result_path"), F.when(F.col("n").isNull(), "missing").when((F.col("n") == 1) & (F.col("m") == 1), "base_name").otherwise("ambiguous").alias("status"))
    found = exact.withColumn("status", F.lit("path")).unionByName(rest)
    extra = r.join(found.select("result_path").where("result_path is not null"), "result_path", "left_anti")
    return found.unionByName(extra.select(F.lit(None).cast("string").alias("gold_path"), "result_path", F.lit("extra").alias("status")))


def manifest_issues(manifest: DataFrame, columns: DataFrame) -> DataFrame:
    """(path, issue) of a manifest of (path, keys) against the gold tables' (path, column)."""
    paths = columns.select("path").distinct()
    unknown = manifest.select("path").join(paths, "path", "left_anti").withColumn("issue", F.lit("unknown_file"))
    absent = paths.join(manifest.select("path"), "path", "left_anti").withColumn("issue", F.lit("no_entry"))
    empty = manifest.where("size(keys) = 0").select("path", F.lit("no_keys").alias("issue"))
    keys = manifest.join(paths, "path", "left_semi").select("path", F.explode("keys").alias("column"))
    bad = keys.join(columns, ["path", "column"], "left_anti").select("path", F.concat(F.lit("missing_key:"), "column").alias("issue"))
    return unknown.unionByName(absent).unionByName(empty).unionByName(bad)


def repair_targets(files: DataFrame, column_scores: DataFrame | None = None, low: float = LOW, most: int = 200) -> DataFrame:
    """(path, target, detail): what a repair should look at, first so many, without any cell value."""
    at = lambda name, c: files.where(c).select("path", F.lit(name).alias("target"), F.lit("").alias("detail"))
    scored = F.col("status") == "scored"
    out = at("missing_file", F.col("status").isin("missing", "unreadable")).unionByName(at("missing_columns", scored & (F.col("schema_f1") < 1)))
    out = out.unionByName(at("key_structure_mismatch", scored & (F.col("key_f1") < low))).unionByName(at("low_exact_row_f1", scored & (F.col("exact_f1") < low)))
    if column_scores is not None:
        out = out.unionByName(column_scores.where(F.col("column_f1") < low).select("path", F.lit("low_column_f1").alias("target"), F.col("column").alias("detail")))
    return out.orderBy("target", "path", "detail").limit(most)


def feedback(files: DataFrame) -> DataFrame:
    """Names, scores and row counts only."""
    return files.select(F.substring_index("path", "/", -1).alias("file"), "score", "gold_rows", "result_rows", "status")


def regression(files: DataFrame) -> DataFrame:
    """Pass only where columns, rows, keys, cells and exact rows all agree."""
    whole = (F.col("status") == "scored") & (F.col("gold_rows") == F.col("result_rows"))
    for c in ("schema_f1", "key_f1", "cell_f1", "exact_f1"):
        whole = whole & (F.col(c) == 1.0)
    return files.select("path", whole.alias("passed"))


def recall(gold: DataFrame, result: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset recall of exact rows, keys and non-empty cells, and the composite of files, columns, rows, cells and precision."""
    columns = gold.columns
    shared = [c for c in columns if c in result.columns]
    rows, key = counts(gold, result.select(*shared), columns if shared == columns else shared), counts(gold, result, keys)
    cell = tagged(gold, result, shared).select(*["_g", "_r"], F.struct(*keys).alias("key"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in shared if c not in keys]))).where("value <> ''")
    cell = cell.groupBy("key", "column", "value").agg(F.sum("_g").alias("_gold"), F.sum("_r").alias("_result"))
    share = lambda df, name: df.agg(F.round(total(F.least("_gold", "_result")) / F.greatest(total(F.col("_gold")), F.lit(1)), 6).alias("recall"), F.round(total(F.least("_gold", "_result")) / F.greatest(total(F.col("_result")), F.lit(1)), 6).alias("precision")).select(F.lit(name).alias("part"), "recall", "precision")
    parts = share(rows, "row").unionByName(share(key, "key")).unionByName(share(cell, "cell"))
    column = round(len(shared) / max(len(columns), 1), 6)
    pick = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    return parts.agg(pick("row", "recall").alias("row_recall"), pick("key", "recall").alias("key_recall"), pick("cell", "recall").alias("cell_recall"), pick("cell", "precision").alias("cell_precision")).withColumn("column_recall", F.lit(column)).withColumn(
        "composite", F.round(0.1 + 0.2 * F.col("column_recall") + 0.2 * F.col("row_recall") + 0.4 * F.col("cell_recall") + 0.1 * F.col("cell_precision"), 6)
    )


def recall_targets(gold: DataFrame, result: DataFrame, keys: list[str], columns: list[str], low: float = LOW) -> DataFrame:
    """(target, detail, value): too many rows, missing keys, and columns of low recall among paired rows."""
    key = counts(gold, result, keys).agg(total(F.greatest(F.col("_result") - F.col("_gold"), F.lit(0))).alias("over"), total(F.greatest(F.col("_gold") - F.col("_result"), F.lit(0))).alias("under"))
    rows = key.select(F.inline(F.array(F.struct(F.lit("over_extraction").alias("target"), F.lit("").alias("detail"), F.col("over").cast("double").alias("value")), F.struct(F.lit("missing_reference_rows").alias("target"), F.lit("").alias("detail"), F.col("under").cast("double").alias("value"))))).where("value > 0")
    n = unique_recall(gold, result, keys, columns)
    return rows.unionByName(n.where(F.col("recall") < low).select(F.lit("low_column_recall").alias("target"), F.col("column").alias("detail"), F.col("recall").alias("value")))


def unique_recall(gold: DataFrame, result: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(column, cells, matched, recall): non-empty gold cells found under their key in the result.

    Where a key comes several times in the result, its row with the smallest digest is the one compared.
    """
    both = keys + columns
    a, b = normal(gold, both).alias("a"), first_by_digest(normal(result, both), keys).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    there = lambda c: (F.col(f"a.{c}") != "").cast("int")
    hit = lambda c: ((F.col(f"a.{c}") != "") & F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False))).cast("int")
    rows = [F.struct(F.lit(c).alias("column"), total(there(c)).alias("cells"), total(hit(c)).alias("matched")) for c in columns]
    out = a.join(b, same, "left").agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return out.withColumn("recall", F.round(F.col("matched") / F.greatest(F.col("cells"), F.lit(1)), 6))


def rowset_recall(gold: DataFrame, result: DataFrame, columns: list[str]) -> DataFrame:
    """(gold_rows, matched, recall): gold rows that the result has, however often; read off one count of both sides."""
    n = counts(gold, result, columns).agg(total(F.col("_gold")).alias("gold_rows"), total(F.when(F.col("_result") > 0, F.col("_gold"))).alias("matched"))
    return n.withColumn("recall", F.round(F.col("matched") / F.greatest(F.col("gold_rows"), F.lit(1)), 6))


def target_ids(targets: DataFrame) -> DataFrame:
    """Each target with a stable id of ten hex digits."""
    return targets.withColumn("target_id", F.substring(F.sha2(F.concat_ws("|", "target", "path", "detail"), 256), 1, 10))


def targets_from_issues(issues: DataFrame, existing: DataFrame) -> DataFrame:
    """Table paths named in issue texts that no target has yet."""
    found = issues.select(F.explode(F.regexp_extract_all("text", F.lit(r"((?:cohort|csv|features|summary)/[A-Za-z0-9_]+)"), F.lit(1))).alias("path")).distinct()
    return found.join(existing.select("path").distinct(), "path", "left_anti").withColumn("target", F.lit("reported_issue"))
