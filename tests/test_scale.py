"""Work of a task and passes over the rows stay bounded as tables grow."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rulespire.catalog import analytics, searching
from rulespire.config import FitConfig
from rulespire.operators.sampling import stratified_split
from rulespire.operators.search import region_counts
from rulespire.plans import grid


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_many_keys_are_dealt_over_more_tasks(spark, monkeypatch):
    place = F.floor(F.col("id") / 100)  # 80 rows a key
    rows = spark.range(8000).select(
        (F.col("id") % 100).alias("supp"), (place % 50 >= 20).cast("int").alias("y"), (place % 50).cast("double").alias("q"),
        (F.col("id") % 11 / 100).alias("d"), (F.col("id") % 9 / 100).alias("t"), (F.col("id") * 37 % 110000).cast("double").alias("p"))
    whole = sorted(searching.scored_tuples(rows, 2, ["ConjUI"], keys=("supp",)).collect())
    monkeypatch.setattr(searching, "KEYS_A_TASK", 3)
    cells = searching.tuple_cells(rows, 2, keys=("supp",))
    assert cells.rdd.getNumPartitions() >= 30
    assert sorted(searching.scored_tuples(rows, 2, ["ConjUI"], keys=("supp",)).collect()) == whole and whole


def test_regions_are_counted_without_sorting_a_task(spark):
    got = [("a", 0, 0, 3.0, 1.0), ("a", 1, 2, 2.0, 0.0), ("a", 2, 1, 0.0, 5.0), ("b", 1, 1, 1.0, 1.0), (None, 0, 1, 1.0, 0.0), (None, 1, 0, 0.0, 2.0), ("a", None, 1, 9.0, 9.0), ("c", 0, 0, 1.0, 1.0)]
    cells = spark.createDataFrame(got, "t string, bi int, bj int, pos double, neg double")
    out = region_counts(cells, ["t"], ["bi", "bj"])
    assert "Window" not in plan_of(out)
    want = set()
    for t in ("a", "b", None):
        own = [r[1:] for r in got if r[0] == t and r[1] is not None]
        sides = {"L": lambda x, c: x <= c, "H": lambda x, c: x > c}
        for ci in range(max(r[0] for r in own)):
            for cj in range(max(r[1] for r in own)):
                part = {a + b: [r for r in own if sides[a](r[0], ci) and sides[b](r[1], cj)] for a in "LH" for b in "LH"}
                part["X"] = part["LH"] + part["HL"]
                want |= {(t, ci, cj, sum(r[2] for r in own), sum(r[3] for r in own), k, float(sum(r[2] for r in v)), float(sum(r[3] for r in v))) for k, v in part.items()}
    assert {tuple(r) for r in out.collect()} == want
    assert region_counts(cells.filter("false"), ["t"], ["bi", "bj"]).count() == 0
    assert {r["region"] for r in region_counts(cells, ["t"], ["bi", "bj"], regions=["LH", "X"]).collect()} == {"LH", "X"}


@pytest.mark.parametrize("runs", [1, 3])
def test_rows_of_a_split_are_not_shuffled(spark, runs):
    rows = spark.range(500).select(F.col("id").cast("string").alias("rk"), (F.col("id") % 3).alias("y"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stratified_split(rows, ["y"], "rk", 0.2, 42, runs)
        plan = plan_of(out)
        sizes = {(r["run"], r["y"]): r["n"] for r in out.filter("is_test").groupBy("run", "y").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sizes == {(run, y): round(n * 0.2) for run in range(runs) for y, n in ((0, 167), (1, 167), (2, 166))}


def test_evidence_tables_read_the_rows_once(spark, sf, monkeypatch):
    calls = []
    kept = analytics.line_wide
    monkeypatch.setattr(analytics, "line_wide", lambda *a: calls.append(a) or kept(*a))
    got = {r["name"]: r["n"] for r in analytics.snk3(spark, sf).collect()}
    assert len(calls) == 1
    assert set(got) == {"full", "by_method", "certified", "auxiliary", "complexity", "win_loss", "pareto"}
    assert got["full"] == got["certified"] + got["auxiliary"] and got["by_method"] == 2 * len(analytics.METHODS)


def test_a_learning_curve_draws_once_per_row(spark, monkeypatch):
    calls = []
    kept = grid.unit_hash
    monkeypatch.setattr(grid, "unit_hash", lambda *a: calls.append(a) or kept(*a))
    rows = spark.range(600).select(F.col("id").cast("string").alias("rk"), (F.col("id") % 10 >= 5).cast("int").alias("y"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    got = grid.learning_curve(rows, "y", ["a", "b"], "rk", [0.5, 1.0], FitConfig(max_depth=2)).collect()
    assert len(calls) == 2
    assert got[1]["n_train"] == 480 and got[1]["test_accuracy"] == 1.0 and 0 < got[0]["n_train"] < 480
