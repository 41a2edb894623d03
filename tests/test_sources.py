"""Readers, writers, registry, statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulespire.operators import results as A
from rulespire.sources.label_text import discover, read_label_text, restrict, widen
from rulespire.sources.registry import Registry


def write(folder, name, text):
    (folder / name).write_text(text)


def test_label_text_reads_nested_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path, "a.dl8", "# note\n1 0 1\n\n0 1 1\n")
    write(tmp_path / "sub", "b.dl8", "1  5 7\n")
    df = read_label_text(spark, str(tmp_path))
    assert sorted((r["task"], r["y"], tuple(r["x"])) for r in df.collect()) == [("a", 0, (1.0, 1.0)), ("a", 1, (0.0, 1.0)), ("b", 1, (5.0, 7.0))]
    assert discover(spark, str(tmp_path)) == ["a", "b"]
    assert restrict(df, first=1).select("task").distinct().count() == 1
    wide, names = widen(df, 2)
    assert names == ["x0", "x1"] and wide.count() == 3


@pytest.mark.parametrize("text,why", [("1 0 1\n0 1\n", "width"), ("1 a\n", "non-integer"), ("1\n0\n", "feature")])
def test_label_text_errors(spark, tmp_path, text, why):
    write(tmp_path, "bad.dl8", text)
    with pytest.raises(ValueError, match=why):
        read_label_text(spark, str(tmp_path))


def test_no_files(spark, tmp_path):
    with pytest.raises(Exception):
        discover(spark, str(tmp_path))


def test_registry(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "reg"))
    assert reg.runs().count() == 0
    exp = reg.register({"b": 1, "a": 2})
    reg.add_runs(spark.createDataFrame([("r1", exp, "horn", 0.9), ("r2", exp, "conj", 0.8)], "run_id string, experiment_id string, method string, accuracy double"))
    reg.add_runs(spark.createDataFrame([("r3", "other", "horn", 0.7, "x")], "run_id string, experiment_id string, method string, accuracy double, note string"))
    assert reg.experiments().count() == 1 and reg.runs().count() == 3 and "note" in reg.runs().columns
    payload = spark.createDataFrame([("r1", 0.95)], "run_id string, accuracy double")
    assert {r["run_id"]: r["accuracy"] for r in reg.restore(exp, payload).collect()} == {"r1": 0.95, "r2": 0.8}
    reg.delete_runs(spark.createDataFrame([("r2",)], "run_id string"))
    assert sorted(r["run_id"] for r in reg.runs().collect()) == ["r1", "r3"]


def test_p_values():
    assert A.t_p_value(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert A.z_p_value(1.96) == pytest.approx(0.05, abs=1e-3)
    assert math.isnan(A.t_p_value(1.0, 0))


def test_pareto_front_by_definition(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 3)), float(rng.integers(0, 10)), float(rng.integers(0, 10)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, gain double, cost double, id int")
    got = {r["id"] for r in A.pareto_front(df, ["k"], "gain", "cost").collect()}
    beats = lambda o, r: o[0] == r[0] and o[1] >= r[1] and o[2] <= r[2] and (o[1] > r[1] or o[2] < r[2])
    assert got == {r[3] for r in rows if not any(beats(o, r) for o in rows)}


def test_every_fitted_kind_is_saved(spark, tmp_path):
    import random

    from rulespire.plans.facade import RuleClassifier
    from rulespire.sources.sinks import load_fitted, save_fitted

    rng = random.Random(2)
    rows = [(k, *[float(rng.randint(0, 5)) for _ in range(3)]) for k in range(400)]
    df = spark.createDataFrame([(k, a, b, c, int(a >= 3 or b < 2)) for k, a, b, c in rows], "rk long, a double, b double, c double, y int")
    for kind, how in (("single", "platt"), ("forest", "isotonic"), ("boosting", "platt")):
        clf = RuleClassifier(["a", "b", "c"], model_type=kind, calibration_method=how, n_estimators=2, max_depth=2).fit(df)
        path = f"{tmp_path}/{kind}"
        save_fitted(spark, clf, path)
        again = load_fitted(spark, path)
        assert again.kind_ == kind and again.max_depth == 2
        one, two = (sorted((r["rk"], r["proba"], r["pred"]) for r in c.predict(df).collect()) for c in (clf, again))
        assert one == two
        if kind == "single":
            assert again.explain(df).count() == 400
