"""Fits: truth tables, planted rules, counts, ties, ensembles, facade."""

import itertools
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rulespire.config import FitConfig, for_width
from rulespire.functions.rules import AFFINE, ANTIHORN, ANY, BEST, CONJUI, HORN, SQUARE2CNF, Literal, Rule
from rulespire.operators.dense import best_regions
from rulespire.operators.prune import node_errors, prune
from rulespire.operators.search import best_per, region_counts, regions_of, score_counts
from rulespire.plans.boost import fit_boosting
from rulespire.plans.encode import encode
from rulespire.plans.facade import RuleClassifier, choose_model
from rulespire.plans.forest import fit_forest, oob_scores, score_forest
from rulespire.plans.grow import fit_tree
from rulespire.plans.model import TreeModel, accuracy, score_rows
from rulespire.plans.walk import leaves_of
from rulespire.sources.sinks import load_model, save_model
from rulespire.sources.tables import LINE_FEATURES, line_task

TINY = FitConfig(max_depth=1, min_samples_leaf=1, min_samples_split=2, allow_affine=True, search_3d=False)


def table(spark, truth, copies=50):
    rows = [(a, b, int(truth(a, b))) for a, b in itertools.product((0.0, 1.0), repeat=2)] * copies
    return spark.createDataFrame(rows, "x0 double, x1 double, y int")


@pytest.mark.parametrize("family,truth", [
    (CONJUI, lambda a, b: a and b), (ANTIHORN, lambda a, b: a or b), (HORN, lambda a, b: a >= 0.5 or b < 0.5),
    (HORN, lambda a, b: a < 0.5 or b >= 0.5), (AFFINE, lambda a, b: a != b),
])
def test_four_row_tables(spark, family, truth):
    df = table(spark, truth)
    m = fit_tree(df, "y", ["x0", "x1"], replace(TINY, family=family))
    rule = m.nodes[(0, 1)].rule
    assert rule is not None and rule.family == family
    assert accuracy(score_rows(df, m), "pred", "y").first()[0] == 1.0


def test_majority_leaf_and_tie(spark):
    m = fit_tree(table(spark, lambda a, b: a), "y", ["x0", "x1"], FitConfig(max_depth=0))
    assert m.nodes[(0, 1)].rule is None and m.nodes[(0, 1)].proba >= 0.5


@pytest.fixture(scope="module")
def or2(spark, sf):
    return line_task(spark, sf, "or2").persist()


@pytest.fixture(scope="module")
def tree(spark, or2):
    return fit_tree(or2, "y", LINE_FEATURES, FitConfig(max_depth=3, n_bins=32))


def test_planted_or_rule_at_root(tree):
    lits = {(LINE_FEATURES[l.feature], l.op) for l in tree.nodes[(0, 1)].rule.literals}
    assert lits == {("q", "GE"), ("d", "LT")}


@pytest.mark.parametrize("task,family", [("and2", CONJUI), ("xor2", AFFINE), ("cnf4", SQUARE2CNF)])
def test_planted_rules(spark, sf, task, family):
    df = line_task(spark, sf, task)
    m = fit_tree(df, "y", LINE_FEATURES, FitConfig(family=family, max_depth=1, search_3d=False))
    assert m.nodes[(0, 1)].rule.family == family
    assert accuracy(score_rows(df, m), "pred", "y").first()[0] > 0.9


def test_node_counts_are_the_rows_routed(or2, tree):
    routed = or2.withColumn("leaf", tree.leaf_column()).groupBy("leaf").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    got = {r["leaf"]: (r["p"], r["n"]) for r in routed}
    assert got == {n.node_id: (n.n_pos, n.n) for n in tree.leaves()}


def test_walk_equals_case_routing(spark, or2, tree):
    both = or2.withColumn("by_walk", leaves_of(spark, tree)[0]).withColumn("by_case", tree.leaf_column())
    assert both.filter("by_walk <> by_case").count() == 0


def test_same_tree_on_one_partition(spark, or2, tree):
    again = fit_tree(or2.repartition(1), "y", LINE_FEATURES, FitConfig(max_depth=3, n_bins=32))
    assert {k: (n.rule, n.n_pos) for k, n in again.nodes.items()} == {k: (n.rule, n.n_pos) for k, n in tree.nodes.items()}


def test_dense_scoring_equals_windows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.integers(0, 6, (4000, 3)), columns=["bi", "bj", "bk"])
    pdf["t"] = rng.integers(0, 3, 4000)
    pdf["y"] = ((pdf.bi >= 3) | (pdf.bj < 2)) ^ (rng.random(4000) < 0.1)
    for axes in (["bi", "bj"], ["bi", "bj", "bk"]):
        cells = spark.createDataFrame(pdf).groupBy("t", *axes).agg(F.sum(F.col("y").cast("double")).alias("pos"), F.sum((~F.col("y")).cast("double")).alias("neg"))
        a = best_per(score_counts(region_counts(cells, ["t"], axes), len(axes), 5), ["t", "region"], axes)
        b = best_regions(cells, ["t"], axes, regions_of(len(axes)), 5)
        cols = ["t", "region", *axes, "score", "ip", "ineg"]
        x, y = (d.select(*cols).toPandas().sort_values(["t", "region"]).reset_index(drop=True) for d in (a, b))
        pd.testing.assert_frame_equal(x, y, check_dtype=False, rtol=1e-9)


def test_codes_are_exact(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": np.round(rng.normal(size=3000), 2), "b": rng.normal(size=3000), "y": rng.integers(0, 2, 3000)})
    enc = encode(spark.createDataFrame(pdf), "y", ["a", "b"], max_codes=64, keep=["a", "b"], collapse=False)
    got = enc.df.toPandas()
    for i, f in enumerate("ab"):
        assert (np.array([c[i] for c in got.c]) == np.searchsorted(enc.cuts[i], got[f], side="right")).all()


def test_binary_rows_collapse(spark):
    df = spark.range(5000).select(*[(F.pmod(F.floor(F.col("id") / 2**i), F.lit(2))).cast("double").alias(f"x{i}") for i in range(5)], (F.col("id") % 2).cast("int").alias("y"))
    enc = encode(df, "y", [f"x{i}" for i in range(5)])
    assert enc.collapsed and enc.df.count() <= 64 and enc.df.agg(F.sum("w")).first()[0] == 5000


def test_look_ahead_interactions_and_compare(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 10, (3000, 3)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": (x[:, 0] <= x[:, 1]).astype(int)}))
    m = fit_tree(df, "y", ["x0", "x1", "x2"], FitConfig(family=HORN, max_depth=1, search_3d=False, allow_compare=True, use_interactions=True))
    root = m.nodes[(0, 1)].rule
    assert root.label() == "COMPARE_LE" and {root.literals[0].feature, root.literals[0].feature2} == {0, 1}
    assert accuracy(score_rows(df, m), "pred", "y").first()[0] == 1.0
    ahead = fit_tree(df, "y", ["x0", "x1", "x2"], FitConfig(family=HORN, max_depth=2, search_3d=False, look_ahead=True))
    assert ahead.nodes[(0, 1)].rule is not None


def test_strict_family_refuses_any(or2):
    with pytest.raises(ValueError):
        fit_tree(or2, "y", LINE_FEATURES, FitConfig(family=ANY, strict_family=True))


def test_pruning_against_brute_force(spark, or2, tree):
    m = TreeModel.from_frame(tree.frame(spark), LINE_FEATURES)
    leaves = or2.select("y", m.leaf_column().alias("leaf"), (m.proba_column() >= 0.5).cast("int").alias("p")).toPandas()
    for r in node_errors(or2, m, "y").collect():
        k = r["node_id"]
        below = lambda l: l.bit_length() >= k.bit_length() and (l >> (l.bit_length() - k.bit_length())) == k
        inside = leaves[[below(int(l)) for l in leaves.leaf]]
        assert r["n"] == len(inside) and r["subtree_errors"] == (inside.p != inside.y).sum()
        assert r["leaf_errors"] == (inside.y != int(m.nodes[(0, k)].proba >= 0.5)).sum()
    pruned = prune(m, or2, "y", alpha=1.0)
    assert len(pruned.nodes) == 1


def test_model_round_trip(spark, or2, tree, tmp_path):
    save_model(spark, tree, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    diff = score_rows(or2, tree).select("rk", "proba").exceptAll(score_rows(or2, back).select("rk", "proba"))
    assert diff.count() == 0


def test_scoring_a_stream(spark, sf, tree, tmp_path):
    src = str(tmp_path / "in")
    line_task(spark, sf, "or2").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = score_rows(stream, tree).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from scored").count() == spark.read.parquet(src).count()


def test_forest(spark, or2):
    f = fit_forest(or2, "y", LINE_FEATURES, "rk", 5, 4, FitConfig(max_depth=2, n_bins=16, search_3d=False))
    assert f.trees.tree_ids == list(range(5)) and all(len(s) == 4 for s in f.subsets)
    for t in f.trees.tree_ids:
        used = {x for n in f.trees.splits(t) for x in n.rule.features}
        assert used <= set(f.subsets[t])
        n = or2.agg(F.sum(f.weight_column(t))).first()[0]
        assert f.trees.nodes[(t, 1)].n == n
    oob = oob_scores(or2, f, "y").first()
    assert oob["n_oob"] > 0 and oob["oob_accuracy"] > 0.8
    assert accuracy(score_forest(or2, f), "pred", "y").first()[0] > 0.8


def test_boosting_matches_replay(spark, or2):
    m = fit_boosting(or2, "y", LINE_FEATURES, "rk", n_rounds=5, learning_rate=0.5, refresh=2)
    assert len(m.stumps) == 5 and m.train_losses == sorted(m.train_losses, reverse=True)
    from rulespire.functions.hashing import unit_hash
    from rulespire.functions.scores import log_loss

    train = or2.filter(unit_hash(42, "bval", F.col("rk")) >= 0.15)
    loss = train.agg(F.avg(log_loss(F.col("y"), m.proba_column(False)))).first()[0]
    assert loss == pytest.approx(m.train_losses[-1], abs=1e-9)
    assert sum(m.importance().values()) == pytest.approx(1.0)


def test_facade(spark, or2):
    with pytest.raises(RuntimeError):
        RuleClassifier(LINE_FEATURES).predict(or2)
    with pytest.raises(ValueError):
        RuleClassifier(LINE_FEATURES, model_type="other")
    with pytest.raises(ValueError):
        RuleClassifier(LINE_FEATURES, family=ANY, strict_family=True).fit(or2)
    assert [choose_model(n) for n in (100, 1000, 5000)] == ["single", "forest", "boosting"]
    clf = RuleClassifier(LINE_FEATURES, model_type="single", max_depth=2, n_bins=16, calibration_method="isotonic").fit(or2)
    assert clf.score(or2) > 0.9 and clf.summary()["n_nodes"] == len(clf.model_.nodes)
    assert clf.explain(or2).filter("axp_len > 2").count() == 0


def test_refuses_bad_values(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 0)], "x double, y int")
    with pytest.raises(ValueError, match="nans"):
        RuleClassifier(["x"]).fit(df)


def test_width_settings():
    assert (for_width(600).n_bins, for_width(600).search_3d, for_width(600).top_k) == (16, False, 10)
    assert for_width(40, 2).n_bins == 8 and for_width(60).search_3d is False


def test_rule_shapes():
    with pytest.raises(ValueError):
        Rule.of("or", HORN, Literal(0, "GE", 1.0), Literal(1, "GE", 1.0)).check()
    with pytest.raises(ValueError):
        Rule.of("and", HORN, Literal(0, "GE", 1.0)).check()
    assert Rule.of("or", ANTIHORN, Literal(0, "GE", 1.0), Literal(1, "LT", 1.0)).label() == "AH_2L_NEG_1"


def test_monotone_fit_equals_a_sorted_pass(spark):
    from rulespire.operators.calibrate import monotone_fit

    rng = np.random.default_rng(8)
    p = np.round(rng.random(4000), 3)
    y = (rng.random(4000) < np.clip(p + rng.normal(0, 0.3, 4000), 0, 1)).astype(int)
    blocks = []
    for v, g in sorted(pd.DataFrame({"p": p, "y": y}).groupby("p")):
        blocks.append([v, v, len(g), int(g.y.sum())])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + n, blocks[-1][3] + k]
    got = monotone_fit(spark.createDataFrame(pd.DataFrame({"p": p, "y": y})).repartition(7), "p", "y").orderBy("lo").collect()
    assert [(r["lo"], r["hi"], r["n"]) for r in got] == [(lo, hi, n) for lo, hi, n, _ in blocks]
    assert [r["rate"] for r in got] == pytest.approx([k / n for _, _, n, k in blocks]) and len(got) > 5
