"""Boxes and explanations against enumeration of all threshold cells."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rulespire.functions.rules import AFFINE, ANTIHORN, CONJUI, HORN, SQUARE2CNF, Literal, Rule
from rulespire.operators import certificates as K
from rulespire.operators import explain as E
from rulespire.plans.model import Node, TreeModel


def random_tree(rng, depth=3, d=4):
    """A random tree over d columns with thresholds 1, 2, 3."""
    m = TreeModel([f"x{i}" for i in range(d)])
    lit = lambda: Literal(rng.randrange(d), rng.choice(["GE", "LT"]), float(rng.randint(1, 3)))

    def rule():
        kind = rng.choice(["or", "and", "xor", "cnf"])
        if kind == "cnf":
            return Rule("cnf", ((lit(), lit()), (lit(), lit())), SQUARE2CNF)
        n = rng.randint(1, 3) if kind != "xor" else rng.randint(2, 3)
        return Rule.of(kind, {"or": "Any", "and": CONJUI, "xor": AFFINE}[kind], *[lit() for _ in range(n)])

    def grow(node, level):
        r = rule() if level < depth and rng.random() < 0.85 else None
        m.nodes[(0, node)] = Node(0, node, 0.0, 0.0, rng.choice([0.2, 0.8]), r)
        if r:
            grow(2 * node, level + 1)
            grow(2 * node + 1, level + 1)

    grow(1, 0)
    return m


@pytest.mark.parametrize("seed", range(3))
def test_explanations_equal_enumeration(spark, seed):
    m = random_tree(random.Random(seed))
    cells = pd.DataFrame([dict(zip(m.features, map(float, c))) for c in itertools.product(range(4), repeat=4)])
    df = spark.createDataFrame(cells).withColumn("cls", (m.proba_column() >= 0.5).cast("int"))
    truth = df.toPandas()
    table = {tuple(r[f] for f in m.features): r["cls"] for _, r in truth.iterrows()}

    def sufficient(x, s):
        return all(c == table[x] for z, c in table.items() if all(z[i] == x[i] for i in s))

    def deletion(x):
        s = set(range(4))
        for f in range(4):
            if sufficient(x, s - {f}):
                s -= {f}
        return sorted(s)

    for r in E.explain_rows(df, m).collect():
        x = tuple(r[f] for f in m.features)
        assert r["y_pred"] == table[x] and r["axp"] == deletion(x)


def deep_model(depth, width, seed=3):
    """A full tree of 3-literal rules over ``width`` features."""
    rng = random.Random(seed)
    m = TreeModel([f"x{i}" for i in range(width)], {})
    for node in range(1, 2 ** (depth + 1)):
        lits = [Literal(f, rng.choice(["GE", "LT"]), rng.choice([0.3, 0.5, 0.7])) for f in rng.sample(range(width), 3)]
        rule = Rule.of(rng.choice(["or", "and"]), HORN, *lits) if node < 2 ** depth else None
        m.nodes[(0, node)] = Node(0, node, 0.0, 0.0, rng.choice([0.2, 0.8]), rule)
    return m


def test_deep_tree_with_100_features(spark):
    """Every element is needed, every set suffices; no limit at 62 features."""
    m = deep_model(10, 100)
    rng = random.Random(1)
    rows = [[rng.random() for _ in m.features] for _ in range(200)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=m.features)).repartition(8)
    r = E.audit(E.explain_rows(df, m), m).first()
    assert tuple(r) == (200, 1.0, 1.0)


def test_chain_of_conjunctions(spark):
    """Each split that is missed has three ways to be missed; they are not multiplied out."""
    depth = 24
    m = TreeModel([f"x{i}" for i in range(3 * depth)], {})
    node = 1
    for k in range(depth):
        rule = Rule.of("and", HORN, *[Literal(3 * k + i, "GE", 0.5) for i in range(3)])
        m.nodes[(0, node)] = Node(0, node, 0.0, 0.0, 0.5, rule)
        m.nodes[(0, 2 * node)] = Node(0, 2 * node, 0.0, 0.0, 0.9)
        node = 2 * node + 1
    m.nodes[(0, node)] = Node(0, node, 0.0, 0.0, 0.1)
    df = spark.createDataFrame([tuple([0.0] * (3 * depth)), tuple([1.0] * (3 * depth))], [*m.features])
    got = {r["y_pred"]: r["axp_len"] for r in E.explain_rows(df, m).collect()}
    assert got == {0: depth, 1: 3}


def test_audit_rates_are_one(spark):
    m = random_tree(random.Random(8))
    cells = spark.createDataFrame(pd.DataFrame([dict(zip(m.features, map(float, c))) for c in itertools.product(range(4), repeat=4)]))
    r = E.audit(E.explain_rows(cells, m), m).first()
    assert (r["valid_rate"], r["minimal_rate"]) == (1.0, 1.0)


def test_single_class_tree_has_empty_explanation(spark):
    m = TreeModel(["x0"], {(0, 1): Node(0, 1, 3.0, 1.0, 0.7)})
    r = E.explain_rows(spark.createDataFrame([(1.0,)], "x0 double"), m).first()
    assert r["axp"] == [] and r["y_pred"] == 1


def test_complement_clauses_by_enumeration():
    rng = random.Random(1)
    for _ in range(200):
        lits = [Literal(rng.randrange(4), rng.choice(["GE", "LT"]), 1.0) for _ in range(4)]
        rule = Rule("cnf", ((lits[0], lits[1]), (lits[2], lits[3])), SQUARE2CNF)
        for x in itertools.product((0, 1), repeat=4):
            on = lambda l: (x[l.feature] >= l.threshold) == (l.op == "GE")
            holds = all(any(on(l) for l in c) for c in rule.clauses)
            for taken in (True, False):
                assert any(all(on(l) for l in alt) for alt in rule.branch(taken)) == (holds == taken)


def test_strict_mode_refuses_uncertified(spark):
    lit = lambda f, op: (0, f, op, 1.0)
    rows = [(1, 2, 0, 1, True, HORN, "or", [lit(0, "GE"), lit(1, "GE"), lit(2, "LT"), lit(3, "LT")]), (2, 2, 0, 1, True, HORN, "or", [lit(0, "GE"), lit(1, "LT")])]
    steps = spark.createDataFrame(rows, "tree_id int, leaf_id int, step int, node_id int, taken boolean, family string, combine string, lits array<struct<clause:int,feature:int,op:string,threshold:double>>")
    steps = steps.withColumn("family", F.when(F.col("tree_id") == 1, "Any").otherwise(F.col("family")))
    labels = K.backend_labels(steps)
    assert {r["tree_id"]: r["certificate"] for r in labels.collect()} == {1: "none", 2: "horn"}
    with pytest.raises(ValueError, match="uncertified"):
        K.require_certified(labels)
