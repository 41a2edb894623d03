"""Scoring by the node table against CASE expressions."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rulespire.config import FitConfig
from rulespire.functions.rules import AFFINE, ANTIHORN, CONJUI, HORN, SQUARE2CNF, Literal, Rule
from rulespire.plans.forest import fit_forest
from rulespire.plans.model import Node, TreeModel, accuracy, score_rows
from rulespire.plans.walk import leaves_of, proba_of, probas_of
from rulespire.sources.tables import LINE_FEATURES, line_task

FEATURES = ["a", "b", "c", "unused"]


def random_rule(draw):
    lit = lambda: Literal(draw.randrange(3), draw.choice(["GE", "LT"]), draw.randrange(9) / 2)
    kind = draw.randrange(5)
    if kind == 0:
        return Rule.of("or", HORN, Literal(0, draw.choice(["LE", "GT", "GE", "LT"]), 0.0, 1))
    if kind == 1:
        return Rule("cnf", ((lit(), lit()), (lit(), lit())), SQUARE2CNF)
    return Rule.of(*[("or", ANTIHORN), ("and", CONJUI), ("xor", AFFINE)][kind - 2], *[lit() for _ in range(draw.randrange(1, 4))])


def random_model(draw, trees, depth):
    m = TreeModel(FEATURES)

    def grow(t, node):
        leaf = node.bit_length() > depth or (node > 1 and draw.random() < 0.3)
        m.nodes[(t, node)] = Node(t, node, 0, 0, draw.random(), None if leaf else random_rule(draw))
        if not leaf:
            grow(t, 2 * node)
            grow(t, 2 * node + 1)

    for t in range(trees):
        grow(t, 1)
    return m


def test_walk_equals_case(spark):
    draw = random.Random(4)
    x = np.random.default_rng(4).integers(0, 9, (800, 4)) / 2
    df = spark.createDataFrame(pd.DataFrame(x, columns=FEATURES)).withColumn("row", F.monotonically_increasing_id())
    for trees, depth in ((1, 4), (5, 3), (3, 0)):
        m = random_model(draw, trees, depth)
        both = df.select("row", proba_of(spark, m).alias("p"), probas_of(spark, m).alias("ps"), leaves_of(spark, m).alias("ls"),
                         F.array(*[m.proba_column(t) for t in range(trees)]).alias("ps_"), F.array(*[m.leaf_column(t) for t in range(trees)]).alias("ls_"))
        mean = F.aggregate("ps_", F.lit(0.0), lambda a, v: a + v) / trees
        assert both.filter((F.col("ps") != F.col("ps_")) | (F.col("ls") != F.col("ls_")) | (F.abs(F.col("p") - mean) > 1e-12)).count() == 0


def test_deep_forest(spark):
    df = line_task(spark, "/root/testdata/sf0.001", "cnf4")
    f = fit_forest(df, "y", LINE_FEATURES, "rk", 20, 4, FitConfig(max_depth=10, n_bins=40, search_3d=False))
    assert len(f.trees.tree_ids) == 20 and max(n.depth for n in f.trees.nodes.values()) >= 8
    scored = score_rows(df, f.trees, leaf="leaf")
    assert accuracy(scored, "pred", "y").first()[0] > 0.9
    assert scored.withColumn("case", f.trees.leaf_column(0)).filter("leaf <> case").count() == 0
