"""Leaves of large models from a node table, whatever the number of trees and splits.

The splits of all trees are a few flat arrays: features, thresholds and operators of at most ``TESTS`` tests, how
they combine, and the places of both children. A batch of rows takes one step down per level: all rows of a tree read the
tests of the node they are at and move on together. So the work is rows x trees x depth, and no expression grows with
the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from rulespire.session import ship_package

#: Tests of a rule: two clauses of two, or up to three.
TESTS = 4
_OPS = {"GE": 0, "LT": 1, "LE": 2, "GT": 3}
_OR, _AND, _XOR, _CNF = range(4)


@dataclass
class NodeTable:
    used: list[int]  # features that the splits read
    roots: np.ndarray  # [tree]
    feature: np.ndarray  # [test, node], places in ``used``
    other: np.ndarray  # the same for tests against a column, -1 else
    threshold: np.ndarray
    op: np.ndarray
    filled: np.ndarray  # whether there is such a test
    combine: np.ndarray
    child: np.ndarray  # [false or true, node]; -1 at leaves
    proba: np.ndarray
    node_id: np.ndarray
    depth: int

    @staticmethod
    def of(model) -> "NodeTable":
        keys = sorted(model.nodes)
        at = {k: i for i, k in enumerate(keys)}
        rules = [model.nodes[k].rule for k in keys]
        used = sorted({f for r in rules if r for f in r.features})
        place = {f: i for i, f in enumerate(used)}
        n = len(keys)
        feature, other, op = (np.full((TESTS, n), v) for v in (0, -1, 0))
        threshold, filled = np.zeros((TESTS, n)), np.zeros((TESTS, n), bool)
        combine, child = np.zeros(n, int), np.full((2, n), -1)
        for i, (key, rule) in enumerate(zip(keys, rules)):
            if rule is None:
                continue
            combine[i] = {"or": _OR, "and": _AND, "xor": _XOR, "cnf": _CNF}[rule.combine]
            # a conjunction of clauses has its two tests in places 0, 1 and 2, 3
            for k, l in enumerate(rule.literals):
                feature[k, i], threshold[k, i], op[k, i], filled[k, i] = place[l.feature], l.threshold, _OPS[l.op], True
                other[k, i] = -1 if l.feature2 is None else place[l.feature2]
            tree, node = key
            child[:, i] = at[(tree, 2 * node + 1)], at[(tree, 2 * node)]
        roots = np.array([at[(t, 1)] for t in model.tree_ids])
        return NodeTable(used, roots, feature, other, threshold, op, filled, combine, child, np.array([float(model.nodes[k].proba) for k in keys]),
                         np.array([k[1] for k in keys]), max(model.nodes[k].depth for k in keys))

    def truth(self, x: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        tests = []
        for k in range(TESTS):
            if not self.filled[k].any():
                break
            left, right = x[self.feature[k, node], rows], self.threshold[k, node]
            if (self.other[k] >= 0).any():
                right = np.where(self.other[k, node] >= 0, x[self.other[k, node], rows], right)
            op = self.op[k, node]
            true = np.where(op < 2, np.where(op == 0, left >= right, left < right), np.where(op == 2, left <= right, left > right))
            tests.append((true, self.filled[k, node]))
        how = self.combine[node]
        any_ = np.logical_or.reduce([t & f for t, f in tests])
        all_ = np.logical_and.reduce([t | ~f for t, f in tests])
        odd = np.logical_xor.reduce([t & f for t, f in tests])
        out = np.where(how == _OR, any_, np.where(how == _AND, all_, odd))
        if (self.combine == _CNF).any():
            pairs = (tests[0][0] | tests[1][0]) & (tests[2][0] | tests[3][0])
            out = np.where(how == _CNF, pairs, out)
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """[tree, row] places of the leaves; x: [used feature, row]."""
        out = np.empty((len(self.roots), x.shape[1]), int)
        for t, root in enumerate(self.roots):
            node, rows = np.full(x.shape[1], root), np.arange(x.shape[1])
            for _ in range(self.depth):
                rows = rows[self.child[0, node[rows]] >= 0]
                if not len(rows):
                    break
                now = node[rows]
                node[rows] = self.child[self.truth(x, now, rows).astype(int), now]
            out[t] = node
        return out


def _columns(model, table: NodeTable) -> list[Column]:
    # a model of leaves alone reads no feature, but a function needs a row count
    return [F.col(model.features[f]).cast("double") for f in table.used] or [F.lit(0.0)]


def _matrix(values: tuple[pd.Series, ...]) -> np.ndarray:
    return np.stack([v.to_numpy(float) for v in values])


def proba_of(spark: SparkSession, model) -> Column:
    """Mean probability of the trees."""
    ship_package(spark)
    table = NodeTable.of(model)

    @F.pandas_udf("double")
    def mean(*x: pd.Series) -> pd.Series:
        return pd.Series(table.proba[table.leaves(_matrix(x))].mean(axis=0))

    return mean(*_columns(model, table))


def probas_of(spark: SparkSession, model) -> Column:
    """Probabilities of all trees as an array."""
    ship_package(spark)
    table = NodeTable.of(model)

    @F.pandas_udf("array<double>")
    def each(*x: pd.Series) -> pd.Series:
        return pd.Series(list(table.proba[table.leaves(_matrix(x))].T))

    return each(*_columns(model, table))


def leaves_of(spark: SparkSession, model) -> Column:
    """Leaf ids of all trees as an array."""
    ship_package(spark)
    table = NodeTable.of(model)

    @F.pandas_udf("array<long>")
    def each(*x: pd.Series) -> pd.Series:
        return pd.Series(list(table.node_id[table.leaves(_matrix(x))].T))

    return each(*_columns(model, table))
