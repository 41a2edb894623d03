"""Paths of a tree as boxes: per-feature half-open intervals.

Works on tables of rules, so the boxes of many trees come out of one query:
``rules(tree_id, node_id, combine, lits)`` plus ``leaves(tree_id, node_id, proba)``.
A branch of a rule is a set of alternatives; a path is a product of alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulespire.functions.rules import literal_interval, negated



def _pos(l: Column) -> Column:
    return literal_interval(l)


def _neg(l: Column) -> Column:
    return literal_interval(negated(l))


def branch_alternatives(combine: Column, lits: Column, taken: bool) -> Column:
    """array<array<struct<feature,lo,hi>>>: ways to take (or miss) the rule."""
    each = lambda f: F.transform(lits, lambda l: F.array(f(l)))
    together = lambda f: F.array(F.transform(lits, f))
    disjunction = each(_pos) if taken else together(_neg)
    conjunction = together(_pos) if taken else each(_neg)
    masks = F.filter(
        F.sequence(F.lit(0), F.pow(F.lit(2), F.size(lits)).cast("int") - 1),
        lambda m: F.pmod(F.bit_count(m), F.lit(2)) == (1 if taken else 0))
    on = lambda m, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1
    parity = F.transform(masks, lambda m: F.transform(lits, lambda l, i: F.when(on(m, i), _pos(l)).otherwise(_neg(l))))
    ids = F.array_sort(F.array_distinct(F.transform(lits, lambda l: l.clause)))
    clause = lambda c: F.filter(lits, lambda l: l.clause == c)
    seed = F.array(F.filter(F.transform(lits, _pos), lambda _: F.lit(False)))
    if taken:
        cnf = F.aggregate(ids, seed, lambda acc, c: F.flatten(F.transform(
            acc, lambda a: F.transform(clause(c), lambda l: F.concat(a, F.array(_pos(l)))))))
    else:
        cnf = F.transform(ids, lambda c: F.transform(clause(c), _neg))
    return F.when(combine == "or", disjunction).when(combine == "and", conjunction).when(combine == "xor", parity).otherwise(cnf)


def merge_box(cond: Column) -> Column:
    """One interval per feature, in feature order."""
    feats = F.array_sort(F.array_distinct(F.transform(cond, lambda c: c.feature)))
    mine = lambda f: F.filter(cond, lambda c: c.feature == f)
    return F.transform(feats, lambda f: F.struct(
        f.alias("feature"),
        F.array_max(F.transform(mine(f), lambda c: c.lo)).alias("lo"),
        F.array_min(F.transform(mine(f), lambda c: c.hi)).alias("hi")))


def path_boxes(rules: DataFrame, leaves: DataFrame, max_depth: int) -> DataFrame:
    """(tree_id, leaf_id, y_leaf, box array<struct<feature,lo,hi>>): reachable boxes of all leaves.

    One join per level on (tree, node); empty boxes and duplicates are dropped on the way.
    """
    alts = rules.select(
        "tree_id", "node_id",
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), branch_alternatives(F.col("combine"), F.col("lits"), True).alias("alts")),
            F.struct(F.lit(1).alias("side"), branch_alternatives(F.col("combine"), F.col("lits"), False).alias("alts")))).alias("b"),
    ).select("tree_id", "node_id", (F.col("node_id") * 2 + F.col("b.side")).alias("child"), F.explode("b.alts").alias("alt"))
    empty = F.filter(F.array(F.struct(F.lit(0).alias("feature"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))), lambda _: F.lit(False))
    front = rules.select("tree_id").union(leaves.select("tree_id")).distinct().select("tree_id", F.lit(1).cast("bigint").alias("node_id"), empty.alias("box"))
    out = front
    for _ in range(max_depth):
        front = (
            front.join(alts, ["tree_id", "node_id"])
            .select("tree_id", F.col("child").alias("node_id"), merge_box(F.concat("box", "alt")).alias("box"))
            .filter(F.forall("box", lambda c: c.lo < c.hi)).distinct()
        )
        out = out.unionByName(front)
    return out.join(leaves.select("tree_id", "node_id", "proba"), ["tree_id", "node_id"]).select(
        "tree_id", F.col("node_id").alias("leaf_id"), (F.col("proba") >= 0.5).cast("int").alias("y_leaf"), "box")
