"""Validation pruning of fitted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulespire.plans.model import TreeModel


def node_errors(df: DataFrame, model: TreeModel, y: str, tree: int = 0, keys: list[str] = ()) -> DataFrame:
    """Validation rows, own errors (as a leaf) and errors of the subtree for every node.

    One pass: rows are added up per leaf, then the few leaf rows are credited to all
    their ancestors.
    """
    pred = (model.proba_column(tree) >= 0.5).cast("int")
    rows = df.select(*keys, F.col(y).alias("__y"), model.leaf_column(tree).alias("leaf_id"), pred.alias("__p"))
    leaves = rows.groupBy(*keys, "leaf_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__y") == 1).alias("pos"), F.count_if(F.col("__y") != F.col("__p")).alias("err"))
    depth = (F.length(F.bin("leaf_id")) - 1).cast("int")
    up = leaves.withColumn("node_id", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.floor(F.col("leaf_id") / F.pow(F.lit(2), k)))))
    own = [(n.node_id, int(n.proba >= 0.5)) for (t, _), n in sorted(model.nodes.items()) if t == tree]
    classes = df.sparkSession.createDataFrame(own, "node_id bigint, cls int")
    per = up.groupBy(*keys, "node_id").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("err").alias("subtree_errors"))
    return per.join(F.broadcast(classes), "node_id").select(
        *keys, "node_id", "n", F.when(F.col("cls") == 1, F.col("n") - F.col("pos")).otherwise(F.col("pos")).alias("leaf_errors"), "subtree_errors")


def prune(model: TreeModel, df: DataFrame, y: str, alpha: float = 0.01, tree: int = 0) -> TreeModel:
    """Bottom-up: a node becomes a leaf when leaf error + a <= subtree error + a * leaves.

    Nodes without validation rows stay as they are. The rows are read once; the walk
    over nodes is driver work on a model-sized table.
    """
    stats = {r["node_id"]: r for r in node_errors(df, model, y, tree).collect()}

    def walk(node: int) -> tuple[float, int]:
        here = model.nodes[(tree, node)]
        s = stats.get(node)
        own = float(s["leaf_errors"]) if s else 0.0
        if here.rule is None:
            return own, 1
        (e1, l1), (e2, l2) = walk(2 * node), walk(2 * node + 1)
        errors, leaves = e1 + e2, l1 + l2
        if s and own / s["n"] + alpha <= errors / s["n"] + alpha * leaves:
            model.collapse(tree, node)
            return own, 1
        return errors, leaves

    walk(1)
    return model
