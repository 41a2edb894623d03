"""Fitted trees: a driver-side table of nodes that turns into Column expressions.

Node ids are heap ids: the root is 1, the true child of n is 2n, the false child 2n + 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulespire.functions.rules import Rule
from rulespire.plans.walk import leaves_of, proba_of

NODE_SCHEMA = (
    "tree_id int, node_id bigint, depth int, n double, n_pos double, n_neg double, proba double, is_leaf boolean, "
    "stop_reason string, family string, requested_family string, pattern string, arity int, gain double, "
    "combine string, lits array<struct<clause:int,feature:int,op:string,threshold:double,feature2:int>>"
)
CASE_LIMIT = 200  # splits of one tree; above it rows are walked by a node table


@dataclass
class Node:
    tree_id: int
    node_id: int
    n_pos: float
    n_neg: float
    proba: float
    rule: Rule | None = None
    stop_reason: str = ""
    requested: str = ""

    @property
    def depth(self) -> int:
        return self.node_id.bit_length() - 1

    @property
    def n(self) -> float:
        return self.n_pos + self.n_neg

    def to_row(self) -> dict:
        r = self.rule.to_row() if self.rule else {"combine": None, "family": None, "lits": []}
        return {
            "tree_id": self.tree_id, "node_id": self.node_id, "depth": self.depth, "n": float(self.n),
            "n_pos": float(self.n_pos), "n_neg": float(self.n_neg), "proba": float(self.proba),
            "is_leaf": self.rule is None, "stop_reason": self.stop_reason, "family": r["family"],
            "requested_family": self.requested, "pattern": self.rule.label() if self.rule else None,
            "arity": self.rule.arity if self.rule else 0, "gain": float(self.rule.gain) if self.rule else 0.0,
            "combine": r["combine"], "lits": r["lits"],
        }


@dataclass
class TreeModel:
    """One tree or many; ``features`` names the columns behind the literal indexes."""

    features: list[str]
    nodes: dict[tuple[int, int], Node] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    @property
    def tree_ids(self) -> list[int]:
        return sorted({t for t, _ in self.nodes})

    def splits(self, tree: int = 0) -> list[Node]:
        return [n for (t, _), n in sorted(self.nodes.items()) if t == tree and n.rule]

    def leaves(self, tree: int = 0) -> list[Node]:
        return [n for (t, _), n in sorted(self.nodes.items()) if t == tree and not n.rule]

    def columns(self) -> list[Column]:
        return [F.col(f) for f in self.features]

    def _walk(self, tree: int, node: int, value, cols: list[Column]) -> Column:
        here = self.nodes[(tree, node)]
        if here.rule is None:
            return value(here)
        return F.when(here.rule.column(cols), self._walk(tree, 2 * node, value, cols)).otherwise(
            self._walk(tree, 2 * node + 1, value, cols))

    def leaf_column(self, tree: int = 0, cols: list[Column] | None = None) -> Column:
        """Leaf id of a row as one CASE expression."""
        return self._walk(tree, 1, lambda n: F.lit(n.node_id).cast("bigint"), cols or self.columns())

    def proba_column(self, tree: int = 0, cols: list[Column] | None = None) -> Column:
        return self._walk(tree, 1, lambda n: F.lit(float(n.proba)), cols or self.columns())

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([n.to_row() for _, n in sorted(self.nodes.items())], NODE_SCHEMA)

    @staticmethod
    def from_frame(nodes: DataFrame, features: list[str]) -> "TreeModel":
        """Rebuild a model from its (model-sized) node table."""
        model = TreeModel(list(features))
        for r in nodes.collect():
            row = r.asDict(recursive=True)
            rule = None if row["is_leaf"] else Rule.from_row(row)
            model.nodes[(row["tree_id"], row["node_id"])] = Node(
                row["tree_id"], row["node_id"], row["n_pos"], row["n_neg"], row["proba"], rule,
                row["stop_reason"], row["requested_family"])
        return model

    def collapse(self, tree: int, node: int) -> None:
        """Turn a node into a leaf and drop everything below it."""
        self.nodes[(tree, node)].rule = None
        self.nodes[(tree, node)].stop_reason = "PRUNED"
        below = [k for k in self.nodes if k[0] == tree and k[1] > node and (k[1] >> (k[1].bit_length() - node.bit_length())) == node]
        for k in below:
            del self.nodes[k]


def score_rows(df: DataFrame, model: TreeModel, proba: str = "proba", pred: str = "pred", leaf: str | None = None) -> DataFrame:
    """Add probability and class. Works unchanged on a streaming DataFrame.

    One small tree is a CASE expression; forests and larger trees are walked by their node table.
    """
    one = len(model.tree_ids) == 1
    if one and len(model.splits(model.tree_ids[0])) <= CASE_LIMIT:
        out = df.withColumn(proba, model.proba_column(model.tree_ids[0]))
        out = out.withColumn(leaf, model.leaf_column(model.tree_ids[0])) if leaf else out
    else:
        out = df.withColumn(proba, proba_of(df.sparkSession, model))
        out = out.withColumn(leaf, leaves_of(df.sparkSession, model)[0]) if leaf else out
    return out.withColumn(pred, (F.col(proba) >= 0.5).cast("int"))


def decision_trace(leaf: Column) -> Column:
    """Node ids from the root to the leaf (heap ids halve on the way up)."""
    depth = F.length(F.bin(leaf)) - 1
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftrightunsigned", leaf, k.cast("int")))


def accuracy(df: DataFrame, pred: str, y: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(pred) == F.col(y)).cast("double")).alias("accuracy"))


# --- queries on node tables --------------------------------------------------------


def tree_summary(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_leaf").alias("n_leaves"),
        F.count_if(~F.col("is_leaf")).alias("n_internal"), F.max("depth").alias("max_depth"))


def structure_metrics(nodes: DataFrame, keys: list[str]) -> DataFrame:
    leaf, split = F.col("is_leaf"), ~F.col("is_leaf")
    return nodes.groupBy(*keys).agg(
        F.count_if(leaf).alias("n_leaves"),
        F.max(F.when(leaf, F.col("depth"))).alias("max_leaf_depth"),
        F.avg(F.when(leaf, F.col("depth"))).alias("avg_leaf_depth"),
        F.coalesce(F.avg(F.when(split, F.col("arity"))), F.lit(0.0)).alias("avg_arity"),
        F.coalesce(F.max(F.when(split, F.col("arity"))), F.lit(0)).alias("max_arity"),
        F.coalesce(F.sum(F.when(split, F.size("lits"))), F.lit(0)).alias("total_literals"))


def split_counters(nodes: DataFrame, keys: list[str], by: str) -> DataFrame:
    return nodes.filter(~F.col("is_leaf")).groupBy(*keys, by).agg(F.count(F.lit(1)).alias("n_splits"))


def importance(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """gain / arity credited to every feature of a split, normalized per key."""
    from pyspark.sql import Window as W

    used = nodes.filter(~F.col("is_leaf")).select(
        *keys, (F.col("gain") / F.col("arity")).alias("g"),
        F.explode(F.array_distinct(F.transform("lits", lambda l: l.feature))).alias("feature"))
    per = used.groupBy(*keys, "feature").agg(F.sum("g").alias("g"))
    total = F.sum("g").over(W.partitionBy(*keys)) if keys else F.sum("g").over(W.partitionBy(F.lit(0)))
    return per.select(*keys, "feature", F.when(total > 0, F.col("g") / total).otherwise(F.col("g")).alias("importance"))


def root_paths(nodes: DataFrame, max_depth: int) -> DataFrame:
    """(tree_id, leaf_id, step, node_id, taken): every leaf with its ancestors.

    Heap ids make ancestors arithmetic, so one explode and one join on (tree, node)
    replace a recursion.
    """
    leaves = nodes.filter("is_leaf").select("tree_id", F.col("node_id").alias("leaf_id"))
    depth = F.length(F.bin("leaf_id")) - 1
    step = F.explode(F.when(depth > 0, F.sequence(F.lit(0), (depth - 1).cast("int"))))
    rows = leaves.withColumn("step", step)
    shift = (F.length(F.bin("leaf_id")) - 1 - F.col("step")).cast("int")
    node = F.call_function("shiftright", F.col("leaf_id"), shift)
    child = F.call_function("shiftright", F.col("leaf_id"), (shift - 1).cast("int"))
    return rows.select("tree_id", "leaf_id", "step", node.alias("node_id"), (child % 2 == 0).alias("taken"))


def path_bounds(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, feature, lo, hi): intervals that the false branches above a node leave of its features.

    Heap ids make ancestors arithmetic: a node meets the false branch of every ancestor whose child on its path is odd.
    """
    length = F.length(F.bin("node_id"))
    above = F.explode(F.when(length > 1, F.sequence(F.lit(1), (length - 1).cast("int"))))
    child = F.call_function("shiftright", F.col("node_id"), (F.col("up") - 1).cast("int"))
    rows = nodes.select("tree_id", "node_id", above.alias("up")).filter(child % 2 == 1)
    rows = rows.select("tree_id", "node_id", F.call_function("shiftright", F.col("node_id"), F.col("up").cast("int")).alias("ancestor"))
    rules = nodes.filter("not is_leaf and combine <> 'xor'").select(F.col("tree_id").alias("t_"), F.col("node_id").alias("a_"), F.inline("lits"))
    met = rows.join(rules, (F.col("tree_id") == F.col("t_")) & (F.col("ancestor") == F.col("a_")))
    side = lambda op: F.when(F.col("op") == op, F.col("threshold"))
    return met.groupBy("tree_id", "node_id", "feature").agg(F.max(side("LT")).alias("lo"), F.min(side("GE")).alias("hi"))
