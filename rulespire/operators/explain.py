"""Minimal sufficient feature sets of every row (abductive explanations) and audits.

A feature set S forces the prediction iff no row that agrees on S reaches a leaf of the other class
(``operators/reach.py``). Deleting features one by one in column order while that holds gives a
subset-minimal set. Rows with equal threshold bits share their answer: each distinct signature is
answered once, in Arrow batches, and joined back.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType

from rulespire.operators.boxes import path_boxes
from rulespire.operators.reach import Reach
from rulespire.plans.model import TreeModel
from rulespire.session import ship_package


def leaf_boxes(spark, model: TreeModel, tree: int = 0) -> DataFrame:
    """Boxes of every leaf of one tree as a table."""
    nodes = model.frame(spark).filter(F.col("tree_id") == tree)
    if nodes.filter(F.exists("lits", lambda l: l.feature2.isNotNull())).count():
        raise NotImplementedError("column-against-column tests have no boxes")
    rules = nodes.filter("not is_leaf").select("tree_id", "node_id", "combine", F.transform("lits", lambda l: F.struct(
        l.clause.alias("clause"), l.feature.alias("feature"), l.op.alias("op"), l.threshold.alias("threshold"))).alias("lits"))
    depth = max((n.depth for n in model.leaves(tree)), default=0)
    return path_boxes(rules, nodes.filter("is_leaf"), depth)


def used_features(model: TreeModel, tree: int = 0) -> list[int]:
    return sorted({f for n in model.splits(tree) for f in n.rule.features})


def signature(model: TreeModel, used: list[int], cols: list[Column], tree: int = 0) -> Column:
    """Truth of every distinct threshold of the tree; rows that agree get one answer."""
    atoms = sorted({(l.feature, l.threshold) for n in model.splits(tree) for l in n.rule.literals})
    words = []
    for i in range(0, len(atoms), 60):
        word = F.lit(0).cast("bigint")
        for k, (f, t) in enumerate(atoms[i:i + 60]):
            word = word + F.when(cols[f] >= t, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")
        words.append(word)
    return F.array(*words)


def _known_values(row: list) -> list[float]:
    """NULL fails every ``>=`` test and NaN passes it, as in SQL."""
    return [-math.inf if v is None else math.inf if v != v else v for v in row]


def _answer(df: DataFrame, model: TreeModel, tree: int, given: dict[str, Column], fn, out: dict) -> DataFrame:
    """Distinct (signature, given) with the values of ``fn(reach, values, used, *given)`` in the columns ``out``."""
    spark, used, reach = df.sparkSession, used_features(model, tree), Reach(model, tree)
    width = max(used, default=-1) + 1
    ship_package(spark)
    values = [F.min(F.col(model.features[f]).cast("double")).alias(f"__v{f}") for f in used]
    cases = df.withColumn("__sig", signature(model, used, model.columns(), tree)).withColumns({f"__g{k}": c for k, c in enumerate(given.values())})
    keys = ["__sig", *[f"__g{k}" for k in range(len(given))]]
    cases = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *values)
    cases = cases.select(*keys, "__n", F.array(*[F.col(f"__v{f}") for f in used]).cast("array<double>").alias("__x"))
    schema = cases.select(*keys, "__n").schema
    for name, (kind, _) in out.items():
        schema = schema.add(name, kind)

    def run(batches):
        for b in batches:
            rows = []
            columns = [c.to_pylist() for c in b.columns]
            for *case, _, some in zip(*columns):
                x = [-math.inf] * width
                for f, v in zip(used, _known_values(some)):
                    x[f] = v
                rows.append(fn(reach, x, used, *case[1:]))
            got = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *got], schema.names)

    return cases.mapInArrow(run, schema)


def _with_answer(df: DataFrame, model: TreeModel, tree: int, given: dict[str, Column], fn, out) -> DataFrame:
    answers = _answer(df, model, tree, given, fn, out).drop("__n")
    keyed = df.withColumn("__sig", signature(model, used_features(model, tree), model.columns(), tree)).withColumns({f"__g{k}": c for k, c in enumerate(given.values())})
    keys = ["__sig", *[f"__g{k}" for k in range(len(given))]]
    return keyed.join(answers, keys).select(*df.columns, *out)


_INTS = (ArrayType(IntegerType()), pa.list_(pa.int32()))


def explain_rows(df: DataFrame, model: TreeModel, tree: int = 0) -> DataFrame:
    """Add y_pred, axp (feature indexes) and axp_len to every row."""
    if not used_features(model, tree):
        none = df.withColumn("y_pred", F.lit(int(model.nodes[(tree, 1)].proba >= 0.5)))
        return none.withColumn("axp", F.array().cast("array<int>")).withColumn("axp_len", F.lit(0))

    def fn(reach, x, used):
        cls = reach.predict(x)
        return cls, reach.minimal(x, cls, used)

    out = _with_answer(df, model, tree, {}, fn, {"y_pred": (IntegerType(), pa.int32()), "axp": _INTS})
    return out.withColumn("axp_len", F.size("axp"))


def sufficient_rows(df: DataFrame, model: TreeModel, s: Column, tree: int = 0, out: str = "sufficient") -> DataFrame:
    """Whether the feature indexes in ``s`` force each row's prediction."""
    def fn(reach, x, used, s):
        return (reach.sufficient(x, set(s), reach.predict(x)),)
    return _with_answer(df, model, tree, {"s": s}, fn, {out: (BooleanType(), pa.bool_())})


def reachable_leaves(df: DataFrame, model: TreeModel, s: Column, tree: int = 0, out: str = "reachable") -> DataFrame:
    """Leaves some row can reach that agrees with this one on the features in ``s``."""
    def fn(reach, x, used, s):
        return (sorted(reach.leaves(x, set(s))),)
    return _with_answer(df, model, tree, {"s": s}, fn, {out: (ArrayType(LongType()), pa.list_(pa.int64()))})


def reading_features(model: TreeModel, tree: int = 0) -> Column:
    """Features a reader of the path needs: the first true literal where a rule holds, all where not."""
    cols = model.columns()

    def walk(node: int, seen: Column) -> Column:
        here = model.nodes[(tree, node)]
        if here.rule is None:
            return F.array_distinct(seen)
        first = F.lit(None).cast("int")
        for lit in reversed(here.rule.literals):
            first = F.when(lit.column(cols), F.lit(lit.feature)).otherwise(first)
        taken = F.concat(seen, F.array(first))
        missed = F.concat(seen, F.array(*[F.lit(f) for f in here.rule.features]))
        return F.when(here.rule.column(cols), walk(2 * node, taken)).otherwise(walk(2 * node + 1, missed))

    return walk(1, F.array().cast("array<int>"))


def audit(explained: DataFrame, model: TreeModel, tree: int = 0) -> DataFrame:
    """Shares of rows whose explanation is sufficient and whose every element is needed."""
    def fn(reach, x, used, axp, cls):
        ok = reach.sufficient(x, set(axp), cls)
        return ok, ok and not any(reach.sufficient(x, set(axp) - {f}, cls) for f in axp)

    kind = (BooleanType(), pa.bool_())
    cases = _answer(explained, model, tree, {"axp": F.col("axp"), "cls": F.col("y_pred")}, fn, {"ok": kind, "needed": kind})
    share = lambda c: F.sum(F.when(F.col(c), F.col("__n")).otherwise(0)) / F.sum("__n")
    return cases.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("n_rows"), share("ok").alias("valid_rate"), share("needed").alias("minimal_rate"))


def participation(explained: DataFrame, keys: list[str]) -> DataFrame:
    """How often a feature is part of an explanation, as count and as share of rows."""
    rows = explained.withColumn("__all", F.lit(0))
    by = ["__all", *keys]
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    hit = rows.select(*by, F.explode("axp").alias("feature")).groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n_rows"))
    return hit.join(n, by).select(*keys, "feature", "n_rows", (F.col("n_rows") / F.col("__n")).alias("rate"))
