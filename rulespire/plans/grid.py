"""Runs over (task, run, method, depth), family choice by folds, learning curves.

All runs or folds of all methods, and all fractions of a curve, are fitted together: rows are packed once and carry one
weight per run, a run of a method is a tree of one growth, and every count array has the nodes among its keys. Nodes that
hold the same rows in several methods are counted once. Smaller depths are the upper part of the deepest tree. All trees
are scored in one pass.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespire.config import FitConfig
from rulespire.operators.explain import explain_rows
from rulespire.functions.hashing import unit_hash
from rulespire.functions.rules import AFFINE, ANTIHORN, BEST, CONJUI, HORN, SQUARE2CNF
from rulespire.operators.sampling import k_folds, k_rows_of
from rulespire.operators.scan import last_by_hash
from rulespire.plans.encode import Encoded, encode
from rulespire.plans.grow import Grower
from rulespire.plans.model import Node, TreeModel, accuracy
from rulespire.plans.tensors import Scorer, hits, pack_values
from rulespire.plans.walk import probas_of

RESULT_SCHEMA = (
    "dataset string, method string, category string, depth int, run int, accuracy double, train_accuracy double, "
    "nodes double, leaves double, literals double, axp_len double, fit_sec double, error string"
)


#: Methods of a grid: category and settings. One-dimensional splits are Horn rules of one test.
METHODS = {
    "1D": ("main", FitConfig(family=HORN, search_2d=False, search_3d=False)),
    "Horn": ("main", FitConfig(family=HORN, search_3d=False)),
    "AntiHorn": ("main", FitConfig(family=ANTIHORN, search_3d=False)),
    "ConjUI": ("auxiliary", FitConfig(family=CONJUI, search_1d=False, search_3d=False)),
    "Square2CNF": ("main", FitConfig(family=SQUARE2CNF, search_1d=False, search_3d=False)),
    "Affine": ("auxiliary", FitConfig(family=AFFINE, search_1d=False, search_3d=False)),
    "BestPN": ("empirical", FitConfig(family=BEST)),
}


def axis_tree(train: DataFrame, label: str, features: list[str], depth: int = 7, min_leaf: int = 5):
    """Single-column baseline tree of pyspark.ml.

    With at least ``min_leaf`` rows in both children no node below 2 * ``min_leaf`` rows is split, which is the baseline's
    minimum of 10 rows at the default of 5.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="__v")
    data = assembler.transform(train).select(F.col(label).cast("double").alias("__label"), "__v")
    model = DecisionTreeClassifier(featuresCol="__v", labelCol="__label", maxDepth=depth, minInstancesPerNode=min_leaf).fit(data)
    return assembler, model


def axis_predict(df: DataFrame, fitted) -> DataFrame:
    assembler, model = fitted
    scored = model.transform(assembler.transform(df))
    return scored.withColumn("pred", F.col("prediction").cast("int")).withColumn(
        "proba", vector_to_array("probability")[1]).drop("__v", "prediction", "rawPrediction", "probability")


def axis_leaf_depths(model) -> list[int]:
    """Decisions above every leaf of the baseline, in the order of its leaf numbers (left to right, as in its text form)."""
    lines = model.toDebugString.splitlines()
    return [len(line) - len(line.lstrip(" ")) - 2 for line in lines if line.strip().startswith("Predict:")]


def axis_path_lengths(df: DataFrame, fitted, out: str = "path_length") -> DataFrame:
    """Add the number of decisions on each row's own path."""
    assembler, model = fitted
    depths = F.array(*[F.lit(d) for d in axis_leaf_depths(model)])
    scored = model.copy().setLeafCol("__leaf").transform(assembler.transform(df))
    return scored.withColumn(out, F.get(depths, F.col("__leaf").cast("int"))).select(*df.columns, out)


def fit_runs(df: DataFrame, label: str, features: list[str], weights: list[str], cfg: FitConfig) -> TreeModel:
    """One tree per column of ``weights`` (0 or 1: whether the row trains that run), all from the same jobs."""
    rows = df.withColumn("__ws", F.array(*[F.col(w).cast("tinyint") for w in weights]))
    enc = encode(rows, label, features, cfg.max_codes, keep=["__ws"], collapse=False, exact=True, cache=False)
    return Grower(enc, cfg, len(weights), weights="__ws").run()


@dataclass
class Packed:
    """Rows of a task as cached blocks, for the fits of all methods."""

    enc: Encoded
    blocks: DataFrame


@contextmanager
def packed_runs(df: DataFrame, label: str, features: list[str], weights: list[str], max_codes: int) -> Iterator[Packed]:
    """Encode and pack the rows once; ``weights`` (0 or 1: whether the row trains that run) go along."""
    rows = df.withColumn("__ws", F.array(*[F.col(w).cast("tinyint") for w in weights]))
    enc = encode(rows, label, features, max_codes, keep=["__ws"], collapse=False, exact=True, cache=False, values_only=True)
    blocks = pack_values(enc.df, features, enc.cuts, enc.raw, "__ws")
    try:
        yield Packed(enc, blocks)
    finally:
        blocks.unpersist()


def fit_methods(packed: Packed, cfgs: list[FitConfig], runs: int) -> Grower:
    """Trees of all methods and runs (tree = method * runs + run) from the same jobs.

    The methods differ in family and in which of single tests, pairs and triples they search. Nodes of several methods
    that hold the same rows are counted once.
    """
    grower = Grower(packed.enc, cfgs[0], len(cfgs) * runs, weights="__ws", cfgs=[cfg for cfg in cfgs for _ in range(runs)],
                    masks=[run for _ in cfgs for run in range(runs)], blocks=packed.blocks)
    grower.run()
    return grower


def alike(cfg: FitConfig) -> FitConfig:
    """Settings that methods of one growth must share."""
    return replace(cfg, family=BEST, search_1d=True, search_2d=True, search_3d=True)


def whole_tree(model: TreeModel, tree: int) -> dict[int, Node]:
    return {k: n for (t, k), n in model.nodes.items() if t == tree}


def method_accuracies(packed: Packed, grower: Grower, cells: list[tuple[int, int, dict[int, Node]]]) -> list[tuple[float, float]]:
    """(train, test) accuracy of every cell (tree, run, the tree's upper part) from one pass over the blocks."""
    scorer = Scorer(grower.code_rules, {}, grower.raw, grower.wide)
    positive = [(tree, run, [k for k, n in nodes.items() if n.rule is None and n.proba >= 0.5]) for tree, run, nodes in cells]
    return hits(packed.blocks, scorer, positive)


def local_rows(df: DataFrame, rows: list) -> DataFrame:
    """A few collected rows of a table as a table of one partition."""
    return df.sparkSession.createDataFrame(rows, df.schema).coalesce(1)


def upper_part(model: TreeModel, tree: int, depth: int) -> dict[int, Node]:
    """The tree that growth to ``depth`` gives, by node id."""
    out = {}
    for (t, k), n in model.nodes.items():
        if t == tree and n.depth < depth:
            out[k] = n
        elif t == tree and n.depth == depth:
            out[k] = replace(n, rule=None, stop_reason=n.stop_reason or "MAX_DEPTH")
    return out


def as_forest(features: list[str], trees: list[dict[int, Node]]) -> TreeModel:
    return TreeModel(list(features), {(t, k): replace(n, tree_id=t) for t, nodes in enumerate(trees) for k, n in nodes.items()})


def run_accuracies(df: DataFrame, label: str, forest: TreeModel, weights: list[str]) -> list[tuple[float, float]]:
    """(train, test) accuracy of every tree; tree t is trained where ``weights[t]`` is 1 and tested elsewhere."""
    hit = [((F.get(F.col("__ps"), F.lit(t)) >= 0.5).cast("int") == F.col(label)).cast("double") for t in range(len(weights))]
    scored = df.select(label, *dict.fromkeys(weights), probas_of(df.sparkSession, forest).alias("__ps"))
    parts = [F.avg(F.when(F.col(w) == side, h)) for h, w in zip(hit, weights) for side in (1, 0)]
    got = scored.agg(*parts).first()
    return [(got[2 * t], got[2 * t + 1]) for t in range(len(weights))]


def _with_draws(df: DataFrame, row_key: str, runs: int, seed: int) -> DataFrame:
    """One draw per row and run, as an array; splits are comparisons with it."""
    return df.withColumn("__draws", F.array(*[unit_hash(seed, "split", F.lit(run), F.col(row_key)) for run in range(runs)]))


def _split_runs(df: DataFrame, label: str, row_key: str, fraction: float, runs: int, seed: int) -> tuple[DataFrame, list[str]]:
    """Shuffle splits with round(fraction * n) test rows per class, as one column per run (1: trains); draws made before are used."""
    drawn = df if "__draws" in df.columns else _with_draws(df, row_key, runs, seed)
    split, masks = _split_drawn(drawn, label, row_key, fraction, runs, lambda run: F.get(F.col("__draws"), run))
    return split.drop("__draws"), masks


def _split_drawn(df: DataFrame, label: str, row_key: str, fraction: float, runs: int, draw) -> tuple[DataFrame, list[str]]:
    rows = df.select(*df.columns, F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    size = lambda n: F.floor(F.lit(fraction) * n + 0.5)
    rows = rows.select(label, row_key, "run", draw(F.col("run")).alias("u"))
    lasts = last_by_hash(rows, ["run", label], "u", [row_key], size).collect()  # runs x classes
    masks = {}
    for r in range(runs):
        test = F.lit(False)
        for e in lasts:
            if e["run"] == r:
                taken = F.struct(draw(F.lit(r)), F.col(row_key)) <= F.struct(F.lit(e["__last"][0]), F.lit(e["__last"][1]))
                test = F.when(F.col(label) == e[label], taken).otherwise(test)
        masks[f"__run{r}"] = 1 - test.cast("int")
    return df.withColumns(masks), list(masks)


def _method_rows(name: str, split: DataFrame, label: str, features: list[str], row_key: str, methods: dict[str, tuple[str, FitConfig]],
                 depths: list[int], masks: list[str], explain_rows_n: int, seed: int) -> dict[str, list[tuple]]:
    """Result rows by method, whose settings are alike; a cell's time is its share of the common fit."""
    runs, start = len(masks), time.time()
    with packed_runs(split, label, features, masks, next(iter(methods.values()))[1].max_codes) as packed:
        grower = fit_methods(packed, [replace(cfg, max_depth=max(depths)) for _, cfg in methods.values()], runs)
        took = (time.time() - start) / (len(methods) * runs * len(depths))
        cells = [(m, run, depth) for m in range(len(methods)) for run in range(runs) for depth in depths]
        trees = [upper_part(grower.model, m * runs + run, depth) for m, run, depth in cells]
        found = method_accuracies(packed, grower, [(m * runs + run, run, nodes) for (m, run, _), nodes in zip(cells, trees)])
        held = k_rows_of(split, row_key, explain_rows_n, seed, [F.col(mask) == 0 for mask in masks], packed.enc.n_rows)
    forest, some = as_forest(features, trees), [local_rows(split, part) for part in held]
    rows: dict[str, list[tuple]] = {}
    names = list(methods)
    for t, ((m, run, depth), (train, test)) in enumerate(zip(cells, found)):
        axp = explain_rows(some[run], forest, t).agg(F.avg("axp_len")).first()[0]
        splits, leaves = forest.splits(t), forest.leaves(t)
        rows.setdefault(names[m], []).append((
            name, names[m], methods[names[m]][0], depth, run, test, train, float(len(splits) + len(leaves)), float(len(leaves)),
            float(sum(len(n.rule.literals) for n in splits)), axp, took, None))
    return rows


def run_grid(spark: SparkSession, tasks: dict[str, DataFrame], features: dict[str, list[str]], methods: dict[str, tuple[str, FitConfig]],
             depths: list[int], runs: int = 1, explain_rows_n: int = 200, seed: int = 42, label: str = "y", row_key: str = "rk") -> DataFrame:
    """One result row per cell; a failing fit becomes a row with its error for each of its cells."""
    rows = []
    for name, df in tasks.items():
        narrow = df.select(*dict.fromkeys([label, *features[name], row_key]))
        kept = _with_draws(narrow, row_key, runs, seed).persist()
        split, masks = _split_runs(kept, label, row_key, 0.2, runs, seed)
        for run, mask in enumerate(masks):
            train, test = split.filter(F.col(mask) == 1), split.filter(F.col(mask) == 0)
            try:
                start = time.time()
                base = axis_tree(train, label, features[name])
                took = time.time() - start
                nodes = base[1].numNodes
                by = {r[mask]: r["accuracy"] for r in accuracy(axis_predict(split, base), "pred", label, [mask]).collect()}
                rows.append((name, "axis", "baseline", 7, run, by.get(0), by.get(1), float(nodes), float((nodes + 1) // 2),
                             float(nodes // 2), test.transform(axis_path_lengths, base).agg(F.avg("path_length")).first()[0], took, None))
            except Exception as problem:  # a failed cell must not end the grid
                rows.append((name, "axis", "baseline", 7, run, *[None] * 7, str(problem)[:500]))
        together: dict[FitConfig, list[str]] = {}
        for method, (_, cfg) in methods.items():
            together.setdefault(alike(cfg), []).append(method)
        for group in together.values():
            some = {m: methods[m] for m in group}
            try:
                got = _method_rows(name, split, label, features[name], row_key, some, depths, masks, explain_rows_n, seed)
            except Exception:  # which method failed shows when each is fitted alone
                got = {}
            for method, (category, cfg) in some.items():
                try:
                    rows += got.get(method) or _method_rows(name, split, label, features[name], row_key, {method: (category, cfg)}, depths, masks, explain_rows_n, seed)[method]
                except Exception as problem:
                    rows += [(name, method, category, depth, run, *[None] * 7, str(problem)[:500]) for run in range(runs) for depth in depths]
        kept.unpersist()
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def choose_family(df: DataFrame, label: str, features: list[str], row_key: str, families: list[str], k: int = 3,
                  cfg: FitConfig = FitConfig(), node_cost: float = 0.001, axp_cost: float = 0.01, seed: int = 42) -> DataFrame:
    """(family, objective, ...) best first: mean accuracy - node_cost * nodes - axp_cost * mean explanation length."""
    masks = [f"__fold{fold}" for fold in range(k)]
    # the rank that deals the folds moves rows: only what is read later
    narrow = df.select(*dict.fromkeys([label, *features, row_key]))
    kept = k_folds(narrow, row_key, k, seed).persist()
    folded = kept.withColumns({m: (F.col("fold") != fold).cast("int") for fold, m in enumerate(masks)})
    rows = []
    with packed_runs(folded, label, features, masks, cfg.max_codes) as packed:
        grower = fit_methods(packed, [replace(cfg, family=family) for family in families], k)
        held = k_rows_of(folded, row_key, 200, seed, [F.col("fold") == fold for fold in range(k)], packed.enc.n_rows)
        some = [local_rows(folded, part) for part in held]
        cells = [(t, t % k, whole_tree(grower.model, t)) for t in range(len(families) * k)]
        found = method_accuracies(packed, grower, cells)
        forest = as_forest(features, [nodes for *_, nodes in cells])
        for t, (_, test) in enumerate(found):
            fold = t % k
            axp = explain_rows(some[fold], forest, t).agg(F.avg("axp_len")).first()[0]
            rows.append((families[t // k], fold, test, float(len(forest.splits(t)) + len(forest.leaves(t))), axp or 0.0))
    kept.unpersist()
    per = df.sparkSession.createDataFrame(rows, "family string, fold int, accuracy double, nodes double, axp_len double")
    mean = per.groupBy("family").agg(F.avg("accuracy").alias("accuracy"), F.avg("nodes").alias("nodes"), F.avg("axp_len").alias("axp_len"))
    return mean.withColumn("objective", F.col("accuracy") - node_cost * F.col("nodes") - axp_cost * F.col("axp_len")).orderBy(F.desc("objective"), "family")


def learning_curve(df: DataFrame, label: str, features: list[str], row_key: str, fractions: list[float], cfg: FitConfig, seed: int = 42) -> DataFrame:
    """Rows, train and test accuracy of fits on nested fractions of the training rows."""
    # both draws are made once per row; splits and fractions are comparisons with them
    draws = {"__split": unit_hash(seed, "split", F.lit(0), F.col(row_key)), "__curve": unit_hash(seed, "curve", F.col(row_key))}
    drawn = df.select(label, *features, row_key, *[d.alias(name) for name, d in draws.items()]).persist()
    split, (trains,) = _split_drawn(drawn, label, row_key, 0.2, 1, lambda _: F.col("__split"))
    masks = [f"__part{t}" for t in range(len(fractions))]
    # 1 trains, 0 tests, null neither
    part = {m: F.when(F.col(trains) == 0, 0).when(F.col("__curve") < f, 1) for m, f in zip(masks, fractions)}
    split = split.withColumns(part).select(label, *features, *masks)
    model = fit_runs(split.fillna(0, masks), label, features, masks, cfg)
    found = run_accuracies(split, label, model, masks)
    sizes = split.agg(*[F.sum(m) for m in masks]).first()
    drawn.unpersist()
    rows = [(float(f), int(n or 0), train, test, len(model.splits(t)) + len(model.leaves(t))) for t, (f, n, (train, test)) in enumerate(zip(fractions, sizes, found))]
    return df.sparkSession.createDataFrame(rows, "fraction double, n_train long, train_accuracy double, test_accuracy double, nodes int")
