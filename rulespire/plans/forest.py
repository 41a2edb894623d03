"""Bagged rule trees: all trees grow in the same jobs, keyed by tree_id."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from rulespire.config import FitConfig
from rulespire.functions.hashing import poisson_weight, unit_hash
from rulespire.operators.sampling import subset_size
from rulespire.plans.encode import encode
from rulespire.plans.grow import Grower
from rulespire.plans.model import TreeModel, importance, score_rows
from rulespire.plans.walk import probas_of


@dataclass
class ForestModel:
    trees: TreeModel
    subsets: list[list[int]]
    seed: int
    row_key: str

    def weight_column(self, tree: int):
        return poisson_weight(unit_hash(self.seed, "boot", tree, F.col(self.row_key)))


def _subsets(spark, d: int, trees: int, size: int, seed: int) -> list[list[int]]:
    """Feature lists per tree from ranked draws (trees x d numbers)."""
    pairs = spark.range(trees).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("f"))
    drawn = pairs.withColumn("u", unit_hash(seed, "feat", F.col("t"), F.col("f")))
    lists = drawn.groupBy("t").agg(F.slice(F.array_sort(F.collect_list(F.struct("u", "f"))), 1, size).alias("s"))
    return [sorted(e["f"] for e in r["s"]) for r in lists.orderBy("t").collect()]


def fit_forest(df: DataFrame, label: str, features: list[str], row_key: str, n_trees: int = 20,
               max_features: int | float | str | None = "sqrt", cfg: FitConfig = FitConfig(max_depth=10, n_bins=40),
               seed: int = 42, bootstrap: bool = True) -> ForestModel:
    spark = df.sparkSession
    subsets = _subsets(spark, len(features), n_trees, subset_size(max_features, len(features)), seed)
    enc = encode(df, label, features, cfg.max_codes, collapse=False, row_key=row_key, exact=True, cache=False)
    if bootstrap:
        w = F.array(*[poisson_weight(unit_hash(seed, "boot", t, F.col(row_key))).cast("tinyint") for t in range(n_trees)])
        enc.df = enc.df.withColumn("ws", w)
    model = Grower(enc, replace(cfg, seed=seed), n_trees, subsets, "ws" if bootstrap else None).run()
    return ForestModel(model, subsets, seed, row_key)


def oob_scores(df: DataFrame, forest: ForestModel, label: str) -> DataFrame:
    """One row: rows with an out-of-bag tree and the accuracy of their out-of-bag mean."""
    inside = F.array(*[forest.weight_column(t) > 0 for t in forest.trees.tree_ids])
    votes = F.array_compact(F.zip_with(probas_of(df.sparkSession, forest.trees), inside, lambda p, i: F.when(~i, p)))
    mean = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v) / F.size(votes)
    scored = df.select(F.col(label).alias("y"), votes.alias("v"), mean.alias("p")).filter(F.size("v") > 0)
    return scored.agg(F.count(F.lit(1)).alias("n_oob"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("oob_accuracy"))


def forest_importance(nodes: DataFrame) -> DataFrame:
    """Normalized sum of the trees' normalized importances; ``nodes`` is the forest's node table."""
    per = importance(nodes, ["tree_id"]).groupBy("feature").agg(F.sum("importance").alias("s")).withColumn("k", F.lit(0))
    total = per.groupBy("k").agg(F.sum("s").alias("total"))
    return per.join(total, "k").select("feature", (F.col("s") / F.col("total")).alias("importance"))


def score_forest(df: DataFrame, forest: ForestModel, proba: str = "proba", pred: str = "pred") -> DataFrame:
    return score_rows(df, forest.trees, proba, pred)
