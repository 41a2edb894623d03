"""Splits and samples from reproducible draws.

Sizes are exact where the definition asks for exact sizes; neither a split nor a rank
ever sorts a whole class in one task (see ``scan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from rulespire.functions.hashing import poisson_weight, unit_hash
from rulespire.operators.scan import rank_by_hash, smallest_by_hash


def draw(df: DataFrame, row_key: str, seed: int, purpose: str, out: str = "u") -> DataFrame:
    return df.withColumn(out, unit_hash(seed, purpose, F.col(row_key)))


def stratified_split(df: DataFrame, strata: list[str], row_key: str, fraction: float, seed: int,
                     runs: int = 1, purpose: str = "split") -> DataFrame:
    """``runs`` shuffle splits with round(fraction * n) test rows per stratum."""
    rows = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))) if runs > 1 else df.withColumn("run", F.lit(0))
    rows = rows.withColumn("u", unit_hash(seed, purpose, F.col("run"), F.col(row_key)))
    size = lambda n: F.floor(F.lit(fraction) * n + 0.5)
    return smallest_by_hash(rows, ["run", *strata], "u", [row_key], size, "is_test").drop("u")


def guarded_split(df: DataFrame, strata: list[str], row_key: str, fraction: float, seed: int) -> DataFrame:
    """Class-aware split: 1 <= test <= n - 1 per class; a lone row trains."""
    rows = draw(df, row_key, seed, "guarded")
    def size(n):
        wanted = F.floor(F.lit(fraction) * n + 0.5)
        return F.when(n == 1, 0).otherwise(F.least(F.greatest(wanted, F.lit(1)), n - 1))
    return smallest_by_hash(rows, strata, "u", [row_key], size, "is_test").drop("u")


def permutation_split(df: DataFrame, row_key: str, train: float, seed: int) -> DataFrame:
    """Plain shuffle: the first floor(train * n) rows of a permutation train."""
    rows = draw(df, row_key, seed, "perm").withColumn("__all", F.lit(0))
    trained = smallest_by_hash(rows, ["__all"], "u", [row_key], lambda n: F.floor(F.lit(train) * n), "__train")
    return trained.withColumn("is_test", ~F.col("__train")).drop("__train", "u", "__all")


def hold_out(df: DataFrame, row_key: str, fraction: float, seed: int, purpose: str, out: str = "held_out") -> DataFrame:
    """Independent draws against a threshold: no shuffle, expected size fraction * n."""
    return df.withColumn(out, unit_hash(seed, purpose, F.col(row_key)) < fraction)


def k_folds(df: DataFrame, row_key: str, k: int, seed: int) -> DataFrame:
    """Fold = position in a permutation modulo k: sizes differ by at most one."""
    rows = draw(df, row_key, seed, "fold").withColumn("__all", F.lit(0))
    ranked = rank_by_hash(rows, ["__all"], "u", [row_key], out="r")
    return ranked.withColumn("fold", F.pmod(F.col("r") - 1, F.lit(k)).cast("int")).drop("r", "u", "__all")


def contiguous_folds(row_id: Column, n: Column, k: int) -> Column:
    """Fold of a 0-based position when the table is cut into k runs of floor(n / k)."""
    return F.least(F.floor(row_id / F.greatest(F.floor(n / k), F.lit(1))), F.lit(k - 1)).cast("int")


def bootstrap(df: DataFrame, row_key: str, trees: int, seed: int) -> DataFrame:
    """(row, tree, w): Poisson(1) weights; w = 0 means out of bag."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    return df.withColumn("tree_id", tree).withColumn(
        "w", poisson_weight(unit_hash(seed, "boot", F.col("tree_id"), F.col(row_key)))
    )


def subset_size(rule: int | float | str | None, d: int) -> int:
    """How many of d features a tree may use."""
    if isinstance(rule, int):
        return min(rule, d)
    if isinstance(rule, float):
        return max(1, int(rule * d))
    if rule == "sqrt":
        return max(1, int(d**0.5))
    if rule == "log2":
        return max(1, (d).bit_length() - 1)
    return d


def feature_subsets(features: DataFrame, trees: int, size: int, seed: int, purpose: str = "feat") -> DataFrame:
    """``size`` features without replacement per tree; ``features`` has one row per feature."""
    pairs = features.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree_id"), "feature")
    pairs = pairs.withColumn("u", unit_hash(seed, purpose, F.col("tree_id"), F.col("feature")))
    order = W.partitionBy("tree_id").orderBy("u", "feature")
    return pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size).select("tree_id", "feature")


def round_subsample(df: DataFrame, row_key: str, rounds: int, fraction: float, seed: int) -> DataFrame:
    """(row, round) pairs kept by independent draws per boosting round."""
    rows = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return rows.filter(unit_hash(seed, "row", F.col("round"), F.col(row_key)) < fraction)


def k_rows(df: DataFrame, row_key: str, k: int, seed: int) -> DataFrame:
    """k rows with the smallest draws (top-k sort, no global shuffle)."""
    return draw(df, row_key, seed, "pick").orderBy("u", row_key).limit(k).drop("u")


def k_rows_of(df: DataFrame, row_key: str, k: int, seed: int, sides: list[Column], n_rows: int) -> list[list[Row]]:
    """``k_rows`` of the rows of every side (they may overlap), from one pass over a table of about ``n_rows`` rows.

    Draws are uniform, so the k smallest ones of a side lie below a small bound; it is raised until every side has k rows
    below it or nothing is left out.
    """
    drawn = draw(df, row_key, seed, "pick", "__u").withColumn("__side", F.array(*[F.when(s, i) for i, s in enumerate(sides)]))
    share = 8.0 * k * len(sides) / max(n_rows, 1)
    while True:
        near = (drawn.filter(F.col("__u") < share) if share < 1 else drawn).withColumn("__side", F.explode(F.array_compact("__side")))
        ranked = near.withColumn("__r", F.row_number().over(W.partitionBy("__side").orderBy("__u", row_key))).filter(F.col("__r") <= k)
        rows: list[list] = [[] for _ in sides]
        for r in ranked.orderBy("__side", "__r").collect():  # sides x k rows
            rows[r["__side"]].append(r[: len(df.columns)])
        if share >= 1 or min(map(len, rows)) >= k:
            return rows
        share *= 8


def learning_fractions(df: DataFrame, row_key: str, fractions: list[float], seed: int) -> DataFrame:
    """Nested samples: a row of a smaller fraction is in every larger one."""
    u = unit_hash(seed, "curve", F.col(row_key))
    return df.withColumn("u", u).withColumn("fraction", F.explode(F.filter(
        F.array(*[F.lit(float(f)) for f in fractions]), lambda f: F.col("u") < f))).drop("u")
