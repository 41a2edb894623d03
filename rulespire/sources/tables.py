"""Labelled tasks on ordinary tables: a label expression plus numeric feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulespire.functions.hashing import unit_hash


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_task(df: DataFrame, label: Column, features: dict[str, Column], row_key: Column, task: str) -> DataFrame:
    """task, rk, y and one double column per feature; works for any source format."""
    return df.select(
        F.lit(task).alias("task"), row_key.cast("string").alias("rk"), label.cast("int").alias("y"),
        *[c.cast("double").alias(n) for n, c in features.items()])


def flipped(truth: Column, row_key: Column, share: float, seed: int = 7) -> Column:
    """A planted label with a reproducible share of flips."""
    return F.when(unit_hash(seed, "flip", row_key) < share, ~truth).otherwise(truth)


LINE_FEATURES = ["q", "p", "d", "t", "ln", "ls"]


def line_features() -> dict[str, Column]:
    return {
        "q": F.col("l_quantity"), "p": F.col("l_extendedprice"), "d": F.col("l_discount"), "t": F.col("l_tax"),
        "ln": F.col("l_linenumber"), "ls": (F.col("l_linestatus") == "F").cast("double"),
    }


def line_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def line_truth(task: str) -> Column:
    q, p, d, t = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return {
        "or2": (q >= 30) | (d < 0.03),
        "and2": (q >= 20) & (t >= 0.03),
        "xor2": (q >= 25) != (d >= 0.05),
        "cnf4": ((q >= 25) | (d < 0.03)) & ((t >= 0.04) | (p < 50000)),
    }[task]


def line_task(spark: SparkSession, sf_dir: str, task: str = "or2", flips: float = 0.05) -> DataFrame:
    """Planted or natural label on lineitem."""
    df = load(spark, sf_dir, "lineitem")
    label = F.col("l_returnflag") == "R" if task == "returns" else flipped(line_truth(task), line_key(), flips)
    return as_task(df, label, line_features(), line_key(), task)
