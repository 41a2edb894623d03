"""Profiling and cleaning of labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def unpivot(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """One row per (row, feature): columns keep..., feature, value."""
    entry = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(entry).alias("__e")).select(*keep, "__e.feature", "__e.value")


def validate(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """One row of counts: rows, bad labels, nulls, NaNs and infinities per table."""
    values = F.array(*[F.col(f).cast("double") for f in features])  # one expression per row, however many columns

    def bad(test):
        return F.sum(F.size(F.filter(values, test)))

    y = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(y.isNull() | ~y.isin(0, 1), 1).otherwise(0)).alias("bad_labels"),
        bad(lambda c: c.isNull()).alias("nulls"),
        bad(lambda c: F.isnan(c)).alias("nans"),
        bad(lambda c: F.abs(c) == float("inf")).alias("infs"),
    ).withColumn("n_features", F.lit(len(features)))


def require_valid(df: DataFrame, label: str, features: list[str]) -> int:
    """Refuse a table that does not fit the model; returns its row count."""
    if not features:
        raise ValueError("no feature columns")
    row = validate(df, label, features).first()
    if not row["n_rows"]:
        raise ValueError("the table has no rows")
    problems = {k: row[k] for k in ("bad_labels", "nulls", "nans", "infs") if row[k]}
    if problems:
        raise ValueError(f"unusable values: {problems}")
    return row["n_rows"]


def label_map(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label) -> y: one class 0; two classes larger = 1; more: majority = 1.

    Label counts are aggregated first, so the window sees one row per distinct label.
    """
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    by_size = W.partitionBy(*keys).orderBy(F.desc("__n"), F.asc(label))
    whole = W.partitionBy(*keys)
    rows = counts.select(
        *keys, label,
        F.row_number().over(by_size).alias("__r"),
        F.count(F.lit(1)).over(whole).alias("__k"),
        F.max(label).over(whole).alias("__hi"),
    )
    y = (
        F.when(F.col("__k") == 1, 0)
        .when(F.col("__k") == 2, (F.col(label) == F.col("__hi")).cast("int"))
        .otherwise((F.col("__r") == 1).cast("int"))
    )
    return rows.select(*keys, label, y.alias("y"))


def binarize_labels(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Add the folded 0/1 label ``y``."""
    return df.join(label_map(df, keys, label), [*keys, label])


def feature_variance(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """Population variance per feature in one wide pass, reshaped to long form."""
    stats = df.groupBy(*keys).agg(*[F.var_pop(F.col(f).cast("double")).alias(f) for f in features])
    return unpivot(stats, features, list(keys)).withColumnRenamed("value", "variance")


def varying_features(df: DataFrame, features: list[str], tol: float = 1e-12) -> list[str]:
    """Names of the features that are not constant (model-sized answer)."""
    row = df.agg(*[F.var_pop(F.col(f).cast("double")).alias(f) for f in features]).first()
    return [f for f in features if row[f] is not None and row[f] > tol]


def feature_summary(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """min, max, constant and two-valued (0/1) flags per feature."""
    aggs = []
    for f in features:
        c = F.col(f).cast("double")
        aggs.append(F.struct(
            F.lit(f).alias("feature"), F.min(c).alias("lo"), F.max(c).alias("hi"),
            (F.min(c) == F.max(c)).alias("is_constant"), F.bool_and(c.isin(0.0, 1.0)).alias("is_binary"),
        ).alias(f))
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*features)).alias("s")).select(*keys, "s.*")


def task_profile(df: DataFrame, label: str, features: list[str], keys: list[str]) -> DataFrame:
    """rows, features, positive rate, all-0/1 flag and original width per task."""
    all_binary = F.forall(F.array(*[F.col(f).cast("double") for f in features]), lambda v: v.isin(0.0, 1.0))
    varying = F.filter(F.array(*[F.var_pop(F.col(f).cast("double")) for f in features]), lambda v: v > 1e-12)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.size(varying).alias("n_features"),
        F.avg(F.col(label).cast("double")).alias("pos_rate"),
        F.bool_and(all_binary).alias("is_binary"),
    ).withColumn("n_original", F.lit(len(features)))


def expanded_width(n: Column) -> Column:
    """Columns an enumerating learner would need: all singles and 5 forms per pair."""
    return (n + n * (n - 1) / 2 * 5).cast("bigint")


def minority_share(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    rate = F.avg(F.col(label).cast("double"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("n_pos"),
        F.least(rate, 1 - rate).alias("minority_share"),
    )
