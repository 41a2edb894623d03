"""Writers for results, models, explanations and evidence tables."""

from __future__ import annotations

import json
from dataclasses import asdict, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from rulespire.plans.model import TreeModel


def union_of(frames: list[DataFrame]) -> DataFrame:
    """All rows with the union of columns; missing ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(frames: list[DataFrame], path: str) -> None:
    union_of(frames).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One parquet table per name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def save_model(spark: SparkSession, model: TreeModel, path: str) -> None:
    """Node table plus the feature names."""
    model.frame(spark).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(i, f) for i, f in enumerate(model.features)], "position int, name string").write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> TreeModel:
    names = [r["name"] for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]
    return TreeModel.from_frame(spark.read.parquet(f"{path}/nodes"), names)


def _put_text(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _get_text(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def save_fitted(spark: SparkSession, fitted, path: str) -> None:
    """Any fitted object: tree, forest, boosting or a whole classifier with its calibrator."""
    from rulespire.plans.boost import BoostModel
    from rulespire.plans.facade import RuleClassifier
    from rulespire.plans.forest import ForestModel

    if isinstance(fitted, TreeModel):
        save_model(spark, fitted, f"{path}/trees")
        about = {"kind": "tree"}
    elif isinstance(fitted, ForestModel):
        save_model(spark, fitted.trees, f"{path}/trees")
        about = {"kind": "forest", "subsets": fitted.subsets, "seed": fitted.seed, "row_key": fitted.row_key}
    elif isinstance(fitted, BoostModel):
        about = {"kind": "boosting", **asdict(fitted)}
    elif isinstance(fitted, RuleClassifier):
        save_fitted(spark, fitted._fitted(), f"{path}/model")
        about = {"kind": "classifier", "settings": {f.name: getattr(fitted, f.name) for f in fields(fitted) if f.init},
                 "fitted": fitted.kind_, "calibrator": fitted.calibrator_}
    else:
        raise TypeError(f"cannot save {type(fitted).__name__}")
    _put_text(spark, f"{path}/about", about)


def load_fitted(spark: SparkSession, path: str):
    """What ``save_fitted`` wrote, of the same class."""
    from rulespire.plans.boost import BoostModel, Stump
    from rulespire.plans.facade import RuleClassifier
    from rulespire.plans.forest import ForestModel

    about = _get_text(spark, f"{path}/about")
    kind = about.pop("kind")
    if kind == "tree":
        return load_model(spark, f"{path}/trees")
    if kind == "forest":
        return ForestModel(load_model(spark, f"{path}/trees"), **about)
    if kind == "boosting":
        return BoostModel(**about | {"stumps": [Stump(**s) for s in about["stumps"]]})
    out = RuleClassifier(**about["settings"])
    out.kind_, out.model_ = about["fitted"], load_fitted(spark, f"{path}/model")
    if about["calibrator"]:
        name, *rest = about["calibrator"]
        out.calibrator_ = (name, *rest) if name == "platt" else (name, [tuple(k) for k in rest[0]])
    return out


def write_explanations(df: DataFrame, path: str, by: str = "task") -> None:
    """Per-row explanations as CSV, features joined into one text column."""
    from pyspark.sql import functions as F

    flat = df.withColumn("axp", F.array_join(F.transform("axp", lambda f: f.cast("string")), " "))
    flat.write.mode("overwrite").partitionBy(by).option("header", True).csv(path)
