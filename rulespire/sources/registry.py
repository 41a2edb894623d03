"""Experiment registry as two append-only parquet tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EXPERIMENTS = "experiment_id string, created_at timestamp, config_hash string, config string, note string"
RUNS = "run_id string, experiment_id string, created_at timestamp, method string, accuracy double, nodes double, axp_len double, artifact string"


def config_key(config_json: Column) -> Column:
    """16 hex digits of the hash of a configuration with sorted keys."""
    return F.substring(F.sha2(config_json, 256), 1, 16)


class Registry:
    """Tables below one folder; appended files with other columns are merged on read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            df = self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/{name}")
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
                raise
            df = self.spark.createDataFrame([], schema)
        return self._complete(df, schema)

    def _complete(self, df: DataFrame, schema: str) -> DataFrame:
        """Add columns that older files lack."""
        wanted = self.spark.createDataFrame([], schema).schema
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in wanted if f.name not in df.columns}) if any(
            f.name not in df.columns for f in wanted) else df

    def experiments(self) -> DataFrame:
        return self._read("experiments", EXPERIMENTS).orderBy(F.desc("created_at"), "experiment_id")

    def runs(self) -> DataFrame:
        gone = self._read("runs_deleted", "run_id string").select("run_id").distinct()
        left = self._read("runs", RUNS).join(gone, "run_id", "left_anti")
        return left.orderBy(F.desc("created_at"), "run_id")

    def register(self, config: dict, note: str = "") -> str:
        text = json.dumps(config, sort_keys=True)
        new_id = uuid.uuid4().hex[:12]
        row = self.spark.createDataFrame([(new_id, text, note)], "experiment_id string, config string, note string")
        row = row.select("experiment_id", F.current_timestamp().alias("created_at"), config_key(F.col("config")).alias("config_hash"), "config", "note")
        row.write.mode("append").parquet(f"{self.folder}/experiments")
        return new_id

    def add_runs(self, rows: DataFrame) -> None:
        """Append run rows (any extra columns are kept)."""
        if "created_at" not in rows.columns:
            rows = rows.withColumn("created_at", F.current_timestamp())
        rows.withColumn("run_id", F.col("run_id").cast("string")).write.mode("append").parquet(f"{self.folder}/runs")

    def restore(self, experiment_id: str, payload: DataFrame | None = None) -> DataFrame:
        """Runs of one experiment; payload values win, registry columns fill the gaps."""
        runs = self.runs().filter(F.col("experiment_id") == experiment_id)
        return runs if payload is None else restore_join(runs, payload, ["method", "accuracy", "nodes", "axp_len"])

    def delete_runs(self, ids: DataFrame) -> None:
        """Append the ids to the deleted ones; nothing is overwritten, so a failed write loses no run."""
        ids.select(F.col("run_id").cast("string").alias("run_id")).write.mode("append").parquet(f"{self.folder}/runs_deleted")


def restore_join(runs: DataFrame, payload: DataFrame, columns: list[str]) -> DataFrame:
    p = payload.select("run_id", *[F.col(c).alias(f"__p_{c}") for c in columns if c in payload.columns])
    out = runs.join(p, "run_id", "left")
    for c in columns:
        if f"__p_{c}" in out.columns:
            out = out.withColumn(c, F.coalesce(f"__p_{c}", c)).drop(f"__p_{c}")
    return out
