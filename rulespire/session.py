"""Session helpers shared by the entry point, the bench and the tests."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "rulespire") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; set one only where none is named (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and sc.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="rulespire-ckpt-")
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(shared)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one the cluster names; local sessions may use /tmp."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return tempfile.mkdtemp(prefix=f"rulespire-{name}-")
    return f"{shared}/rulespire-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application; the driver serves the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_rulespire_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    base = Path(tempfile.mkdtemp(prefix="rulespire-ship-")) / "rulespire"
    sc.addPyFile(shutil.make_archive(str(base), "zip", root, "rulespire"))
    sc._rulespire_shipped = True
