"""Files in the shared folder, by whatever scheme its address names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from rulespire.session import scratch_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below spark.checkpoint.dir (a local one where that is unset, as in tests)."""
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex[:8]}")


def locate(address: str):
    """pyarrow file system and path of an address."""
    from pyarrow import fs

    if ":/" in address:
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address
