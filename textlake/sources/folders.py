"""Folders for tables that a job writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir. Only a local session without one gets a
    temporary folder, which goes when the interpreter ends; for a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "root" not in _local:
            _local["root"] = tempfile.mkdtemp(prefix="textlake-")
            atexit.register(shutil.rmtree, _local["root"], ignore_errors=True)
        root = _local["root"]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
