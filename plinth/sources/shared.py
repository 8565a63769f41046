"""New folders in the place that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local master (tests) may leave that unset; then the folder is a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        _local or _local.append(tempfile.mkdtemp(prefix="plinth-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
