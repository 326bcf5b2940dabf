"""Where jobs leave intermediate tables and stream checkpoints: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; in local mode without the setting, in a folder of this session's own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("tidemark.shared.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
