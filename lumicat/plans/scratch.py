"""Where queries write files that all executors read."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a fresh temporary one only in local mode without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="lumicat-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root
