"""The folder that driver and executors share, for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def base_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset (tests on
    one machine) a folder of our own, remembered in the session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lakestrata.sharedDir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lakestrata-")
        spark.conf.set("spark.lakestrata.sharedDir", base)
    return base.rstrip("/") if "://" in base or base.startswith("file:") else f"file://{base.rstrip('/')}"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{base_dir(spark)}/lakestrata/{name}-{uuid.uuid4().hex}"
