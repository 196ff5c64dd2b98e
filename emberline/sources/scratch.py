"""Shared working folder for written intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder of this machine stands in only when the setting is missing and Spark runs in local mode: on a
    cluster other machines could not read it.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="emberline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
