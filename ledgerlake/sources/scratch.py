"""A folder for what a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's ``spark.checkpoint.dir``, which driver and executors share; a single machine without one has a temporary folder."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{at or tempfile.mkdtemp(prefix='scratch-')}/{name}-{uuid.uuid4().hex}"
