"""Where tables that are changed in place may lie while a query runs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a temporary one where all of Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", "") or own(spark.conf.get("spark.master", ""))
    return f"{base.rstrip('/')}/siftwell-tables/{name}-{uuid.uuid4().hex}"


@lru_cache(1)
def own(master: str) -> str:
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="siftwell-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"
