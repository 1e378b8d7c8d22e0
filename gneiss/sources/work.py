"""A folder for intermediate tables: below spark.checkpoint.dir, which all executors share; an own one where that is unset, in local mode only."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path. The engine's own store works through os.path, so the folder must be mounted: another file system is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = base.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"not a mounted folder: {base}")
    return f"/{path.strip('/')}/{name}-{uuid.uuid4().hex[:12]}"
