"""Folders for what a plan writes and reads back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); where none is set, in a temporary one.

    Only a session whose executors run in the driver may have one of its own: on a cluster each executor would
    write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/millrace/{tag}-{uuid.uuid4().hex[:12]}"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder, or no rows where nothing was ever written there; any other error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own through Hadoop's file system, wherever it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
