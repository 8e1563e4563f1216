"""Session settings the library is designed for, and where lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "stackloom", **settings: str) -> SparkSession:
    """A session with adaptive execution (coalescing, skew splits) and UTC time; ``settings`` win."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local master, where driver and executors are
    one process, falls back to a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stackloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it from there: for a result that several steps use and that is dear to recompute.

    The table lies in the session's shared folder, so it survives lost executors.
    """
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """``df``, a table of short rows, for joins: shared with every task if it has at most so many ``rows``, which are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def work_folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder, for tables a job writes on its way."""
    return f"{ensure_checkpoint_dir(spark)}/work-{uuid.uuid4().hex}"
