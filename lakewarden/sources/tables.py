"""Readers for the Parquet tables and the session-wide scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of part files) below ``root``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, for checkpoints and cut lineage.

    A cluster names it in ``spark.checkpoint.dir``; without it, a cluster's jobs are refused.  Only on
    a single machine (tests) a folder is made for the application, and removed at its end.
    """
    context = spark.sparkContext
    there = context._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("a cluster has to name a folder that all executors share in spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="lakewarden-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, most: int) -> list | None:
    """The rows of ``df`` if there are at most ``most`` of them, else None.

    Never brings more than ``most + 1`` rows to the driver.
    """
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def latest_copy(df: DataFrame, key: str) -> DataFrame:
    """One row per ``key``; copies of a record are alike in content, so any one will do.  Rows without a key all stay."""
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return df.withColumn("_own", own).dropDuplicates([key, "_own"]).drop("_own")


def with_file_key(df: DataFrame, pattern: str, name: str = "incident_id") -> DataFrame:
    """Adds the part of each row's file path that ``pattern`` (one group) matches."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
