"""Session-level helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset (a local test session) a temporary folder
    is used, since driver and executors are then one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = os.path.join(tempfile.gettempdir(), f"blockframe-{os.getpid()}")
    os.makedirs(at, exist_ok=True)
    return at


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint, which survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept in memory and on local disks while a loop reads it; lost parts are computed again from its plan."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def shuffle_tasks(spark: SparkSession) -> int:
    """Number of tasks of a shuffle, as configured."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
