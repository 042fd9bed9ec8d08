"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only where it is unset, as in a
    local test session, a temporary folder of this machine is used."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="veilframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scope.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; none where there is nothing."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(target).getLength() if system.exists(target) else 0


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside lie in one folder that is deleted at the end. What is
    still needed must have been written elsewhere by then."""
    folder = new_path(spark, "steps")
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        delete(spark, folder)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: later uses neither recompute the plan nor depend on
    the executors that computed it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that the optimizer knows to be empty, so joins with it cost nothing."""
    return spark.createDataFrame([], schema).filter(F.lit(False))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores (small or unsplittable files) enough
    partitions for per-row work. Large scans pass through without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
