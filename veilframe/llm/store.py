"""Tables that an operator writes between its steps, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of this machine only where none is set and the
    session is local, as in tests."""
    folder = spark.conf.get(SETTING, None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with more underscores where the table has a column of that name already."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        free.append(name)
    return free


class Workspace:
    """A folder for one operator's intermediate tables, gone after the with block. What must
    outlive it is written by keep(), beside the folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc) -> None:
        self.delete(f"{self.root}/steps")

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def path(self, name: str) -> str:
        return f"{self.root}/steps/{name}"

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self._write(df, self.path(name))

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        return self._write(df, f"{self.root}/{name}")
