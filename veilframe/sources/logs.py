"""The append-only tables: audit log, vault, review queue; golden cases."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilframe import schemas


def read_log(spark: SparkSession, path: str, schema: str = schemas.AUDIT, keyed: bool = False) -> DataFrame:
    """All records of a JSON-lines log. A missing log is empty, blank lines are skipped,
    a malformed line fails the read. ``keyed`` adds the key of the batch that wrote them, as text."""
    wanted = f"{schema}, batch_id string" if keyed else schema
    try:
        stored = spark.read.schema(wanted).option("mode", "FAILFAST").json(path)
        return stored.select(*StructType.fromDDL(wanted).names)  # without partition columns
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], wanted)
        raise


def append_log(records: DataFrame, path: str, by_date: bool = False) -> None:
    """Append records as JSON lines, partitioned by date where asked."""
    if by_date:
        dated = records.withColumn("date", F.to_date("timestamp_utc"))
        dated.write.mode("append").option("ignoreNullFields", "false").partitionBy("date").json(path)
    else:
        records.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_batch(records: DataFrame, path: str, batch_id: int | str) -> None:
    """Write one micro-batch under its own key: a replayed batch replaces itself. Its lines are compressed,
    as the texts of a log repeat much; readers tell by the name of a file."""
    writer = records.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip")
    writer.json(f"{path}/batch_id={batch_id}")


def clear_log(spark: SparkSession, path: str, schema: str = schemas.AUDIT) -> None:
    """Empty a log (for tests)."""
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def tail_log(spark: SparkSession, path: str, schema: str = schemas.AUDIT, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the records that arrive in a log; the query's checkpoint is the position."""
    return (
        spark.readStream.schema(schema).option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def tail_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of the records of micro-batches that ``write_batch`` adds to a path."""
    stored = spark.readStream.schema(f"{schema}, batch_id string").option("mode", "FAILFAST").json(path)
    return stored.drop("batch_id")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases with a stable ``case_id`` from their content."""
    cases = read_log(spark, path, schemas.GOLDEN)
    return cases.withColumn("case_id", F.substring(F.sha2(F.concat_ws("|", "role", "query"), 256), 1, 16))
