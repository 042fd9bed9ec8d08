"""Logs stored in buckets of their request id, so that joins and counts by it don't shuffle them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.sources.storage import shared_folder

BUCKETS = 32


def store_bucketed(records: DataFrame, table: str, path: str | None = None, key: str = "request_id", buckets: int = BUCKETS) -> DataFrame:
    """Append records to a table in buckets of ``key``, sorted in each, and read it. All tables that
    are joined need the same number of buckets. The records are dealt to buckets once, when they
    are written: one file a bucket and append, so later joins neither shuffle nor, after a single
    append, sort. Without a path the table lies in the shared folder."""
    spark = records.sparkSession
    path = path or f"{shared_folder(spark)}/{table}"
    (
        records.repartition(buckets, key).write.mode("append").format("parquet").option("path", path)
        .bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    )
    return spark.table(table)


def drop_table(spark: SparkSession, table: str) -> None:
    """Forget the table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
