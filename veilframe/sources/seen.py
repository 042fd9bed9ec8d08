"""Ids that a stream has had, however long ago: beyond what a watermark remembers.

Ids are stored as they come, by batch and hash bucket, sorted, with Parquet's Bloom filter on the id.
A batch reads the buckets its ids fall into. Up to ``INLINE`` ids are pushed to the scan as values,
where the Bloom filters skip row groups that hold none of them; more are joined bucket by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.storage import durable, exists

BUCKETS = 256
INLINE = 500
_PUSHED = "spark.sql.parquet.pushdown.inFilterThreshold"


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored_ids(spark: SparkSession, path: str, key: str = "request_id") -> DataFrame:
    """``(key, batch, bucket)``; empty where nothing has been stored."""
    schema = f"{key} string, batch string, bucket int"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def unseen(rows: DataFrame, path: str, batch: int | str, key: str = "request_id", buckets: int = BUCKETS) -> DataFrame:
    """Rows of a batch whose id no other batch has had, one a id, and their ids stored. Run again
    for the same batch it gives the same rows. A row without an id passes and is not stored."""
    spark = rows.sparkSession
    named = rows.filter(F.col(key).isNotNull()).dropDuplicates([key])
    ids = durable(named.select(key, bucket_of(key, buckets).alias("bucket")), "batch-ids")
    touched = [r.bucket for r in ids.select("bucket").distinct().collect()]  # at most `buckets`
    few = [r[0] for r in ids.select(key).limit(INLINE + 1).collect()]
    before = stored_ids(spark, path, key).filter((F.col("batch") != str(batch)) & F.col("bucket").isin(touched))
    pushed = spark.conf.get(_PUSHED)
    if len(few) <= INLINE:
        spark.conf.set(_PUSHED, str(INLINE))
        before = before.filter(F.col(key).isin(few))
    try:
        fresh = durable(ids.join(before.select("bucket", key), ["bucket", key], "left_anti"), "fresh-ids")
    finally:
        spark.conf.set(_PUSHED, pushed)
    (
        fresh.repartition("bucket").sortWithinPartitions("bucket", key)
        .write.mode("overwrite").partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", "100000").parquet(f"{path}/batch={batch}")
    )
    return named.join(fresh.select(key), key, "left_semi").select(*rows.columns).unionByName(rows.filter(F.col(key).isNull()))
