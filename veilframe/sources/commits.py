"""Batches over several sinks that become visible together.

A batch writes each sink under its own key and then, last, one manifest entry. Readers go by the
manifest: a batch that failed between two sinks shows in none of them, and its replay writes the same
keys again. Many small batches are merged behind the readers: the merged files are written first,
then one entry that takes the place of those of the batches in it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilframe import schemas
from veilframe.sources.logs import read_log, write_batch
from veilframe.sources.storage import delete, stored_bytes

MANIFEST = "batch string, sinks array<string>, replaces array<string>"
#: Stored bytes from which on a merge writes more files: a compressed one is read by one task.
FILE_BYTES = 16 << 20


def commit(spark: SparkSession, manifest: str, batch: int | str, sinks: list[str], replaces: list[str] | None = None) -> None:
    """Make a batch visible: one file, which appears whole or not at all."""
    entry = spark.createDataFrame([(str(batch), sorted(sinks), replaces or [])], MANIFEST)
    write_batch(entry.coalesce(1), manifest, batch)


def committed(spark: SparkSession, manifest: str) -> DataFrame:
    """``(batch, sinks)`` of the batches to read: those with an entry that no other has replaced."""
    entries = read_log(spark, manifest, MANIFEST)
    replaced = entries.select(F.explode("replaces").alias("batch")).distinct()
    return entries.join(replaced, "batch", "left_anti").select("batch", "sinks")


def is_committed(spark: SparkSession, manifest: str, batch: int | str) -> bool:
    """Also true for a batch that has been merged into another."""
    entries = read_log(spark, manifest, MANIFEST)
    return not entries.filter((F.col("batch") == str(batch)) | F.array_contains("replaces", str(batch))).isEmpty()


def read_committed(spark: SparkSession, path: str, manifest: str, name: str, schema: str) -> DataFrame:
    """The records of one sink from committed batches. Other folders are pruned by their key and not
    read. The manifest has one row a batch, so its join is broadcast; batches are merged to keep it
    short."""
    batches = committed(spark, manifest).filter(F.array_contains("sinks", name)).select(F.col("batch").alias("batch_id"))
    stored = read_log(spark, path, schema, keyed=True)
    return stored.join(F.broadcast(batches), "batch_id", "left_semi").select(*StructType.fromDDL(schema).names)


def merge(spark: SparkSession, paths: Mapping[str, str], sinks: Mapping[str, str], batch: str, files: int = 1) -> int:
    """Merge all committed batches into one, under the key ``batch``; returns how many there were.
    ``sinks``: name -> schema. What they replace stays readable until ``clean``. Each sink gets ``files``
    files, or more where they would be longer than ``FILE_BYTES``; tasks put together what they read,
    without a shuffle."""
    live = [r.batch for r in committed(spark, paths["manifest"]).collect()]  # one row a batch
    if len(live) < 2:
        return 0
    for name, schema in sinks.items():
        records = read_committed(spark, paths[name], paths["manifest"], name, schema)
        held = sum(stored_bytes(spark, f"{paths[name]}/batch_id={key}") for key in live)
        write_batch(records.coalesce(max(files, -(-held // FILE_BYTES))), paths[name], batch)
    commit(spark, paths["manifest"], batch, list(sinks), sorted(live))
    return len(live)


def clean(spark: SparkSession, paths: Mapping[str, str], sinks: list[str]) -> None:
    """Delete the folders of merged batches, once no reader of the older state is left."""
    entries = read_log(spark, paths["manifest"], MANIFEST)
    for row in entries.select(F.explode("replaces").alias("batch")).distinct().collect():
        for name in sinks:
            delete(spark, f"{paths[name]}/batch_id={row.batch}")


SINKS = {"audit": schemas.AUDIT, "review": schemas.REVIEW, "vault": schemas.VAULT}
