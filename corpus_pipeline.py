"""From raw documents to packed training sequences, in stages that are each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.decontamination import benchmark_matches
from veilframe.llm.jaccard_join import one_of_each
from veilframe.llm.packing import pack
from veilframe.llm.quality import good_texts
from veilframe.llm.queries import tokenizer_path
from veilframe.llm.store import Workspace, free_names
from veilframe.llm.substring_dedup import repeated_passages, without_passages

#: Keys of matched documents that are broadcast; more are joined by a shuffle.
_BROADCAST_KEYS = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return good_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word-shingle sets of similarity 0.8 or more."""
    return one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 35 words or more that stand elsewhere too.
    A document of which nothing is left stays with an empty text."""
    return without_passages(docs, repeated_passages(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A document is told by its id and text together."""
    (name,) = free_names(docs, "_key")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")))
    found = benchmark_matches(docs.withColumn(name, key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id=name)
    keys = found.select(name).distinct()
    small = keys.count() <= _BROADCAST_KEYS
    return docs.withColumn(name, key).join(F.broadcast(keys) if small else keys, name, "left_anti").drop(name)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 1024, sources mixed in proportion."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_copies),
    ("substring dedup", passages),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]
#: The classifier and the packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Workspace(spark, "pipeline") as work:
        for name, stage in STAGES[:-1]:
            docs = work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        name, stage = STAGES[-1]
        return work.keep(stage(spark, docs, sf_dir), name)
