"""Requests as a stream: admission in the plan, the seven stages per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veilframe import schemas
from veilframe.operators.governed import Tables
from veilframe.plans import gateway
from veilframe.plans.gateway import Context
from veilframe.sources.commits import commit, is_committed
from veilframe.sources.logs import write_batch
from veilframe.sources.seen import unseen
from veilframe.sources.storage import durable, temporary


#: How timestamps stand in the JSON of a held request: to the microsecond.
PAYLOAD = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


#: Partitions of a stream's state for each core. What a micro-batch costs beside its rows grows with them.
STATE_PARTITIONS = 2
_PARTITIONS, _ADAPTIVE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"


@contextmanager
def set_for(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings of a session inside the with block."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def state_partitions(spark: SparkSession, count: int | None = None) -> Iterator[dict[str, str]]:
    """A stream started inside has `count` partitions of state, by default a few for each core and no more
    than other shuffles have; yields the settings that its batches are to run with. The first start
    decides: the number belongs to the checkpoint."""
    usual = int(spark.conf.get(_PARTITIONS))
    count = count or min(usual, STATE_PARTITIONS * spark.sparkContext.defaultParallelism)
    with set_for(spark, {_PARTITIONS: str(count)}):
        # streams switch adaptive plans off, also for the plain tables of a batch
        yield {_PARTITIONS: str(usual), _ADAPTIVE: spark.conf.get(_ADAPTIVE)}


def deduplicate(requests: DataFrame, horizon: str, time: str = "ts") -> DataFrame:
    """One request per id within ``horizon``. A duplicate after it passes; the path ``seen`` of
    ``process_batch`` holds those back."""
    return requests.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["request_id"])


def admitted_stream(requests: DataFrame, context: Context = Context()) -> DataFrame:
    """Access check, inbound scan and policy. The same row-local columns as in batch."""
    return gateway.admit(requests, context)


def process_batch(
    requests: DataFrame, batch_id: int, tables: Tables, paths: Mapping[str, str],
    context: Context = Context(), latency_ms: Column | None = None,
) -> None:
    """Run one micro-batch and write ``audit``, ``review`` and ``vault`` from the same
    result. Ids are hashes and each batch has its own key, so a replay changes nothing.
    Intermediate tables are deleted once the sinks are written. With a path ``held``, requests that
    wait for a review are kept there as they were admitted; ``streaming.resume`` takes them up.
    With ``totals``, what cut results hold in all. With ``manifest``, the sinks of a batch become
    visible together, to readers of ``sources.commits``; a batch that is there already is left.
    With ``seen``, an id that any earlier batch had is not run again, however late it comes."""
    if "manifest" in paths and is_committed(requests.sparkSession, paths["manifest"], batch_id):
        return
    with temporary(requests.sparkSession):
        if "seen" in paths:  # written first: the batch is read more than once
            requests = unseen(durable(requests, "batch"), paths["seen"], batch_id)
        admitted = durable(gateway.admit(requests, context), "admitted")
        if not admitted.isEmpty():
            log = gateway.finish(admitted, gateway.execute(admitted, tables, context), context)
            write_sinks(log, batch_id, paths, latency_ms)


def write_sinks(log: DataFrame, batch_id: int | str, paths: Mapping[str, str], latency_ms: Column | None = None) -> None:
    """The sinks of a batch from its result. What they take from it is stored once: a cached one would
    keep as many partitions as its last shuffle, and each sink a file for each of them."""
    time = F.col("ts")
    payload = held_payload(log.sparkSession) if "held" in paths else F.lit(None).cast("string")
    log = durable(gateway.for_sinks(log.withColumn("_payload", payload), time, latency_ms, "_payload"), "log")
    if "totals" in paths:
        write_batch(gateway.audit_totals(log, time), paths["totals"], batch_id)
    if "held" in paths:
        write_batch(_held(log, F.col("_payload")), paths["held"], batch_id)
    write_batch(log.select("audit.*"), paths["audit"], batch_id)
    write_batch(gateway.review_entries(log, time), paths["review"], batch_id)
    write_batch(gateway.vault_entries(log, time), paths["vault"], batch_id)
    if "manifest" in paths:
        commit(log.sparkSession, paths["manifest"], batch_id, [name for name in paths if name not in ("manifest", "seen")])


def held_requests(log: DataFrame) -> DataFrame:
    """``schemas.HELD``: requests that wait for a review, each with its admission as JSON."""
    return _held(log, held_payload(log.sparkSession))


def held_payload(spark: SparkSession) -> Column:
    """The admission of a request that waits for a review, as JSON; null for others."""
    return F.when(F.col("gate") == "review_queued", F.to_json(F.struct(*admission(spark).names), PAYLOAD))


def _held(log: DataFrame, payload: Column) -> DataFrame:
    held, none = log.filter(F.col("gate") == "review_queued"), F.lit(None).cast("string")
    return held.select("request_id", "ts", F.lit("request").alias("kind"), none.alias("action"), none.alias("reason"), payload.alias("payload"))


def admission(spark: SparkSession) -> StructType:
    """The columns of an admitted request."""
    return gateway.admit(spark.createDataFrame([], schemas.REQUESTS)).schema


def start_gateway(
    requests: DataFrame, tables: Tables, paths: Mapping[str, str], checkpoint: str, horizon: str = "1 hour",
    context: Context = Context(), once: bool = False,
) -> StreamingQuery:
    """Start the request stream. ``once`` processes what is there and stops."""
    with state_partitions(requests.sparkSession) as settings:

        def run(df: DataFrame, batch_id: int) -> None:
            with set_for(df.sparkSession, settings):
                process_batch(df, batch_id, tables, paths, context)

        writer = deduplicate(requests, horizon).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
        return (writer.trigger(availableNow=True) if once else writer).start()


def run_to_table(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Process the available input of a stream into a table and read it."""
    with state_partitions(spark):
        query = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
