"""Reviewed requests taken up again: what a reviewer allows runs, everything ends in a second record.

The gateway keeps a request that waits for a review as it was admitted. Here it goes through the
state of ``review.gate`` and comes out with its outcome; stages 4 to 7 run for those allowed. The
admission is not repeated, so a policy that has changed since does not judge the request twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.governed import Tables
from veilframe.plans import gateway
from veilframe.plans.gateway import Context
from veilframe.sources.commits import is_committed
from veilframe.sources.storage import durable, temporary
from veilframe.streaming.requests import PAYLOAD, admission, set_for, state_partitions, write_sinks
from veilframe.streaming.review import REVIEW_HOURS, gate


def released(outcomes: DataFrame) -> DataFrame:
    """Admitted requests from ``review.OUTCOME``, under the decision; ``ts`` is when it was settled."""
    schema = admission(outcomes.sparkSession)
    rows = outcomes.filter("payload is not null").select(
        F.from_json("payload", schema, PAYLOAD).alias("r"), "resolved_at", F.struct("outcome", "action", "reason").alias("_review")
    )
    held = rows.select("r.*", "resolved_at", "_review").withColumn("ts", F.col("resolved_at")).drop("resolved_at")
    return gateway.decided(held, "_review")


def process_outcomes(
    outcomes: DataFrame, batch_id: int, tables: Tables, paths: Mapping[str, str], context: Context = Context()
) -> None:
    """Run one micro-batch of settled reviews and write its sinks under a key of its own, so a replay
    changes nothing and the gateway's batches stay."""
    key = f"resumed-{batch_id}"
    if "manifest" in paths and is_committed(outcomes.sparkSession, paths["manifest"], key):
        return
    with temporary(outcomes.sparkSession):
        admitted = durable(released(outcomes), "released")
        if admitted.isEmpty():  # most batches settle nothing
            return
        log = gateway.finish(admitted, gateway.execute(admitted, tables, context), context)
        sinks = {name: path for name, path in paths.items() if name != "held"}
        write_sinks(log, key, sinks)


def start_reviews(
    held: DataFrame, decisions: DataFrame, tables: Tables, paths: Mapping[str, str], checkpoint: str,
    lateness: str = "1 hour", hours: float = REVIEW_HOURS, context: Context = Context(), once: bool = False,
) -> StreamingQuery:
    """Start the stage that takes requests up again. ``held``: the stream of ``schemas.HELD``;
    ``decisions``: ``schemas.REVIEW_EVENTS`` of kinds decision and cancel, which may come before or
    after their request. ``once`` processes what is there and stops."""
    events = held.unionByName(decisions.withColumn("payload", F.lit(None).cast("string")))
    with state_partitions(held.sparkSession) as settings:

        def run(df: DataFrame, batch_id: int) -> None:
            with set_for(df.sparkSession, settings):
                process_outcomes(df, batch_id, tables, paths, context)

        writer = gate(events, lateness, hours).writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(run)
        return (writer.trigger(availableNow=True) if once else writer).start()
