"""Human review with a deadline: a request waits for a decision, a cancel or 24 hours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REVIEW_HOURS = 24
OUTCOME = "request_id string, outcome string, action string, reason string, requested_at timestamp, resolved_at timestamp, payload string"
#: Requests share the state of one of so many hash buckets: what a micro-batch costs beside its rows is
#: bounded by it. It belongs to the checkpoint, so a stream that goes on keeps its number.
BUCKETS = 1 << 11
_SETTLED = "request_id string, outcome string, action string, reason string, requested_ms long, resolved_ms long, payload string"
_STATE = (
    "pending array<struct<request_id: string, requested_ms: long, deadline_ms: long, closed: boolean, payload: string>>, "
    "early array<struct<request_id: string, at_ms: long, kind: string, action: string, reason: string>>"
)
TIMEOUT_REASON = "Request cancelled or human review timeout"


def review_gate(hours: float = REVIEW_HOURS) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state of a bucket of requests. It holds for each request the request itself as it was
    admitted (``payload``), when it was asked, its deadline, and whether it is settled.

    A decision that is read before its request is kept for the time of a review and applied once
    the request is there, and of the decisions in one batch the earliest since the request counts,
    so the outcome does not depend on how the stream was cut into batches or frames. What comes
    after the request is settled is ignored. A settled request stays until its deadline, without
    the payload, to know late decisions as such. The bucket's timeout is the next of its times.
    """
    wait_ms = int(timedelta(hours=hours).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, waiting = state.get if state.exists else ((), ())
        pending = {r[0]: tuple(r[1:]) for r in kept}
        early: dict[str | None, list[tuple]] = {}
        for request_id, *move in waiting:
            early.setdefault(request_id, []).append(tuple(move))
        asked, moves, out = {}, {}, []
        for frame in frames:
            columns = (frame[name].tolist() for name in ("request_id", "at_ms", "kind", "action", "reason", "payload"))
            for request_id, at, kind, action, reason, payload in zip(*columns):
                known = pending.get(request_id)
                if kind == "request":
                    if known is None and (request_id not in asked or at < asked[request_id][0]):
                        asked[request_id] = (at, payload)
                elif known is None:
                    early.setdefault(request_id, []).append((at, kind, action or "", reason or ""))
                elif not known[2] and at >= known[0]:
                    move = _move(at, kind, action or "", reason or "")
                    moves[request_id] = min(moves.get(request_id, move), move)
        for request_id, (at, payload) in asked.items():
            pending[request_id] = (at, at + wait_ms, False, payload)
            move = min((_move(*e) for e in early.pop(request_id, ()) if e[0] >= at), default=None)
            if move is not None:
                moves[request_id] = move
        for request_id, move in moves.items():
            known = pending[request_id]
            out.append(_settled(request_id, known, move))
            pending[request_id] = (known[0], known[1], True, None)
        now = state.getCurrentWatermarkMs()
        out += [_timeout(i, r) for i, r in pending.items() if r[1] < now and not r[2]]
        kept = [(i, *r) for i, r in pending.items() if r[1] >= now]
        waiting = [(i, *e) for i, es in early.items() for e in es if e[0] + wait_ms >= now]
        if kept or waiting:
            state.update((kept, waiting))
            due = min([r[2] for r in kept] + [e[1] + wait_ms for e in waiting])
            state.setTimeoutTimestamp(max(due, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["request_id", "outcome", "action", "reason", "requested_ms", "resolved_ms", "payload"])

    return run


def _move(at: int, kind: str, action: str, reason: str) -> tuple:
    """A decision or cancel in the order in which they count: by time, decisions first."""
    return (at, kind != "decision", action, reason)


def _settled(request_id: str, state, move: tuple) -> tuple:
    at, cancelled, action, reason = move
    if at > state[1]:
        return _timeout(request_id, state)
    if cancelled:
        return (request_id, "cancelled", "error", TIMEOUT_REASON, state[0], at, state[3])
    return (request_id, "reviewed", action or None, reason or None, state[0], at, state[3])


def _timeout(request_id: str, state) -> tuple:
    return (request_id, "timeout", "error", TIMEOUT_REASON, state[0], state[1], state[3])


def gate(events: DataFrame, lateness: str = "1 hour", hours: float = REVIEW_HOURS, buckets: int = BUCKETS) -> DataFrame:
    """``OUTCOME`` of a stream of ``(request_id, ts, kind, action, reason, payload)``: the payload of a
    request comes out with its outcome. An event without a time is left out."""
    settled = (
        events.filter("ts is not null").withWatermark("ts", lateness)
        .select(
            F.pmod(F.xxhash64("request_id"), F.lit(buckets)).alias("bucket"), "request_id", "ts", F.unix_millis("ts").alias("at_ms"),
            "kind", "action", "reason", "payload",
        )
        .groupBy("bucket")
        .applyInPandasWithState(review_gate(hours), _SETTLED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
    return settled.select(
        "request_id", "outcome", "action", "reason", F.timestamp_millis("requested_ms").alias("requested_at"),
        F.timestamp_millis("resolved_ms").alias("resolved_at"), "payload",
    )


def review_outcomes(events: DataFrame, lateness: str = "1 hour", hours: float = REVIEW_HOURS) -> DataFrame:
    """Outcomes of a stream of ``(request_id, ts, kind, action, reason)`` with kinds
    request, decision and cancel. A timeout is emitted when the watermark (event time
    minus ``lateness``) passes the deadline, so an idle stream needs a heartbeat row."""
    return gate(events.withColumn("payload", F.lit(None).cast("string")), lateness, hours).drop("payload")
