"""Requests that wait for a review, from the gateway to their second record."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_requests import frame, request
from veilframe import schemas
from veilframe.functions.masking import BUNDLED, Policy
from veilframe.plans import gateway
from veilframe.sources import commits, logs, seen
from veilframe.streaming import requests as streams
from veilframe.streaming import resume

T0 = datetime(2026, 1, 2, 3, 4, 5)
RULES = {("inbound", "private_email"): ("review", "look"), ("outbound", "private_phone"): ("vault", "v")}
CONTEXT = gateway.Context(policies={n: Policy(n, f"{n}_x", RULES) for n in BUNDLED})
HELD = "SELECT id, phone FROM customers WHERE id = {} OR email = 'a@b.com'"


def _write(folder, number, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"request_id": i, "ts": (T0 + timedelta(hours=h)).isoformat(), "kind": k, "action": a, "reason": "r"}) for i, h, k, a in rows]
    path = folder / f"{number:03d}.json"
    path.write_text("\n".join(lines))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


@pytest.mark.parametrize("order", ["requests first", "decisions first"])
def test_review_ends_in_a_second_record(spark, bank, tmp_path, order):
    rows = [request(i, "analyst", "sql_query", HELD.format(i)) for i in range(1, 7)] + [request(9, "analyst", "sql_query", "SELECT id FROM customers WHERE id = 1")]
    source = tmp_path / "in"
    frame(spark, rows).coalesce(1).write.parquet(str(source))
    decisions = [("1", 2, "decision", "allow"), ("1", 3, "decision", "block"), ("2", 1, "decision", "block"), ("3", 5, "cancel", None), ("4", 25, "decision", "allow"), ("5", 23, "decision", "allow"), ("77", 1, "decision", "allow")]
    late = [("heart", 24 * 40, "cancel", None)]
    paths = {n: str(tmp_path / n) for n in ("audit", "review", "vault", "held", "manifest")}
    logs.write_batch(spark.createDataFrame([], schemas.HELD), paths["held"], "none")

    def requests():
        stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
        streams.start_gateway(stream, bank, paths, str(tmp_path / "cp1"), context=CONTEXT, once=True).awaitTermination()

    def reviews(number, events):
        _write(tmp_path / "events", number, events)
        told = spark.readStream.schema(schemas.REVIEW_EVENTS).json(str(tmp_path / "events"))
        held = logs.tail_batches(spark, paths["held"], schemas.HELD)
        resume.start_reviews(held, told, bank, paths, str(tmp_path / "cp2"), "30 days", context=CONTEXT, once=True).awaitTermination()

    if order == "requests first":
        requests()
        reviews(0, [])
        reviews(1, decisions + late)
    else:
        reviews(0, decisions)
        requests()
        reviews(1, late)
    audit = commits.read_committed(spark, paths["audit"], paths["manifest"], "audit", schemas.AUDIT).collect()
    by_id = {}
    for r in audit:
        by_id.setdefault(r.request_id, []).append(r)
    statuses = {i: sorted((r.status for r in rs), key=lambda s: s != "review_queued") for i, rs in by_id.items()}
    assert statuses == {
        "1": ["review_queued", "success"], "2": ["review_queued", "blocked"], "3": ["review_queued", "error"], "4": ["review_queued", "error"],
        "5": ["review_queued", "success"], "6": ["review_queued", "error"], "9": ["success"],
    }
    final = {i: next(r for r in rs if r.status != "review_queued") for i, rs in by_id.items()}
    assert final["1"].timestamp_utc == T0 + timedelta(hours=2) and final["4"].timestamp_utc == T0 + timedelta(hours=24)
    assert json.loads(final["1"].tool_output_final)[0]["id"] == 1 and [d.category for d in final["1"].inbound_detections] == ["private_email"]
    assert final["1"].raw_query_hash == by_id["1"][0].raw_query_hash and final["1"].actor.user_id == "u1"
    vault = commits.read_committed(spark, paths["vault"], paths["manifest"], "vault", schemas.VAULT).collect()
    assert {v.request_id for v in vault} == {"1", "5"} and all(v.vault_ref in final[v.request_id].tool_output_final for v in vault)


def test_replay_of_outcomes_changes_nothing(spark, bank, tmp_path):
    admitted = gateway.admit(frame(spark, [request(i, "analyst", "sql_query", HELD.format(i)) for i in (1, 2)]), CONTEXT)
    log = gateway.finish(admitted, gateway.execute(admitted, bank, CONTEXT), CONTEXT)
    held = streams.held_requests(log)
    back = resume.released(held.select("request_id", F.lit("reviewed").alias("outcome"), F.lit("allow").alias("action"), F.lit("r").alias("reason"), F.col("ts").alias("resolved_at"), "payload"))
    names = [c for c in admitted.columns if c not in ("gate", "review_decision", "call_key")]
    assert sorted(map(str, back.select(*names).collect())) == sorted(map(str, admitted.select(*names).collect()))
    outcomes = held.select("request_id", F.lit("reviewed").alias("outcome"), F.lit("allow").alias("action"), F.lit("r").alias("reason"), F.col("ts").alias("requested_at"), F.col("ts").alias("resolved_at"), "payload")
    paths = {n: str(tmp_path / n) for n in ("audit", "review", "vault", "manifest")}
    for _ in range(2):
        resume.process_outcomes(outcomes, 3, bank, paths, CONTEXT)
    assert logs.read_log(spark, paths["audit"]).count() == 2
    assert [r.batch for r in commits.committed(spark, paths["manifest"]).collect()] == ["resumed-3"]


def test_batch_that_fails_between_sinks_is_not_there(spark, bank, tmp_path, monkeypatch):
    paths = {n: str(tmp_path / n) for n in ("audit", "review", "vault", "manifest")}
    rows = frame(spark, [request(i, "analyst", "sql_query", f"SELECT id, phone FROM customers WHERE id = {i}") for i in range(4)])
    read = lambda name: commits.read_committed(spark, paths[name], paths["manifest"], name, commits.SINKS[name])
    streams.process_batch(rows.filter("request_id < '2'"), 0, bank, paths, CONTEXT)
    whole = streams.gateway.vault_entries
    monkeypatch.setattr(streams.gateway, "vault_entries", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        streams.process_batch(rows.filter("request_id >= '2'"), 1, bank, paths, CONTEXT)
    monkeypatch.setattr(streams.gateway, "vault_entries", whole)
    assert logs.read_log(spark, paths["audit"]).count() == 4 and {r.request_id for r in read("audit").collect()} == {"0", "1"}
    for _ in range(2):
        streams.process_batch(rows.filter("request_id >= '2'"), 1, bank, paths, CONTEXT)
    before = {n: sorted(map(str, read(n).collect())) for n in commits.SINKS}
    assert len(before["audit"]) == 4 and len(before["vault"]) >= 3
    assert commits.merge(spark, paths, commits.SINKS, "merged-1") == 2
    assert commits.merge(spark, paths, commits.SINKS, "merged-2") == 0
    assert {n: sorted(map(str, read(n).collect())) for n in commits.SINKS} == before
    commits.clean(spark, paths, list(commits.SINKS))
    assert {n: sorted(map(str, read(n).collect())) for n in commits.SINKS} == before
    assert {d for d in os.listdir(paths["audit"]) if d.startswith("batch_id")} == {"batch_id=merged-1"}
    streams.process_batch(rows.filter("request_id >= '2'"), 1, bank, paths, CONTEXT)  # merged, so known
    assert read("audit").count() == 4


def test_late_duplicates_are_known(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "seen")
    make = lambda ids: spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "request_id string, n long")
    got = lambda ids, batch: sorted((r.request_id or "-") for r in seen.unseen(make(ids), path, batch, buckets=8).collect())
    assert got(["a", "b", "a", None, None], 0) == ["-", "-", "a", "b"]
    assert got(["b", "c"], 1) == ["c"]
    assert got(["b", "c"], 1) == ["c"]  # the batch again
    assert got(["a", "b", "c", "d"], "resumed-2") == ["d"]
    assert got([], 3) == []
    monkeypatch.setattr(seen, "INLINE", 2)
    assert got([str(i) for i in range(50)] + ["a"], 4) == sorted(str(i) for i in range(50))
    assert got(["7", "a", "x", "y"], 5) == ["x", "y"]
    assert spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold") == "10"


def test_duplicate_behind_the_horizon_gives_no_second_record(spark, bank, tmp_path):
    source = tmp_path / "in"
    paths = {n: str(tmp_path / n) for n in ("audit", "review", "vault", "seen")}
    for shift, ids in ((0, [1, 2]), (90, [2, 3])):
        rows = frame(spark, [request(i, "analyst", "sql_query", "SELECT id FROM customers WHERE id = 1") for i in ids])
        rows.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(shift))).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        streams.start_gateway(stream, bank, paths, str(tmp_path / "cp"), "1 hour", once=True).awaitTermination()
    assert sorted(r.request_id for r in logs.read_log(spark, paths["audit"]).collect()) == ["1", "2", "3"]


def test_batch_runs_with_few_partitions_of_state_and_adaptive_plans(spark, bank, tmp_path, monkeypatch):
    paths = {n: str(tmp_path / n) for n in ("audit", "review", "vault")}
    rows = frame(spark, [request(i, "analyst", "sql_query", "SELECT id FROM customers WHERE id = 1") for i in range(3)])
    rows.write.parquet(str(tmp_path / "in"))
    seen, whole = [], streams.process_batch

    def watched(requests, *rest):
        seen.append(tuple(requests.sparkSession.conf.get(f"spark.sql.{n}") for n in ("shuffle.partitions", "adaptive.enabled")))
        whole(requests, *rest)

    monkeypatch.setattr(streams, "process_batch", watched)
    with streams.set_for(spark, {"spark.sql.shuffle.partitions": "150"}):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        streams.start_gateway(stream, bank, paths, str(tmp_path / "cp"), once=True).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "150"
    parts = [n for n in os.listdir(tmp_path / "cp" / "state" / "0") if n.isdigit()]
    assert len(parts) == min(150, streams.STATE_PARTITIONS * spark.sparkContext.defaultParallelism)
    assert set(seen) == {("150", "true")} and logs.read_log(spark, paths["audit"]).count() == 3


def test_kinds_that_nobody_calls_are_not_run(spark, bank, tmp_path, monkeypatch):
    for name in ("query_rows", "row_texts", "lookup_outputs", "search_outputs"):
        monkeypatch.setattr(gateway, name, lambda *a: 1 / 0)
    admitted = gateway.admit(frame(spark, [request(1, "analyst", "sql_query", HELD.format(1)), request(2, "guest", "shell", None), request(3, "intern", "sql_query", "SELECT ssn FROM customers")]), CONTEXT)
    log = gateway.finish(admitted, gateway.execute(admitted, bank, CONTEXT), CONTEXT)
    assert {r.request_id: r.status for r in log.collect()} == {"1": "review_queued", "2": "rbac_denied", "3": "rbac_denied"}
    streams.write_sinks(log, 0, {n: str(tmp_path / n) for n in ("audit", "review", "vault")})
    assert logs.read_log(spark, str(tmp_path / "audit")).count() == 3
