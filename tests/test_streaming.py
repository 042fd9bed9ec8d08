import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_requests import frame, request
from veilframe import schemas
from veilframe.plans import gateway
from veilframe.sources import logs, storage
from veilframe.streaming import requests as streams
from veilframe.streaming import review

T0 = datetime(2026, 1, 1)


def write_events(folder, number, rows):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"request_id": i, "ts": (T0 + timedelta(hours=h)).isoformat(), "kind": k, "action": a, "reason": "r"})
        for i, h, k, a in rows
    ]
    path = folder / f"{number:03d}.json"
    path.write_text("\n".join(lines))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))  # files are read in time order


def test_review_over_batches(spark, tmp_path):
    batches = [
        [("a", 0, "request", None), ("b", 0, "request", None), ("c", 0, "request", None), ("x", 1, "cancel", None)],
        [("a", 2, "decision", "allow"), ("c", 3, "cancel", None)],
        [("a", 4, "decision", "block"), ("d", 5, "request", None)],
        [("e", 30, "request", None)],
        [("b", 29, "decision", "allow"), ("d", 31, "decision", "allow"), ("e", 33, "decision", "block"), ("z", 80, "request", None)],
        [("z", 81, "decision", "allow"), ("early", 83, "decision", "allow"), ("early", 79, "decision", "block")],
        [("early", 82, "request", None)],
    ]
    expected = {("early", "reviewed", "allow"), ("a", "reviewed", "allow"), ("b", "timeout", "error"), ("c", "cancelled", "error"), ("d", "timeout", "error"), ("e", "reviewed", "block"), ("z", "reviewed", "allow")}
    for name, parts in (("many", batches), ("one", [[r for b in batches for r in b]])):
        folder = tmp_path / name
        for i, rows in enumerate(parts):
            write_events(folder, i, rows)
        source = spark.readStream.schema(schemas.REVIEW_EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))
        out = streams.run_to_table(review.review_outcomes(source, "1 hour"), spark, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"))
        assert {(r.request_id, r.outcome, r.action) for r in out.collect()} == expected, name
        assert out.count() == len(expected)


def test_gateway_stream_equals_batch(spark, bank, tmp_path):
    rows = [request(i, "analyst", "customer_api_lookup", customer_id=i) for i in range(4)]
    rows += [request(9, "compliance_officer", "sql_query", "SELECT id, date_of_birth FROM customers ORDER BY id LIMIT 2")]
    df = frame(spark, rows)
    source = tmp_path / "in"
    df.coalesce(1).write.parquet(str(source))
    df.limit(2).coalesce(1).write.mode("append").parquet(str(source))
    paths = {n: str(tmp_path / n) for n in ("audit", "review", "vault")}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    streams.start_gateway(stream, bank, paths, str(tmp_path / "cp"), once=True).awaitTermination()
    got = logs.read_log(spark, paths["audit"]).collect()
    batch = gateway.audit_rows(gateway.run_requests(df, bank), F.col("ts")).collect()
    assert sorted(map(str, got)) == sorted(map(str, batch))
    reviews = logs.read_log(spark, paths["review"], schemas.REVIEW).count()
    assert reviews == gateway.review_entries(gateway.run_requests(df, bank), F.col("ts")).count() > 0
    replay = {n: str(tmp_path / f"replay-{n}") for n in paths}
    folder = storage.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    for _ in range(2):
        streams.process_batch(df, 7, bank, replay)
    assert logs.read_log(spark, replay["review"], schemas.REVIEW).count() == reviews
    assert logs.read_log(spark, replay["audit"]).count() == len(rows)
    assert {n for n in os.listdir(folder) if n.startswith("steps-")} <= before  # only the sinks stay


def test_requests_share_bounded_state(spark, tmp_path):
    """Outcomes of many requests from the state of a few buckets, null ids and times among them."""
    rows = [(str(i), 0, "request", None) for i in range(300)] + [(str(i), 2, "decision", "allow") for i in range(0, 300, 3)]
    rows += [(None, 0, "request", None), (None, 1, "cancel", None), ("0", 1, "request", None)]
    write_events(tmp_path / "in", 0, rows)
    (tmp_path / "in" / "none.json").write_text(json.dumps({"request_id": "timeless", "kind": "request"}))
    write_events(tmp_path / "in", 1, [("heart", 60, "cancel", None)])
    source = spark.readStream.schema(schemas.REVIEW_EVENTS).json(str(tmp_path / "in"))
    query = (
        review.gate(source.withColumn("payload", F.concat(F.lit("p"), "request_id")), buckets=4)
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 4
    got = {(r.request_id, r.outcome, r.payload, r.requested_at, r.resolved_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    hour = lambda h: T0 + timedelta(hours=h)
    assert got == {(str(i), "timeout", f"p{i}", hour(0), hour(24)) if i % 3 else (str(i), "reviewed", f"p{i}", hour(0), hour(2)) for i in range(300)} | {
        (None, "cancelled", None, hour(0), hour(1))}
