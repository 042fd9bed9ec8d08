"""What batches leave on disk, and what is kept of them."""

import os

from pyspark.sql import functions as F

from tests.test_requests import frame, request
from tests.test_trail import record
from veilframe import schemas
from veilframe.catalog import streams as catalog
from veilframe.functions.masking import BUNDLED, Policy
from veilframe.plans import gateway
from veilframe.sources import commits, logs
from veilframe.streaming import requests as streams

_STORE = "spark.sql.streaming.stateStore.providerClass"
_RULES = {("outbound", "private_phone"): ("vault", "v")}


def _files(path):
    return sorted(f for base, _, files in os.walk(path) for f in files if f.startswith("part-"))


def _size(path):
    return sum(os.path.getsize(f"{base}/{f}") for base, _, files in os.walk(path) for f in files)


def test_batches_are_compressed(spark, tmp_path):
    rows = spark.createDataFrame([record(i) for i in range(500)], schemas.AUDIT)
    logs.write_batch(rows, str(tmp_path / "batch"), 0)
    logs.append_log(rows, str(tmp_path / "plain"))
    assert _files(tmp_path / "batch") and all(f.endswith(".json.gz") for f in _files(tmp_path / "batch"))
    assert _size(tmp_path / "batch") * 4 < _size(tmp_path / "plain")
    assert sorted(map(str, logs.read_log(spark, str(tmp_path / "batch")).collect())) == sorted(map(str, rows.collect()))


def test_large_merges_have_several_files(spark, tmp_path, monkeypatch):
    paths = {n: str(tmp_path / n) for n in ("audit", "manifest")}
    for batch in (0, 1):
        logs.write_batch(spark.createDataFrame([record(i) for i in range(batch * 40, batch * 40 + 40)], schemas.AUDIT).repartition(4), paths["audit"], batch)
        commits.commit(spark, paths["manifest"], batch, ["audit"])
    sinks = {"audit": schemas.AUDIT}
    monkeypatch.setattr(commits, "FILE_BYTES", 100)
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda *a: 1 / 0)  # nothing is shuffled
    with streams.set_for(spark, {"spark.sql.files.openCostInBytes": "134217728"}):  # a task for each file
        assert commits.merge(spark, paths, sinks, "merged") == 2
    assert len(_files(f"{paths['audit']}/batch_id=merged")) > 1
    monkeypatch.setattr(commits, "FILE_BYTES", 1 << 20)
    logs.write_batch(spark.createDataFrame([record(99)], schemas.AUDIT), paths["audit"], 7)
    commits.commit(spark, paths["manifest"], 7, ["audit"])
    assert commits.merge(spark, paths, sinks, "again") == 2
    assert len(_files(f"{paths['audit']}/batch_id=again")) == 1
    ids = {r.request_id for r in commits.read_committed(spark, paths["audit"], paths["manifest"], "audit", schemas.AUDIT).collect()}
    assert ids == {str(i) for i in range(80)} | {"99"}


def test_stored_result_holds_what_sinks_take(spark, bank, tmp_path, monkeypatch):
    context = gateway.Context(policies={n: Policy(n, f"{n}_x", _RULES) for n in BUNDLED})
    rows = [request(i, "analyst", "sql_query", "SELECT id, phone FROM customers ORDER BY id LIMIT 3") for i in (1, 2)]
    stored, whole = {}, streams.durable

    def watched(df, name):
        stored[name] = df.schema
        return whole(df, name)

    monkeypatch.setattr(streams, "durable", watched)
    paths = {n: str(tmp_path / n) for n in ("audit", "review", "vault", "held", "totals")}
    streams.process_batch(frame(spark, rows), 0, bank, paths, context)
    assert not {"output", "response", "decisions", "outbound_decision", "whole"} & set(stored["log"].names)
    assert "mutated_text" not in stored["log"]["outbound"].dataType.names
    log = gateway.run_requests(frame(spark, rows), bank, context)
    for name, schema, expected in (
        ("audit", schemas.AUDIT, gateway.audit_rows(log, F.col("ts"))), ("vault", schemas.VAULT, gateway.vault_entries(log, F.col("ts"))),
    ):
        got = logs.read_log(spark, paths[name], schema).collect()
        assert got and sorted(map(str, got)) == sorted(map(str, expected.collect()))


def test_ids_of_the_stream_are_kept_outside_the_heap(spark, sf, monkeypatch):
    usual, seen = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", []

    def started(*a, **k):
        seen.append(spark.conf.get(_STORE))
        raise KeyError

    monkeypatch.setattr(catalog.streams, "start_gateway", started)
    with streams.set_for(spark, {_STORE: usual}):
        try:
            catalog.stream_gateway(spark, sf)
        except KeyError:
            pass
        assert seen == [catalog._ROCKS] and spark.conf.get(_STORE) == usual
