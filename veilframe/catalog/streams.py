"""Registered queries: streams over the given tables, run to the end of their input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import schemas
from veilframe.catalog import fixtures, sqlparts as S
from veilframe.catalog.requests import log_sql
from veilframe.catalog.trail import AUDIT, audit
from veilframe.functions.masking import BUNDLED, Policy
from veilframe.plans.gateway import Context
from veilframe.sources import commits, logs
from veilframe.sources.storage import new_path
from veilframe.streaming import requests as streams
from veilframe.streaming import resume, review

QUERIES, ORACLES = {}, {}

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = fixtures.source(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


def _request_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as they arrive; every tenth is delivered twice."""
    sql = fixtures.REQUESTS.replace("FROM events", "FROM {given}").replace('"limit"', "limit")
    sql = sql.replace("{given}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{given}")
    rows = spark.sql(sql, given=_events(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))
    copies = F.when(F.col("request_id").cast("long") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("_copy", F.explode(copies)).drop("_copy")


def stream_admission(spark: SparkSession, sf: str) -> DataFrame:
    stream = streams.admitted_stream(streams.deduplicate(_request_stream(spark, sf), "40 days"))
    slim = stream.select("request_id", "role", "gate", F.size("inbound_detections").alias("n_inbound"), "rbac_reason")
    return streams.run_to_table(slim, spark, new_path(spark, "admission"), new_path(spark, "position"))


QUERIES["stream_admission"] = stream_admission
ORACLES["stream_admission"] = log_sql(
    "SELECT request_id, role, gate, coalesce(n_in, 0) AS n_inbound, rbac_reason FROM final"
)


def stream_gateway(spark: SparkSession, sf: str) -> DataFrame:
    """All stages per micro-batch; audit records with the entries written beside them."""
    paths = {name: new_path(spark, name) for name in ("audit", "review", "vault")}
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # ids of weeks do not fit the heap
    try:
        query = streams.start_gateway(
            _request_stream(spark, sf), fixtures.bank(sf), paths, new_path(spark, "position"), "40 days", once=True
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    from veilframe import schemas

    records = logs.read_log(spark, paths["audit"])
    queued = logs.read_log(spark, paths["review"], schemas.REVIEW)
    reviews = queued.groupBy("request_id").agg(F.count("*").alias("reviews"))
    return records.join(reviews, "request_id", "left").select(
        "request_id", "status", F.size("outbound_detections").alias("n_outbound"), "review_queue_id",
        F.coalesce("reviews", F.lit(0)).alias("reviews"),
    )


QUERIES["stream_gateway"] = stream_gateway
ORACLES["stream_gateway"] = log_sql(
    "SELECT request_id, status, CASE WHEN gate = 'run' THEN coalesce(n_out, 0) ELSE 0 END AS n_outbound, "
    "CASE WHEN review AND gate = 'run' THEN " + S.uuid_of("concat_ws('|', request_id, 'outbound', 'review')") + " END AS review_queue_id, "
    "CASE WHEN review AND gate = 'run' THEN 1 ELSE 0 END AS reviews FROM final"
)


def stream_log_tail(spark: SparkSession, sf: str) -> DataFrame:
    """A log read as a stream in two runs from one checkpoint; each record comes once."""
    path, position, out = new_path(spark, "log"), new_path(spark, "position"), new_path(spark, "tail")
    rows = audit(spark, sf)
    for part in (0, 1):
        logs.append_log(rows.filter(F.col("request_id").cast("long") % 2 == part), path)
        seen = streams.run_to_table(
            logs.tail_log(spark, path).select("request_id", "status", F.size("inbound_detections").alias("n_inbound")),
            spark, out, position,
        )
    return seen


QUERIES["stream_log_tail"] = stream_log_tail
ORACLES["stream_log_tail"] = f"WITH a AS ({AUDIT}) SELECT request_id, status, n_in AS n_inbound FROM a"

# every event asks for review; decisions and cancels follow some of them
REVIEW_EVENTS = """SELECT CAST(event_id AS STRING) AS request_id, ts + hours * INTERVAL '1' HOUR AS ts, kind, action,
 'by rule' AS reason FROM (
 SELECT event_id, ts, 0 AS hours, 'request' AS kind, CAST(NULL AS STRING) AS action FROM events
 UNION ALL SELECT event_id, ts, 2, 'decision', 'allow' FROM events WHERE event_id % 6 = 0
 UNION ALL SELECT event_id, ts, 5, 'decision', 'block' FROM events WHERE event_id % 12 = 0
 UNION ALL SELECT event_id, ts, 3, 'cancel', NULL FROM events WHERE event_id % 6 = 1
 UNION ALL SELECT event_id, ts, 29, 'decision', 'allow' FROM events WHERE event_id % 6 = 2
 UNION ALL SELECT event_id + 10000000, ts, 1, 'cancel', NULL FROM events WHERE event_id % 50 = 0) e"""


def stream_review_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        branches = F.array(
            *[
                F.when(
                    condition,
                    F.struct(
                        (F.col("event_id") + shift).alias("id"), F.lit(hours).alias("hours"), F.lit(kind).alias("kind"),
                        F.lit(action).cast("string").alias("action"),
                    ),
                )
                for condition, shift, hours, kind, action in (
                    (F.lit(True), 0, 0, "request", None),
                    (F.col("event_id") % 6 == 0, 0, 2, "decision", "allow"),
                    (F.col("event_id") % 12 == 0, 0, 5, "decision", "block"),
                    (F.col("event_id") % 6 == 1, 0, 3, "cancel", None),
                    (F.col("event_id") % 6 == 2, 0, 29, "decision", "allow"),
                    (F.col("event_id") % 50 == 0, 10000000, 1, "cancel", None),
                )
            ]
        )
        events = (
            _events(spark, sf).select(F.col("ts").cast("timestamp").alias("t"), F.explode(branches).alias("e"))
            .filter("e is not null")
            .select(
                F.col("e.id").cast("string").alias("request_id"),
                (F.col("t") + F.make_dt_interval(hours=F.col("e.hours"))).alias("ts"),
                "e.kind", "e.action", F.lit("by rule").alias("reason"),
            )
        )
        outcomes = review.review_outcomes(events, "1 hour").select("request_id", "outcome", "action", "reason")
        return streams.run_to_table(outcomes, spark, new_path(spark, "outcomes"), new_path(spark, "position"))
    finally:
        spark.conf.set(_STORE, before)


QUERIES["stream_review_outcomes"] = stream_review_outcomes
ORACLES["stream_review_outcomes"] = (
    f"WITH e AS ({REVIEW_EVENTS}), horizon AS (SELECT max(ts) - INTERVAL '1' HOUR AS w FROM e), "
    "req AS (SELECT request_id, ts FROM e WHERE kind = 'request'), "
    "first_move AS (SELECT r.request_id, r.ts, arg_min(e.kind, e.ts) AS kind, arg_min(coalesce(e.action, '-'), e.ts) AS action, min(e.ts) AS moved "
    "FROM req r LEFT JOIN e ON e.request_id = r.request_id AND e.kind <> 'request' GROUP BY 1, 2) "
    "SELECT request_id, CASE WHEN moved <= ts + INTERVAL '24' HOUR THEN CASE kind WHEN 'cancel' THEN 'cancelled' ELSE 'reviewed' END ELSE 'timeout' END AS outcome, "
    "CASE WHEN moved <= ts + INTERVAL '24' HOUR AND kind = 'decision' THEN action ELSE 'error' END AS action, "
    "CASE WHEN moved <= ts + INTERVAL '24' HOUR AND kind = 'decision' THEN 'by rule' ELSE 'Request cancelled or human review timeout' END AS reason "
    "FROM first_move, horizon WHERE moved IS NOT NULL OR ts + INTERVAL '24' HOUR <= w"
)

# --- sinks that become visible together -------------------------------------------------------
_VAULT_RULE = ("outbound", "private_email")
_VAULT_REASON = "Addresses go to the vault"
VAULTED = {
    name: Policy(name, policy.version, {**policy.rules, _VAULT_RULE: ("vault", _VAULT_REASON)}) for name, policy in BUNDLED.items()
}


def _with_rule(sql: str, rule: tuple[str, str], action: str, reason: str) -> str:
    """A twin under policies that differ from the bundled ones in one rule."""
    for name, policy in BUNDLED.items():
        old_action, old_reason = policy.rules[rule]
        key = f"({S.text(name)}, '{rule[0]}', '{rule[1]}'"
        sql = sql.replace(f"{key}, '{old_action}', {S.text(old_reason)})", f"{key}, '{action}', {S.text(reason)})")
    return sql


def gateway_vault(spark: SparkSession, sf: str) -> DataFrame:
    """Vault, review queue and audit log of two batches, read back from their sinks. A third batch has
    written its audit log only and is not there; the two are merged into one before they are read."""
    paths = {name: new_path(spark, name) for name in ("audit", "review", "vault", "manifest")}
    requests, context = fixtures.requests(spark, sf), Context(policies=VAULTED)
    for batch in (0, 1):
        streams.process_batch(requests.filter(F.col("request_id").cast("long") % 2 == batch), batch, fixtures.bank(sf), paths, context)
    logs.write_batch(logs.read_log(spark, paths["audit"]).limit(10), paths["audit"], 2)
    commits.merge(spark, paths, commits.SINKS, "merged")
    commits.clean(spark, paths, list(commits.SINKS))  # nobody else reads what was merged
    read = {name: commits.read_committed(spark, paths[name], paths["manifest"], name, schema) for name, schema in commits.SINKS.items()}
    records = read["audit"].select("request_id", "status")
    reviews = read["review"].groupBy("request_id").agg(F.count("*").alias("reviews"))
    return read["vault"].join(records, "request_id").join(reviews, "request_id", "left").select(
        "request_id", "status", "category", F.sha2("original_text", 256).alias("original_hash"), "vault_ref", F.coalesce("reviews", F.lit(0)).alias("reviews"),
    )


QUERIES["gateway_vault"] = gateway_vault
ORACLES["gateway_vault"] = _with_rule(log_sql(
    ", placed_spans AS (SELECT f.request_id, f.status, f.review, j.category, j.s, j.e, j.span_text FROM final f JOIN outs o ON f.gate = 'run' AND o.kind = f.kind AND o.role = f.role "
    "AND o.call_key = f.key JOIN judged j ON j.k = o.o WHERE j.action = 'vault' AND NOT coalesce(f.blocked, false)) "
    "SELECT request_id, status, category, sha256(span_text) AS original_hash, "
    + S.uuid_of("concat_ws('|', request_id, 'outbound', CAST(s AS VARCHAR), CAST(e AS VARCHAR), category)")
    + " AS vault_ref, CAST(CASE WHEN review THEN 1 ELSE 0 END AS BIGINT) AS reviews FROM placed_spans"
).replace("FROM stated) , placed_spans", "FROM stated), placed_spans"), _VAULT_RULE, "vault", _VAULT_REASON)

# --- review end to end: requests wait, decisions come before or after them, the rest times out ---
_RULE = ("inbound", "private_email")
_REASON = "Addresses of people need a look first"
REVIEWED = {
    name: Policy(name, policy.version, {**policy.rules, _RULE: ("review", _REASON)}) for name, policy in BUNDLED.items()
}
# (condition on the event id, hours after the request, kind, action)
_MOVES = (
    ("event_id % 6 = 0", 2, "decision", "allow"), ("event_id % 12 = 0", 5, "decision", "block"), ("event_id % 6 = 1", 3, "cancel", None),
    ("event_id % 6 = 2", 29, "decision", "allow"), ("event_id % 6 = 3", 1, "decision", "block"),
)


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions and cancels for some of the requests, and a last row far behind all of them."""
    events = fixtures.source(spark, sf, "events")
    parts = [
        events.filter(condition).select(
            F.col("event_id").cast("string").alias("request_id"), (F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))).alias("ts"),
            F.lit(kind).alias("kind"), F.lit(action).cast("string").alias("action"), F.lit("by rule").alias("reason"),
        )
        for condition, hours, kind, action in _MOVES
    ]
    last = events.agg((F.max("ts").cast("timestamp") + F.make_dt_interval(days=F.lit(90))).alias("ts")).filter("ts is not null").select(
        F.lit("heartbeat").alias("request_id"), "ts", F.lit("cancel").alias("kind"), F.lit(None).cast("string").alias("action"), F.lit("").alias("reason")
    )
    return reduce(DataFrame.unionByName, parts).withColumn("part", F.col("request_id").cast("long") % 2).unionByName(last.withColumn("part", F.lit(1).cast("long")))


def stream_review_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Audit records of requests of which some wait for a review. Decisions on even requests are read
    before the requests, those on odd ones after them. Intermediate folders stay in the shared one
    until the caller clears it, as those of the other streams do."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        paths = {name: new_path(spark, name) for name in ("audit", "review", "vault", "held")}
        told, gateway_at, review_at = (new_path(spark, name) for name in ("decisions", "position", "position"))
        bank, context = fixtures.bank(sf), Context(policies=REVIEWED)
        moves = _moves(spark, sf)
        logs.write_batch(spark.createDataFrame([], schemas.HELD), paths["held"], "none")

        def reviews() -> None:
            held = logs.tail_batches(spark, paths["held"], schemas.HELD)
            decisions = spark.readStream.schema(schemas.REVIEW_EVENTS).parquet(told)
            resume.start_reviews(held, decisions, bank, paths, review_at, "60 days", context=context, once=True).awaitTermination()

        moves.filter("part = 0").drop("part").write.parquet(told)
        reviews()
        streams.start_gateway(_request_stream(spark, sf), bank, paths, gateway_at, "40 days", context, once=True).awaitTermination()
        moves.filter("part = 1").drop("part").write.mode("append").parquet(told)
        reviews()
        records = logs.read_log(spark, paths["audit"])
        last = F.max_by(F.struct("status", "tool_output_final"), F.struct("timestamp_utc", F.col("status") != "review_queued"))
        return records.groupBy("request_id").agg(
            F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_list("status")), ",").alias("statuses"),
            F.date_format(F.max("timestamp_utc"), "yyyy-MM-dd HH:mm:ss").alias("settled_at"), last["status"].alias("status"), F.sha2(last["tool_output_final"], 256).alias("output_hash"),
        )
    finally:
        spark.conf.set(_STORE, before)


QUERIES["stream_review_resumed"] = stream_review_resumed


def _moved() -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(event_id AS VARCHAR) AS request_id, ts + {hours} * INTERVAL '1' HOUR AS moved_at, '{kind}' AS kind, {S.text(action) if action else 'NULL'} AS action FROM events WHERE {condition}"
        for condition, hours, kind, action in _MOVES
    )


def _resumed_sql() -> str:
    sql = log_sql(
        f", moves AS ({_moved()}), first_move AS (SELECT m.request_id, arg_min(m.kind, m.moved_at) AS kind, arg_min(coalesce(m.action, '-'), m.moved_at) AS action, min(m.moved_at) AS moved_at FROM moves m GROUP BY 1), "
        "held AS (SELECT f.*, vi.review AND f.gate = 'run' AS waits FROM final f LEFT JOIN in_verdicts vi ON vi.k = f.request_id), "
        "settled AS (SELECT h.*, m.moved_at <= h.ts + INTERVAL '24' HOUR AS intime, m.kind AS kind_of_move, m.action AS action_of_move, m.moved_at FROM held h LEFT JOIN first_move m USING (request_id)), "
        "ended AS (SELECT *, CASE WHEN waits IS NOT TRUE THEN status WHEN intime IS NOT TRUE OR kind_of_move = 'cancel' THEN 'error' WHEN action_of_move = 'block' THEN 'blocked' ELSE status END AS last_status, "
        "CASE WHEN waits THEN CASE WHEN intime THEN moved_at ELSE ts + INTERVAL '24' HOUR END ELSE ts END AS settled FROM settled) "
        "SELECT request_id, CAST(CASE WHEN waits THEN 2 ELSE 1 END AS BIGINT) AS records, CASE WHEN waits THEN array_to_string(list_sort([last_status, 'review_queued']), ',') ELSE last_status END AS statuses, "
        "strftime(settled, '%Y-%m-%d %H:%M:%S') AS settled_at, last_status AS status, "
        "sha256(CASE WHEN last_status = 'success' THEN out_text ELSE '' END) AS output_hash FROM ended"
    ).replace("FROM stated) , moves", "FROM stated), moves")
    return _with_rule(sql, _RULE, "review", _REASON)


ORACLES["stream_review_resumed"] = _resumed_sql()
