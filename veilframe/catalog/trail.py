"""Registered queries: the audit trail, its files and its analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed, schemas
from veilframe.catalog import fixtures, sqlparts as S
from veilframe.operators import trail
from veilframe.plans import evaluation
from veilframe.sources import logs
from veilframe.sources.bucketed import store_bucketed
from veilframe.sources.storage import new_path

QUERIES, ORACLES = {}, {}

# flat form of an audit log, one record per event
AUDIT = """SELECT CAST(event_id AS STRING) AS request_id, event_id, ts, CAST(user_id AS STRING) AS user_id,
 CASE user_id % 3 WHEN 0 THEN 'intern' WHEN 1 THEN 'analyst' ELSE 'compliance_officer' END AS role,
 CASE event_type WHEN 'view' THEN 'customer_api' ELSE 'sql_query' END AS tool_name,
 CASE event_id % 11 WHEN 0 THEN 'rbac_denied' WHEN 1 THEN 'blocked' WHEN 2 THEN 'review_queued' WHEN 3 THEN 'error'
  WHEN 4 THEN 'timeout' ELSE 'success' END AS status,
 event_id % 4 AS n_in, event_id % 3 AS n_out,
 CASE event_id % 5 WHEN 0 THEN 'redact' WHEN 1 THEN 'hash' ELSE 'allow' END AS act_in,
 CASE event_id % 7 WHEN 0 THEN 'vault' WHEN 1 THEN 'review' ELSE 'allow' END AS act_out,
 value AS latency_ms,
 CASE WHEN event_id % 11 = 2 THEN 'rq-' || CAST(event_id AS STRING) END AS review_queue_id,
 CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN NULL WHEN user_id % 3 = 2 THEN 'strict_financial_v1' ELSE 'permissive_analyst_v1' END AS policy_version,
 CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id < 500 THEN 'detector-1' ELSE 'detector-2' END AS model_version,
 CASE WHEN event_id % 2 = 0 THEN '' ELSE 'aa' || CAST(event_id AS STRING) END AS out_hash FROM events"""


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures._derive(spark, sf, AUDIT, "events")


def audit(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in fixed.CATEGORIES])

    def category(i):
        return F.get(names, ((F.col("event_id") + i) % len(fixed.CATEGORIES)).cast("int"))

    def many(count, build, kind):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(1), F.col(count).cast("int")), build)).otherwise(
            F.array().cast(kind)
        )

    def span(i):
        return F.struct(
            category(i).alias("category"), (i * 10).alias("start"), (i * 10 + 5).alias("end"),
            F.concat(F.lit("["), category(i), F.lit("]")).alias("text"), F.lit(0.95).alias("confidence"),
        )

    def decision(action):
        return lambda i: F.struct(category(i).alias("category"), F.col(action).alias("action"), F.lit("r").alias("reason"))

    return _flat(spark, sf).select(
        "request_id", F.col("ts").cast("timestamp").alias("timestamp_utc"),
        F.struct("role", "user_id", F.col("request_id").alias("session_id")).alias("actor"), "tool_name",
        F.sha2("request_id", 256).alias("raw_query_hash"),
        many("n_in", span, schemas.SPAN_TYPE).alias("inbound_detections"),
        many("n_in", decision("act_in"), schemas.DECISION_TYPE).alias("policy_decisions_inbound"),
        F.lit("q").alias("tool_input_after_policy"), F.col("out_hash").alias("tool_output_raw_hash"),
        many("n_out", span, schemas.SPAN_TYPE).alias("outbound_detections"),
        many("n_out", decision("act_out"), schemas.DECISION_TYPE).alias("policy_decisions_outbound"),
        F.lit("o").alias("tool_output_final"), "status", "latency_ms", "review_queue_id", "policy_version", "model_version",
    )


def review(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit(spark, sf).filter("review_queue_id is not null and request_id % 5 <> 0")
    return rows.select(
        F.col("review_queue_id").alias("review_id"), "request_id", "timestamp_utc", "actor", "tool_name",
        F.when(F.col("request_id").cast("long") % 2 == 0, "inbound").otherwise("outbound").alias("direction"),
        F.col("inbound_detections").alias("detections"), F.col("raw_query_hash").alias("query_or_result_hash"),
        F.when(F.col("request_id").cast("long") % 3 == 0, "approved").otherwise("pending").alias("status"),
    )


def vault(spark: SparkSession, sf: str) -> DataFrame:
    rows = _flat(spark, sf).filter("n_out > 0 AND event_id % 7 = 0")
    return rows.select("request_id", F.explode(F.sequence(F.lit(1), F.col("n_out").cast("int"))).alias("i")).select(
        F.concat_ws("-", "request_id", "i").alias("vault_ref"), "request_id", F.lit("secret").alias("category")
    )


_CAT = "['" + "', '".join(fixed.CATEGORIES) + "'][CAST((event_id + {i}) % 8 AS BIGINT) + 1]"


def _list(count: str, item: str) -> str:
    return f"list_transform(range(1, CAST({count} AS BIGINT) + 1), lambda i: {item})"


_CATS_IN = f"array_to_string(list_sort(list_distinct({_list('n_in', _CAT.replace('{i}', 'i'))})), ',')"
_CATS_OUT = f"array_to_string(list_sort(list_distinct({_list('n_out', _CAT.replace('{i}', 'i'))})), ',')"


def layers(spark: SparkSession, sf: str) -> DataFrame:
    return trail.layer_status(audit(spark, sf))


_ACTS_IN = f"array_to_string({_list('n_in', _CAT.replace('{i}', 'i') + chr(32) + '|| ' + chr(39) + ':' + chr(39) + ' || act_in')}, ',')"
_ACTS_OUT = f"array_to_string({_list('n_out', _CAT.replace('{i}', 'i') + chr(32) + '|| ' + chr(39) + ':' + chr(39) + ' || act_out')}, ',')"
LAYERS_SQL = (
    f"WITH a AS ({AUDIT}), f AS (SELECT *, status = 'rbac_denied' AS denied, status = 'blocked' AND out_hash = '' AS b_in, status = 'blocked' AND out_hash <> '' AS b_out, "
    "status IN ('success', 'review_queued') OR (status = 'blocked' AND out_hash <> '') AS executed, "
    "status IN ('success', 'review_queued', 'timeout') OR (status = 'blocked' AND out_hash <> '') AS ran FROM a), layers AS ("
    "SELECT request_id, 1 AS layer_no, 'RBAC Gate' AS layer, CASE WHEN denied THEN 'fail' ELSE 'pass' END AS layer_status, CASE WHEN denied THEN 'Access denied' ELSE 'Access granted' END AS detail FROM f "
    f"UNION ALL SELECT request_id, 2, 'Inbound PII', CASE WHEN denied THEN 'skipped' WHEN n_in > 0 THEN 'transform' ELSE 'pass' END, CASE WHEN denied THEN '0 ' ELSE CAST(n_in AS VARCHAR) || ' ' || {_CATS_IN} END FROM f "
    f"UNION ALL SELECT request_id, 3, 'Inbound Policy', CASE WHEN denied THEN 'skipped' WHEN b_in THEN 'fail' WHEN n_in > 0 AND act_in <> 'allow' THEN 'transform' ELSE 'pass' END, CASE WHEN denied THEN '' ELSE {_ACTS_IN} END FROM f "
    "UNION ALL SELECT request_id, 4, 'Execution', CASE WHEN executed THEN 'pass' WHEN status IN ('timeout', 'error') THEN 'fail' ELSE 'skipped' END, CAST(round(latency_ms, 1) AS VARCHAR) FROM f "
    f"UNION ALL SELECT request_id, 5, 'Outbound PII', CASE WHEN NOT ran THEN 'skipped' WHEN n_out > 0 THEN 'transform' ELSE 'pass' END, CASE WHEN ran THEN CAST(n_out AS VARCHAR) || ' ' || {_CATS_OUT} ELSE '0 ' END FROM f "
    f"UNION ALL SELECT request_id, 6, 'Outbound Policy', CASE WHEN NOT ran THEN 'skipped' WHEN b_out THEN 'fail' WHEN n_out > 0 AND act_out <> 'allow' THEN 'transform' ELSE 'pass' END, CASE WHEN ran THEN {_ACTS_OUT} ELSE '' END FROM f "
    "UNION ALL SELECT request_id, 7, 'Audit Log', 'pass', status || CASE WHEN review_queue_id IS NULL THEN '' ELSE ' queued' END FROM f) "
)
QUERIES["layer_status"] = layers
ORACLES["layer_status"] = LAYERS_SQL + "SELECT * FROM layers"


def layer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return trail.layer_counts(audit(spark, sf))


QUERIES["layer_counts"] = layer_counts
ORACLES["layer_counts"] = LAYERS_SQL + "SELECT layer_no, layer, layer_status, count(*) AS records FROM layers GROUP BY 1, 2, 3"


def detection_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = trail.detection_counts(audit(spark, sf))
    return c.select(
        "request_id", "n_inbound", F.array_join("inbound_categories", ",").alias("inbound_categories"),
        "n_outbound", F.array_join("outbound_categories", ",").alias("outbound_categories"),
    )


QUERIES["detection_counts"] = detection_counts
ORACLES["detection_counts"] = (
    f"WITH a AS ({AUDIT}) SELECT request_id, n_in AS n_inbound, {_CATS_IN} AS inbound_categories, n_out AS n_outbound, "
    f"{_CATS_OUT} AS outbound_categories FROM a"
)


def latest(spark: SparkSession, sf: str) -> DataFrame:
    return trail.latest_records(audit(spark, sf), F.col("actor.user_id")).select(
        "actor.user_id", "request_id", "status", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("at")
    )


QUERIES["latest_records"] = latest
ORACLES["latest_records"] = (
    f"WITH a AS ({AUDIT}) SELECT user_id, request_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM a "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC) = 1"
)


def policy_in_effect(spark: SparkSession, sf: str) -> DataFrame:
    form = "yyyy-MM-dd HH:mm:ss"
    return trail.policy_in_effect(audit(spark, sf)).select(
        F.coalesce("policy_version", F.lit("-")).alias("policy_version"), "model_version",
        F.date_format("first_used", form).alias("first_used"), F.date_format("last_used", form).alias("last_used"), "requests",
    )


QUERIES["policy_in_effect"] = policy_in_effect
ORACLES["policy_in_effect"] = (
    f"WITH a AS ({AUDIT}) SELECT coalesce(policy_version, '-') AS policy_version, model_version, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_used, "
    "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used, count(*) AS requests FROM a GROUP BY 1, 2"
)


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit(spark, sf)
    return rows.select(
        "request_id", evaluation.audit_complete(evaluation.required_fields(rows), F.col("status")).alias("complete")
    )


QUERIES["audit_completeness"] = completeness
ORACLES["audit_completeness"] = (
    f"WITH a AS ({AUDIT}) SELECT request_id, coalesce(model_version <> '', false) AND "
    "(status = 'rbac_denied' OR coalesce(policy_version <> '', false)) AS complete FROM a"
)


def latency(spark: SparkSession, sf: str) -> DataFrame:
    s = trail.latency_statistics(audit(spark, sf))
    return s.select("n", F.round("mean", 4).alias("mean"), F.round("p50", 6).alias("p50"), "p90", "p95", "p99")


QUERIES["latency_statistics"] = latency
ORACLES["latency_statistics"] = (
    "WITH l AS (SELECT list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m FROM events) SELECT n, round(m, 4) AS mean, "
    "round((v[CAST((n - 1) // 2 AS BIGINT) + 1] + v[CAST(n // 2 AS BIGINT) + 1]) / 2, 6) AS p50, v[CAST(floor(n * 0.9) AS BIGINT) + 1] AS p90, "
    "v[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(n * 0.99) AS BIGINT) + 1] AS p99 FROM l"
)


def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    return trail.review_summary(review(spark, sf))


_REVIEW = (
    "review AS (SELECT review_queue_id AS review_id, request_id, CASE WHEN event_id % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS direction, n_in, "
    "CASE WHEN event_id % 3 = 0 THEN 'approved' ELSE 'pending' END AS status FROM a WHERE review_queue_id IS NOT NULL AND event_id % 5 <> 0)"
)
QUERIES["review_summary"] = review_summary
ORACLES["review_summary"] = (
    f"WITH a AS ({AUDIT}), {_REVIEW} SELECT status, direction, count(*) AS entries FROM review GROUP BY 1, 2"
)


def correlation(spark: SparkSession, sf: str) -> DataFrame:
    joined = trail.correlate(audit(spark, sf), review(spark, sf), vault(spark, sf))
    return joined.select("request_id", "status", "review_status", "review_detections", "vault_entries")


QUERIES["audit_review_vault"] = correlation
ORACLES["audit_review_vault"] = (
    f"WITH a AS ({AUDIT}), {_REVIEW} SELECT a.request_id, a.status, r.status AS review_status, r.n_in AS review_detections, "
    "CASE WHEN a.n_out > 0 AND a.event_id % 7 = 0 THEN a.n_out ELSE 0 END AS vault_entries FROM a LEFT JOIN review r ON r.review_id = a.review_queue_id"
)


def correlation_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same over logs that are stored in buckets of the request id: no log is shuffled."""
    run = uuid.uuid4().hex
    tables = [store_bucketed(build(spark, sf), f"{name}_{run}") for name, build in (("audit", audit), ("review", review), ("vault", vault))]
    joined = trail.correlate_stored(*tables)
    return joined.select("request_id", "status", "review_status", "review_detections", "vault_entries")


QUERIES["audit_review_vault_stored"] = correlation_stored
ORACLES["audit_review_vault_stored"] = ORACLES["audit_review_vault"]


def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Written as dated JSON lines in two appends, read back with the fixed schema."""
    path = new_path(spark, "audit-log")
    rows = audit(spark, sf)
    logs.append_log(rows.filter("request_id % 2 = 0"), path, by_date=True)
    logs.append_log(rows.filter("request_id % 2 = 1"), path, by_date=True)
    back = logs.read_log(spark, path)
    return back.select(
        "request_id", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("at"), "actor.role", "status",
        F.size("inbound_detections").alias("n_inbound"), F.get("outbound_detections", 0)["text"].alias("first_outbound"),
        "latency_ms", "review_queue_id", "policy_version",
    )


QUERIES["audit_log_files"] = log_files
ORACLES["audit_log_files"] = (
    f"WITH a AS ({AUDIT}) SELECT request_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, role, status, n_in AS n_inbound, "
    f"CASE WHEN n_out > 0 THEN '[' || {_CAT.replace('{i}', '1')} || ']' END AS first_outbound, latency_ms, review_queue_id, policy_version FROM a"
)


def golden_join(spark: SparkSession, sf: str) -> DataFrame:
    """Expected outcomes joined to the audit records of the same id."""
    rows = audit(spark, sf)
    cases = _flat(spark, sf).filter("event_id % 3 = 0").select(
        F.col("request_id").alias("case_id"),
        F.when(F.col("event_id") % 11 == 0, "rbac_denied").otherwise("success").alias("expected_status"),
        F.when(F.col("event_id") % 11 == 0, "deny").otherwise("allow").alias("expected_rbac"),
        F.when(F.col("event_id") % 4 == 1, F.array(F.lit("secret"))).otherwise(F.array().cast("array<string>")).alias("expected_inbound_categories"),
    )
    return evaluation.judge_cases(cases, rows).select(
        "case_id", "status", "rbac_ok", "status_ok", "inbound_ok", "audit_ok",
        F.array_join("missing_categories", ",").alias("missing_categories"),
    )


QUERIES["golden_join"] = golden_join
ORACLES["golden_join"] = (
    f"WITH a AS ({AUDIT}), g AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'rbac_denied' ELSE 'success' END AS expected, "
    f"event_id % 4 = 1 AND NOT list_contains({_list('n_in', _CAT.replace('{i}', 'i'))}, 'secret') AS missing FROM a WHERE event_id % 3 = 0) "
    "SELECT request_id AS case_id, status, true AS rbac_ok, status = expected OR (expected = 'success' AND status = 'review_queued') AS status_ok, "
    "NOT missing AS inbound_ok, coalesce(model_version <> '', false) AND (status = 'rbac_denied' OR coalesce(policy_version <> '', false)) AS audit_ok, "
    "CASE WHEN missing THEN 'secret' ELSE '' END AS missing_categories FROM g"
)
