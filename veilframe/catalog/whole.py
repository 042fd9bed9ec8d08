"""Registered queries: verdicts on whole results of lookups and searches, for customers with a large
share of all accounts, and golden cases of every tool."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.catalog import fixtures, sqlparts as S
from veilframe.catalog.requests import ACC, CUST, judged_cases, log_sql
from veilframe.plans import evaluation, gateway

QUERIES, ORACLES = {}, {}

_TOOLS = ("customer_api", "customer_api_lookup", "customer_api_search")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.requests(spark, sf).filter(F.col("tool_name").isin(*_TOOLS))


def _bank(sf: str):
    return fixtures.bank(sf, fixtures.HOT_BANK)


def _hot(sql: str) -> str:
    """The same over the bank with hot customers."""
    return sql.replace(fixtures.CUSTOMERS, fixtures.HOT_CUSTOMERS).replace(fixtures.ACCOUNTS, fixtures.HOT_ACCOUNTS)


def _row_ctes(asked: str) -> str:
    """CTEs over the rows of the results of ``asked`` (o, kind, role, call_key, output): ``wrow`` with
    their number and hash, ``wspan`` with spans and verdict."""
    def json(full: dict, seen: dict, rename: str = "email") -> str:
        of = lambda fields: S.json_row(fields).replace(" email ", f" {rename} ")
        return f"CASE WHEN c.role = 'analyst' THEN {of(seen)} ELSE {of(full)} END"

    people, held = json(S.CUSTOMER_FIELDS, CUST), json(S.ACCOUNT_FIELDS, ACC)
    found = json(S.CUSTOMER_FIELDS, CUST, "mail")
    spans = S.spans("wsrc")
    for name in ("raw", "placed", "ranked", "walk", "spans"):
        spans = re.sub(rf"\b{name}\b", f"w_{name}", spans)
    mode = "CASE WHEN w.role = 'compliance_officer' THEN 'strict_financial' ELSE 'permissive_analyst' END"
    return (
        f"asked AS ({asked}), wrows AS ("
        f"SELECT c.o, c.role, {people} AS j FROM asked c JOIN customers p ON c.kind = 'lookup' AND c.call_key = CAST(p.id AS VARCHAR) "
        f"UNION ALL SELECT c.o, c.role, {held} FROM asked c JOIN accounts a ON c.kind = 'lookup' AND c.call_key = CAST(a.customer_id AS VARCHAR) "
        "AND a.customer_id IN (SELECT p.id FROM customers p) "
        f"UNION ALL SELECT c.o, c.role, {found} FROM asked c JOIN hits h ON c.kind = 'search' AND c.call_key = concat_ws('|', h.name, h.asked, h.n) "
        "UNION ALL SELECT c.o, c.role, c.output FROM asked c WHERE c.output LIKE '{\"error\"%'), "
        f"wsrc AS (SELECT row_number() OVER () AS k, o, role, j AS text FROM wrows), {spans}, "
        f"wj AS (SELECT w.o, w.k, r.action FROM w_spans x JOIN wsrc w ON w.k = x.k JOIN rules r ON r.policy = {mode} AND r.direction = 'outbound' AND r.category = x.category), "
        "wrow AS (SELECT o, count(*) AS n_rows, sha256(CAST(sum(CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT)) AS VARCHAR)) AS rows_hash FROM wsrc GROUP BY o), "
        "wspan AS (SELECT o, count(*) AS n_spans, bool_or(action = 'block') AS w_blocked, bool_or(action = 'review') AS w_review FROM wj GROUP BY o)"
    )


_JOINED = (
    "FROM final f LEFT JOIN outs o ON f.gate = 'run' AND o.kind = f.kind AND o.role = f.role AND o.call_key = f.key "
    "LEFT JOIN wrow x ON x.o = o.o LEFT JOIN wspan y ON y.o = o.o"
)
_ONLY = f"f.tool_name IN ({', '.join(S.text(t) for t in _TOOLS)})"


def request_log_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The request log where results are longer than their texts: verdicts come from all rows."""
    log = gateway.run_requests(_requests(spark, sf), _bank(sf))
    totals = gateway.audit_totals(log, F.col("ts")).drop("status")
    flags = log.select("request_id", "role", "tool_name", "status", "final_action", "outbound.has_review_flag", F.size("outbound.vault").alias("vault"))
    return flags.join(totals, "request_id", "left").select(
        "request_id", "role", "tool_name", "status", "final_action", F.coalesce("has_review_flag", F.lit(False)).alias("queued"), F.coalesce("vault", F.lit(0)).alias("vaulted"),
        F.col("rows").alias("n_rows"), F.col("detections").alias("n_detections"), "rows_hash",
    )


QUERIES["request_log_whole"] = request_log_whole
ORACLES["request_log_whole"] = _hot(log_sql(
    ", " + _row_ctes("SELECT o, kind, role, call_key, output FROM outs WHERE output LIKE '%[truncated]' AND kind <> 'sql'")
    + ", vaulted AS (SELECT k, count(*) AS n FROM judged WHERE action = 'vault' GROUP BY k) "
    "SELECT f.request_id, f.role, f.tool_name, CASE WHEN f.status = 'success' AND w_blocked THEN 'blocked' ELSE f.status END AS status, "
    "CASE WHEN f.final_action IN ('deny', 'block') THEN f.final_action WHEN w_blocked THEN 'block' WHEN w_review THEN 'human_review' ELSE f.final_action END AS final_action, "
    "f.gate = 'run' AND NOT coalesce(f.blocked, false) AND NOT coalesce(w_blocked, false) AND (coalesce(f.review, false) OR coalesce(w_review, false)) AS queued, "
    "CASE WHEN f.gate = 'run' AND NOT coalesce(f.blocked, false) AND NOT coalesce(w_blocked, false) THEN CAST(coalesce(v.n, 0) AS INTEGER) ELSE 0 END AS vaulted, "
    f"n_rows, CASE WHEN n_rows IS NOT NULL THEN coalesce(n_spans, 0) END AS n_detections, rows_hash {_JOINED} LEFT JOIN vaulted v ON v.k = o.o WHERE {_ONLY}"
).replace("FROM stated) , asked", "FROM stated), asked"))


def row_results(spark: SparkSession, sf: str) -> DataFrame:
    """The variant without cut: lookups and searches row by row, whatever their number."""
    log = gateway.run_requests_by_row(_requests(spark, sf), _bank(sf))
    return log.select("request_id", "role", "tool_name", "status", "out_rows", "out_detections", "tool_output_raw_hash", F.col("review_queue_id").isNotNull().alias("queued"))


_BY_ROW = (
    "CASE WHEN f.gate <> 'run' THEN f.gate WHEN w_blocked THEN 'blocked' WHEN w_review THEN 'review_queued' ELSE 'success' END"
)
_ALL = _row_ctes("SELECT o, kind, role, call_key, output FROM outs WHERE kind <> 'sql'")
QUERIES["row_results"] = row_results
ORACLES["row_results"] = _hot(log_sql(
    f", {_ALL} SELECT f.request_id, f.role, f.tool_name, {_BY_ROW} AS status, n_rows AS out_rows, "
    "CASE WHEN n_rows IS NOT NULL THEN coalesce(n_spans, 0) END AS out_detections, rows_hash AS tool_output_raw_hash, "
    f"{_BY_ROW} = 'review_queued' AS queued {_JOINED} WHERE {_ONLY}"
).replace("FROM stated) , asked", "FROM stated), asked"))

# what the golden cases of lookups and searches expect; not all of them come true
_EXPECTED_STATUS = (
    "CASE WHEN role = 'intern' THEN 'rbac_denied' WHEN role = 'compliance_officer' AND tool_name <> 'customer_api_search' "
    f"AND customer_id <> {fixtures.HOT['date']} THEN 'blocked' ELSE 'success' END"
)
_EXPECTED_FOUND = "CASE WHEN role <> 'intern' AND email LIKE '%@%' THEN {one} ELSE {none} END"
_CASE_USER = "CASE WHEN CAST(request_id AS BIGINT) % 13 = 0 THEN '' ELSE user_id END"


def tool_cases(spark: SparkSession, sf: str) -> DataFrame:
    found = _EXPECTED_FOUND.format(one="array('private_email')", none="CAST(array() AS array<string>)")
    return _requests(spark, sf).filter("role <> 'guest'").selectExpr(
        "*", "request_id AS case_id", f"{_EXPECTED_STATUS} AS expected_status",
        f"CASE WHEN {_EXPECTED_STATUS} = 'rbac_denied' THEN 'deny' ELSE 'allow' END AS expected_rbac", f"{found} AS expected_inbound_categories",
    ).withColumn("user_id", F.expr(_CASE_USER))


def evaluation_tools(spark: SparkSession, sf: str) -> DataFrame:
    checked = evaluation.evaluate_cases(tool_cases(spark, sf), _bank(sf))
    return checked.select(
        "case_id", "status", "rbac_ok", "status_ok", "inbound_ok", "audit_ok", F.array_join("missing_categories", ",").alias("missing_categories"),
    )


QUERIES["evaluation_tools"] = evaluation_tools
ORACLES["evaluation_tools"] = _hot(log_sql(
    f", {_ALL}, cases AS (SELECT f.request_id AS case_id, f.ts, f.role, f.tool_name, {_CASE_USER.replace('request_id', 'f.request_id').replace('user_id', 'f.user_id')} AS user_id, {_BY_ROW} AS status, "
    f"{_EXPECTED_STATUS.replace('role', 'f.role')} AS expected, {_EXPECTED_FOUND.format(one='[' + S.text('private_email') + ']', none='CAST([] AS VARCHAR[])').replace('role', 'f.role')} AS wanted "
    f"{_JOINED} WHERE {_ONLY} AND f.role <> 'guest'), " + judged_cases("cases") + " SELECT * FROM checked"
).replace("FROM stated) , asked", "FROM stated), asked"))
