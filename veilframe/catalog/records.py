"""Registered queries: entries for callers, defaults of records, golden files, blank texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import schemas
from veilframe.catalog import fixtures, sqlparts as S
from veilframe.catalog.requests import log_sql
from veilframe.functions.spans import scan_summary
from veilframe.operators import governed
from veilframe.operators.segments import detect_long
from veilframe.plans import corpus, gateway
from veilframe.sources import logs
from veilframe.sources.storage import new_path

QUERIES, ORACLES = {}, {}


def log_entries(spark: SparkSession, sf: str) -> DataFrame:
    """What a caller gets beside the response."""
    log = gateway.run_requests(fixtures.requests(spark, sf), fixtures.bank(sf))
    rows = gateway.log_entries(log, F.col("ts"), F.lit(2.9))
    return rows.select(
        "request_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "role", "tool_name", F.size("decisions").alias("n_decisions"),
        F.array_join(F.transform("decisions", lambda d: d["action"]), ",").alias("actions"), "final_action", "duration_ms", "backend", "status", "error",
    )


QUERIES["log_entries"] = log_entries
ORACLES["log_entries"] = log_sql(
    ", acted_on AS (SELECT f.*, CASE WHEN in_blocked THEN 'block' WHEN coalesce(in_mutations, 0) > 0 THEN 'transform' ELSE 'allow' END AS in_action, "
    "CASE WHEN blocked THEN 'block' WHEN review THEN 'human_review' WHEN coalesce(n_mutations, 0) > 0 THEN 'transform' ELSE 'allow' END AS out_action FROM final f), "
    "decided AS (SELECT *, CASE WHEN gate = 'rbac_denied' THEN ['deny'] WHEN gate = 'blocked' OR output IS NULL THEN [in_action] ELSE [in_action, out_action] END AS actions_ FROM acted_on) "
    "SELECT request_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, role, tool_name, CAST(len(actions_) AS INTEGER) AS n_decisions, array_to_string(actions_, ',') AS actions, final_action, "
    "CAST(2 AS BIGINT) AS duration_ms, 'spark' AS backend, status, message AS error FROM decided"
).replace("FROM stated) , acted_on", "FROM stated), acted_on")


def record_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Records of searches that came without an id or a time: an id from the text, the time of the run."""
    requests = fixtures.requests(spark, sf).filter(F.col("tool_name") == "customer_api_search")
    log = gateway.run_requests(requests, fixtures.bank(sf))
    came = log.withColumns({"number": F.col("request_id"), "request_id": F.when(F.col("request_id").cast("long") % 3 > 0, F.col("request_id"))})
    rows = gateway.audit_rows(came.drop("ts"))
    return rows.groupBy("request_id").agg(
        F.count("*").alias("records"), F.min(F.col("timestamp_utc") > F.lit("2024-06-01").cast("timestamp")).alias("timed"), F.max("latency_ms").alias("latency_ms")
    )


QUERIES["record_defaults"] = record_defaults
ORACLES["record_defaults"] = (
    f"WITH {S.requests_cte()}, r AS (SELECT CASE WHEN CAST(request_id AS BIGINT) % 3 > 0 THEN request_id ELSE {S.uuid_of('scan_text')} END AS request_id "
    "FROM requests WHERE tool_name = 'customer_api_search') SELECT request_id, count(*) AS records, true AS timed, CAST(0 AS DOUBLE) AS latency_ms FROM r GROUP BY 1"
)

_GOLDEN = """SELECT DISTINCT role, query, CASE WHEN role IN ('intern', 'guest') THEN 'rbac_denied' ELSE 'success' END AS expected_status,
 CASE WHEN role IN ('intern', 'guest') THEN 'deny' ELSE 'allow' END AS expected_rbac, 'from the log' AS description FROM requests WHERE tool_name = 'sql_query'"""


def golden_files(spark: SparkSession, sf: str) -> DataFrame:
    """Golden cases written as JSON lines and read back, each with an id from its content."""
    path = new_path(spark, "golden")
    cases = spark.sql(_GOLDEN.replace("FROM requests", "FROM {given}"), given=fixtures.requests(spark, sf))
    listed = cases.withColumn("expected_inbound_categories", F.when(F.col("query").contains("@"), F.array(F.lit("private_email"))).otherwise(F.array().cast("array<string>")))
    logs.append_log(spark.createDataFrame([], schemas.GOLDEN).unionByName(listed), path)
    return logs.read_golden(spark, path).select(
        "case_id", "role", F.sha2("query", 256).alias("query_hash"), "expected_status", "expected_rbac", "description", F.array_join("expected_inbound_categories", ",").alias("categories"),
    )


QUERIES["golden_files"] = golden_files
ORACLES["golden_files"] = (
    f"WITH {S.requests_cte()}, g AS ({_GOLDEN}) SELECT substr(sha256(concat_ws('|', role, query)), 1, 16) AS case_id, role, sha256(query) AS query_hash, "
    "expected_status, expected_rbac, description, CASE WHEN contains(query, '@') THEN 'private_email' ELSE '' END AS categories FROM g"
)


def blank_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which some are blank or null: those have no spans."""
    blank = F.when(F.col("doc_id") % 4 == 0, F.lit(" \t\n ")).when(F.col("doc_id") % 4 == 1, F.lit("")).when(F.col("doc_id") % 4 == 2, F.lit(None).cast("string")).otherwise(F.col("text"))
    rows = corpus.detect_corpus(fixtures.documents(spark, sf).withColumn("text", blank))
    summary = scan_summary(F.col("detections"))
    return rows.select("doc_id", F.size("detections").alias("n_spans"), summary["has_pii"].alias("has_pii"), summary["confidence"].alias("confidence"))


QUERIES["blank_texts"] = blank_texts
ORACLES["blank_texts"] = (
    f"WITH RECURSIVE {S.documents_cte().replace('SELECT doc_id AS k, text FROM docs', 'SELECT doc_id AS k, text FROM docs WHERE doc_id % 4 = 3')}, {S.spans('src')}, "
    "n AS (SELECT k, count(*) AS n FROM spans GROUP BY k) SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_spans, n IS NOT NULL AS has_pii, "
    "CASE WHEN n IS NOT NULL THEN 0.95 ELSE 0.0 END::DOUBLE AS confidence FROM docs LEFT JOIN n ON n.k = doc_id"
)

_LONG_PAGES = f"SELECT page_id % 5 AS bundle, page_id, html FROM ({fixtures.PAGES}) p"


def detect_long_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Spans in five texts that hold all pages one after the other, scanned in segments."""
    pages = fixtures.pages(spark, sf).select((F.col("page_id") % 5).alias("bundle"), "page_id", "html")
    bundles = pages.groupBy("bundle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "html"))), lambda p: p["html"]), "\n").alias("text"))
    found = detect_long(bundles, "bundle", most=10_000)
    return found.select("bundle", "category", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.sha2("text", 256).alias("span_hash"))


QUERIES["detect_long_pages"] = detect_long_pages
ORACLES["detect_long_pages"] = (
    f"WITH RECURSIVE pages_ AS ({_LONG_PAGES}), src AS (SELECT bundle AS k, string_agg(html, chr(10) ORDER BY page_id) AS text FROM pages_ GROUP BY bundle), {S.spans('src')} "
    "SELECT k AS bundle, category, s AS span_start, e AS span_end, sha256(span_text) AS span_hash FROM spans"
)


_SHAPES = (
    ("analyst", "SELECT id, first_name, email FROM customers WHERE id = {k}"),
    ("compliance_officer", "SELECT a.id, a.account_type, c.last_name FROM customers c JOIN accounts a ON c.id = a.customer_id WHERE a.balance > 100000 AND c.id = {k} AND a.account_type = 'trust'"),
)


def governed_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Two SQL texts for every customer, each text with values of its own."""
    ids = fixtures.source(spark, sf, "customer").select("c_custkey")
    calls = None
    for role, shape in _SHAPES:
        before, after = shape.split("{k}")
        one = ids.select(F.lit(role).alias("role"), F.concat(F.lit(before), F.col("c_custkey").cast("string"), F.lit(after)).alias("call_key"))
        calls = one if calls is None else calls.unionByName(one)
    rows = governed.query_rows(calls, fixtures.bank(sf))
    listed = rows.groupBy("role", "call_key").agg(F.array_join(F.array_sort(F.collect_list("row_json")), ",").alias("rows"), F.max("error").alias("error"))
    return calls.join(listed, ["role", "call_key"], "left").select("role", "call_key", F.sha2(F.coalesce("rows", F.lit("")), 256).alias("rows_hash"), "error")


QUERIES["governed_templates"] = governed_templates
ORACLES["governed_templates"] = (
    f"WITH {S.bank_cte()}, one AS (SELECT c_custkey AS k, {S.text(_SHAPES[0][1]).replace('{k}', chr(39) + ' || CAST(c_custkey AS VARCHAR) || ' + chr(39))} AS call_key, "
    f"{S.text(_SHAPES[1][1]).replace('{k}', chr(39) + ' || CAST(c_custkey AS VARCHAR) || ' + chr(39))} AS other_key FROM customer), "
    "held AS (SELECT customer_id, string_agg('{\"account_type\": \"' || account_type || '\", \"id\": ' || CAST(a.id AS VARCHAR) || ', \"last_name\": \"' || last_name || '\"}', ',' "
    "ORDER BY '{\"account_type\": \"' || account_type || '\", \"id\": ' || CAST(a.id AS VARCHAR) || ', \"last_name\": \"') AS j "
    "FROM accounts a JOIN customers c ON c.id = a.customer_id WHERE balance > 100000 AND account_type = 'trust' GROUP BY customer_id) "
    "SELECT 'analyst' AS role, call_key, sha256('{\"email\": \"' || email || '\", \"first_name\": \"' || first_name || '\", \"id\": ' || CAST(c.id AS VARCHAR) || '}') AS rows_hash, CAST(NULL AS VARCHAR) AS error "
    "FROM one JOIN customers c ON c.id = k UNION ALL SELECT 'compliance_officer', other_key, sha256(coalesce(j, '')), NULL FROM one LEFT JOIN held ON customer_id = k"
)
