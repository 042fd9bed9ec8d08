"""Registered queries: governed SQL, lookups, searches, and whole request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.catalog import fixtures, sqlparts as S
from veilframe.catalog.access import RBAC_SQL, REFERENCES_SQL
from veilframe.functions.canonical import row_json, truncate
from veilframe.operators import governed, lookup
from veilframe.operators.access import AccessRules
from veilframe.plans import evaluation, gateway
from veilframe.sources.storage import spread


QUERIES, ORACLES = {}, {}
RULES = AccessRules()


def _as_role(query: str, role: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        session = governed.role_session(spark, fixtures.bank(sf), role)
        return governed.governed_query(session, query, role)

    return run


def _register_sql(name: str, query: str, role: str, oracle: str | None = None) -> None:
    QUERIES[name] = _as_role(query, role)
    ORACLES[name] = f"WITH {S.bank_cte()} {oracle or query}"


_TOP = (
    "SELECT c.id, c.first_name, a.balance FROM customers c JOIN accounts a ON c.id = a.customer_id "
    "ORDER BY a.balance DESC, a.id LIMIT 5"
)
_register_sql("governed_top_balances", _TOP, "analyst")
_register_sql(
    "governed_star", "SELECT * FROM customers", "analyst",
    "SELECT id, first_name, last_name, email, phone, address, date_of_birth FROM customers",
)
_register_sql("governed_star_compliance", "SELECT * FROM customers", "compliance_officer")
_register_sql(
    "governed_union", "SELECT id, email FROM customers WHERE id % 10 = 0 UNION SELECT id, email FROM advisors", "analyst"
)
_register_sql(
    "governed_totals",
    "SELECT c.last_name, COUNT(*) AS accounts, ROUND(SUM(a.balance), 2) AS total_balance, MAX(a.balance) AS top "
    "FROM customers c JOIN accounts a ON c.id = a.customer_id GROUP BY c.last_name", "analyst",
)
_register_sql(
    "governed_alias_of_hidden_column", "SELECT ssn AS x, COUNT(*) AS n FROM customers GROUP BY ssn", "analyst",
    "SELECT CAST(NULL AS VARCHAR) AS x, COUNT(*) AS n FROM customers",
)
_register_sql(
    "governed_transactions",
    "SELECT t.counterparty, COUNT(*) AS n, ROUND(SUM(t.amount), 2) AS amount FROM transactions t JOIN accounts a "
    "ON t.account_id = a.id WHERE a.account_type = 'trust' GROUP BY t.counterparty", "compliance_officer",
)
_register_sql(
    "governed_top_per_type",
    "SELECT id, account_type, balance FROM (SELECT id, account_type, balance, RANK() OVER (PARTITION BY account_type "
    "ORDER BY balance DESC) AS r FROM accounts) x WHERE r <= 3", "analyst",
)


# texts of an analyst with what becomes of them by lineage: columns shown, or None if refused
_LINEAGE = (
    ("SELECT id FROM accounts WHERE account_number LIKE '1%'", None),
    ("SELECT x.account_number FROM (SELECT id AS account_number FROM accounts) x", "account_number"),
    ("SELECT c.id, a.id FROM customers c JOIN accounts a ON c.id = a.customer_id", "id,id"),
    ("SELECT c.*, a.account_number AS n FROM customers c JOIN accounts a ON c.id = a.customer_id AND a.balance > 1000",
     "id,first_name,last_name,email,phone,address,date_of_birth,n"),
    ("SELECT c.id FROM customers c JOIN customers d ON c.ssn = d.ssn", None),
    ("SELECT last_name, COUNT(*) AS n FROM customers GROUP BY last_name HAVING MAX(ssn) > '5'", None),
    ("SELECT id FROM customers c WHERE EXISTS (SELECT 1 FROM customers d WHERE d.ssn = '1' OR d.id = c.id)", None),
    ("SELECT n FROM (SELECT ssn AS s, length(ssn) AS k, COUNT(*) AS n FROM customers GROUP BY ssn) x WHERE n > 1", "n"),
    ("SELECT n FROM (SELECT length(ssn) AS n FROM customers) x WHERE n > 1", None),
    ("SELECT id, account_number FROM accounts UNION ALL SELECT id, name FROM advisors", "id"),
)


def governed_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Texts judged by where their columns come from: refused where a condition reads a hidden one."""
    session = governed.role_session(spark, fixtures.bank(sf), "analyst")
    out = spark.createDataFrame([], "text_no int, refused boolean, columns string, rows long")
    for number, (text, _) in enumerate(_LINEAGE):
        try:
            df = governed.governed_query(session, text, "analyst", refuse_conditions=True)
        except ValueError:
            one = spark.createDataFrame([(number, True, None, None)], out.schema)
        else:
            counted = df.toDF(*[f"_{i}" for i in range(len(df.columns))]).agg(F.count("*").alias("rows"))
            one = counted.select(F.lit(number).alias("text_no"), F.lit(False).alias("refused"), F.lit(",".join(df.columns)).alias("columns"), "rows")
        out = out.unionByName(one)
    return out


QUERIES["governed_lineage"] = governed_lineage
ORACLES["governed_lineage"] = f"WITH {S.bank_cte()} " + " UNION ALL ".join(
    f"SELECT {i} AS text_no, {columns is None} AS refused, {S.text(columns) if columns else 'CAST(NULL AS VARCHAR)'} AS columns, "
    + ("CAST(NULL AS BIGINT)" if columns is None else "(SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM customers)" if "COUNT(*) AS n FROM customers GROUP BY ssn" in text else f"(SELECT count(*) FROM ({text}) q)") + " AS rows"
    for i, (text, columns) in enumerate(_LINEAGE)
)


def table_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Schema of the role's views with the row counts behind them."""
    tables = fixtures.bank(sf)
    schema = governed.table_schema(spark, tables, "analyst")
    counts = None
    for name, build in tables.items():
        one = build(spark).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return schema.join(counts, "table").select("table", "position", "column", "type", "rows")


QUERIES["role_schema"] = table_columns
_SCHEMA_ROWS = ", ".join(
    f"('{t}', {i}, '{c}', '{ty}')"
    for t, cols in {
        "customers": [("id", "bigint")] + [(c, "string") for c in ("first_name", "last_name", "email", "phone", "address")],
        "accounts": [("id", "bigint"), ("customer_id", "bigint")],
        "advisors": [("id", "bigint")] + [(c, "string") for c in ("name", "email", "phone", "region")],
        "transactions": [("id", "bigint"), ("account_id", "bigint"), ("amount", "double"), ("description", "string"),
                         ("timestamp", "string"), ("counterparty", "string")],
    }.items()
    for i, (c, ty) in enumerate(cols)
)
ORACLES["role_schema"] = (
    f"WITH {S.bank_cte()}, s AS (SELECT * FROM (VALUES {_SCHEMA_ROWS}, ('customers', 7, 'date_of_birth', 'string'), "
    "('accounts', 3, 'account_type', 'string'), ('accounts', 4, 'balance', 'double'), ('accounts', 5, 'opened_date', 'string')) "
    "AS v(\"table\", position, \"column\", type)), n AS (SELECT 'customers' AS \"table\", count(*) AS rows FROM customers UNION ALL "
    "SELECT 'accounts', count(*) FROM accounts UNION ALL SELECT 'advisors', count(*) FROM advisors UNION ALL "
    "SELECT 'transactions', count(*) FROM transactions) SELECT \"table\", position, \"column\", type, rows FROM s JOIN n USING (\"table\")"
)


def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.table_counts({n: b(spark) for n, b in fixtures.bank(sf).items()})


QUERIES["table_counts"] = table_counts
ORACLES["table_counts"] = (
    f"WITH {S.bank_cte()}, n AS (SELECT 'customers' AS name, count(*) AS rows FROM customers UNION ALL SELECT 'accounts', count(*) FROM accounts "
    "UNION ALL SELECT 'advisors', count(*) FROM advisors UNION ALL SELECT 'transactions', count(*) FROM transactions) "
    "SELECT name, rows FROM n UNION ALL SELECT 'total', CAST(sum(rows) AS BIGINT) FROM n"
)


def canonical_rows(spark: SparkSession, sf: str) -> DataFrame:
    accounts = fixtures.bank(sf)["accounts"](spark)
    return accounts.select("id", row_json(accounts.schema).alias("row_json"))


QUERIES["canonical_rows"] = canonical_rows
ORACLES["canonical_rows"] = (
    f"WITH accounts AS ({fixtures.ACCOUNTS}) SELECT id, {S.json_row(S.ACCOUNT_FIELDS)} AS row_json FROM accounts"
)


def truncated_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.documents(spark, sf)
    out = docs.select("doc_id", truncate(F.col("text"), fixed.MAX_OUTPUT_CHARS).alias("t"))
    return out.select("doc_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("text_hash"))


QUERIES["truncated_texts"] = truncated_texts
ORACLES["truncated_texts"] = (
    f"WITH {S.documents_cte()} SELECT doc_id, length(t) AS chars, sha256(t) AS text_hash FROM "
    f"(SELECT doc_id, {S.truncated('text')} AS t FROM docs) x"
)

# --- lookups and searches ------------------------------------------------------------


def _lookup_ids(spark: SparkSession, sf: str) -> DataFrame:
    r = fixtures.requests(spark, sf)
    return r.filter(F.col("customer_id").isNotNull()).select("customer_id")


def nested_lookup(spark: SparkSession, sf: str) -> DataFrame:
    bank = fixtures.bank(sf)
    found = lookup.nested_lookup(_lookup_ids(spark, sf), bank["customers"](spark), bank["accounts"](spark))
    return found.select(
        "customer_id", "page", F.col("customer.email").alias("email"), F.size("accounts").alias("n_accounts"),
        F.array_join(F.transform("accounts", lambda a: a["id"].cast("string")), ",").alias("account_ids"), "error",
    )


QUERIES["customer_lookup"] = nested_lookup
ORACLES["customer_lookup"] = (
    f"WITH {S.bank_cte()}, {S.requests_cte()}, ids AS (SELECT DISTINCT customer_id FROM requests WHERE customer_id IS NOT NULL) "
    "SELECT i.customer_id, 0 AS page, any_value(c.email) AS email, CASE WHEN any_value(c.id) IS NOT NULL THEN count(a.id) END AS n_accounts, "
    "CASE WHEN any_value(c.id) IS NOT NULL THEN coalesce(string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.id), '') END AS account_ids, "
    "CASE WHEN any_value(c.id) IS NULL THEN 'API error: 404 - {\"detail\":\"Customer ' || CAST(i.customer_id AS VARCHAR) || ' not found\"}' END AS error "
    "FROM ids i LEFT JOIN customers c ON c.id = i.customer_id LEFT JOIN accounts a ON a.customer_id = c.id GROUP BY i.customer_id"
)


def masked_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records without the fields an analyst may not see, as JSON."""
    bank = fixtures.bank(sf)
    found = lookup.nested_lookup(_lookup_ids(spark, sf), bank["customers"](spark), bank["accounts"](spark))
    flat = found.filter(F.col("error").isNull()).select("page", "customer.*", "accounts")
    seen = lookup.drop_restricted(flat, RULES.api_restricted["analyst"], "accounts")
    return seen.select("id", row_json(seen.schema, ("page",)).alias("record"))


ACC = S.without(S.ACCOUNT_FIELDS, "account_number")
CUST = S.without(S.CUSTOMER_FIELDS, "ssn")
QUERIES["restricted_records"] = masked_records
ORACLES["restricted_records"] = (
    f"WITH {S.bank_cte()}, {S.requests_cte()}, ids AS (SELECT DISTINCT customer_id FROM requests WHERE customer_id IS NOT NULL), "
    f"acc AS (SELECT customer_id, string_agg({S.json_row(ACC)}, ', ' ORDER BY id) AS j FROM accounts GROUP BY 1) "
    "SELECT c.id, '{\"accounts\": [' || coalesce(acc.j, '') || '], ' || substr(" + S.json_row(CUST) + ", 2) AS record "
    "FROM ids i JOIN customers c ON c.id = i.customer_id LEFT JOIN acc ON acc.customer_id = c.id"
)


def customer_search(spark: SparkSession, sf: str) -> DataFrame:
    r = fixtures.requests(spark, sf).filter(F.col("tool_name") == "customer_api_search")
    searches = r.select(
        F.to_json(F.struct("name", "email", "limit")).alias("search_key"), "name", "email", "limit"
    ).distinct()
    customers = spread(fixtures.bank(sf)["customers"](spark))
    found = lookup.search_customers(searches, customers)
    asked = searches.withColumnRenamed("email", "asked")
    return found.select("search_key", "position", "id").join(asked, "search_key").select(
        F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("asked", F.lit("-")).alias("asked_email"),
        "limit", "position", "id",
    )


_SEARCHES = (
    "searches AS (SELECT DISTINCT name, email, \"limit\" AS n FROM requests WHERE tool_name = 'customer_api_search'), "
    "hits AS (SELECT s.name, s.email AS asked, s.n, c.*, row_number() OVER (PARTITION BY s.name, s.email, s.n ORDER BY c.id) AS position "
    "FROM searches s JOIN (SELECT * RENAME (email AS mail) FROM customers) c ON (s.name IS NOT NULL OR s.email IS NOT NULL) "
    "AND (s.name IS NULL OR contains(lower(c.first_name), lower(s.name)) OR contains(lower(c.last_name), lower(s.name))) "
    "AND (s.email IS NULL OR contains(lower(c.mail), lower(s.email))) QUALIFY position <= s.n)"
)
QUERIES["customer_search"] = customer_search
ORACLES["customer_search"] = (
    f"WITH {S.bank_cte()}, {S.requests_cte()}, {_SEARCHES} SELECT coalesce(name, '-') AS name, coalesce(asked, '-') AS asked_email, "
    "n AS \"limit\", position, id FROM hits"
)

# --- whole request log -----------------------------------------------------------------


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    log = gateway.run_requests(fixtures.requests(spark, sf), fixtures.bank(sf))
    return log.select(
        "request_id", "role", "tool_name", "status", "final_action", "error",
        F.size("inbound_detections").alias("n_inbound"), F.size("outbound_detections").alias("n_outbound"),
        F.element_at("decisions", -1)["reason"].alias("last_reason"),
        F.sha2("response", 256).alias("response_hash"),
    )


def _result_sql(index: int, role: str, body: str, fields: dict[str, str], order: str) -> str:
    query = S.text(fixtures.QUERIES[index][0])
    return (
        f"SELECT 'sql' AS kind, '{role}' AS role, {query} AS call_key, '[' || coalesce(string_agg(j, ', ' ORDER BY o), '') || ']' AS output, "
        f"CAST(NULL AS VARCHAR) AS error FROM (SELECT {S.json_row(fields)} AS j, row_number() OVER (ORDER BY {order}) AS o FROM ({body}) b) r"
    )


def _results_cte() -> str:
    both, strict = ("analyst", "compliance_officer"), ("compliance_officer",)
    q = [t for t, _, _ in fixtures.QUERIES]
    n, s = "n", "s"
    plain = [
        (0, both, {"id": n, "first_name": s, "last_name": s}, "id"),
        (1, both, {"id": n, "first_name": s, "email": s}, "id"),
        (2, both, {"id": n, "amount": n, "description": s}, "id, amount, description"),
        (3, strict, {"ssn": s}, "(SELECT 1)"),
        (4, strict, {"account_number": s}, "(SELECT 1)"),
        (6, strict, {"id": n, "first_name": s, "last_name": s, "ssn": s}, "id"),
        (7, strict, {"id": n, "account_number": s, "balance": n}, "id"),
        (8, both, {"id": n}, "id"),
        (9, both, {"id": n}, "id"),
        (10, both, {"id": n, "name": s, "email": s, "phone": s}, "id"),
        (11, both, {"id": n, "first_name": s, "balance": n}, "balance DESC"),
        (12, both, {"account_type": s, "n": n, "top": n}, "account_type"),
        (13, both, {"id": n}, "id"),
        (14, strict, {"x": s}, "x"),
        (19, both, {"id": n, "date_of_birth": s}, "id"),
        (20, ("analyst",), CUST, "id"),
        (20, strict, S.CUSTOMER_FIELDS, "id"),
        (21, strict, {"id": n, "ssn": s}, "id"),
    ]
    parts = [_result_sql(i, role, q[i].split(" -- ")[0], fields, order) for i, roles, fields, order in plain for role in roles]
    for role in both:
        parts.append(
            f"SELECT 'sql', '{role}', {S.text(q[16])}, NULL, 'ValueError: Only SELECT queries are allowed. Got: DELETE FROM customers'"
        )
        parts.append(f"SELECT 'sql', '{role}', {S.text(q[18])}, NULL, 'AnalysisException: AMBIGUOUS_REFERENCE'")
    for role, cust, acc in (("analyst", CUST, ACC), ("compliance_officer", S.CUSTOMER_FIELDS, S.ACCOUNT_FIELDS)):
        missing = "'{\"error\": \"API error: 404 - {\\\"detail\\\":\\\"Customer ' || i.k || ' not found\\\"}\"}'"
        parts.append(
            f"SELECT 'lookup', '{role}', i.k, CASE WHEN c.id IS NULL THEN {missing} ELSE '{{\"accounts\": [' || coalesce(a.j, '') || '], \"customer\": ' "
            f"|| c.j || '}}' END, NULL FROM (SELECT DISTINCT CAST(customer_id AS VARCHAR) AS k, customer_id FROM requests WHERE customer_id IS NOT NULL) i "
            f"LEFT JOIN (SELECT id, {S.json_row(cust)} AS j FROM customers) c ON c.id = i.customer_id "
            f"LEFT JOIN (SELECT customer_id, string_agg({S.json_row(acc)}, ', ' ORDER BY id) AS j FROM accounts GROUP BY 1) a ON a.customer_id = c.id"
        )
        found = S.json_row(cust).replace(" email ", " mail ")
        parts.append(
            f"SELECT 'search', '{role}', concat_ws('|', s.name, s.email, s.n), CASE WHEN s.name IS NULL AND s.email IS NULL THEN "
            "'{\"error\": \"API error: 400 - {\\\"detail\\\":\\\"At least one search parameter (name or email) is required\\\"}\"}' ELSE "
            "'{\"count\": ' || CAST(count(h.id) AS VARCHAR) || ', \"results\": [' || coalesce(string_agg(h.j, ', ' ORDER BY h.position), '') || ']}' END, NULL "
            f"FROM searches s LEFT JOIN (SELECT name, asked, n, id, position, {found} AS j FROM hits) h ON h.name IS NOT DISTINCT FROM s.name "
            "AND h.asked IS NOT DISTINCT FROM s.email AND h.n = s.n GROUP BY s.name, s.email, s.n"
        )
    return (
        f"{_SEARCHES}, full_results AS (" + " UNION ALL ".join(parts) + "), "
        f"results AS (SELECT kind, role, call_key, {S.truncated('output')} AS output, error FROM full_results)"
    )


def log_sql(tail: str) -> str:
    """CTEs of the whole log; ``final`` has one row per request."""
    mode = "CASE WHEN role = 'compliance_officer' THEN 'strict_financial' ELSE 'permissive_analyst' END"
    prefix = S.judged("inbound", mode, "k", "in_spans").replace
    inbound = prefix("judged AS", "in_judged AS")
    for name in ("with_rule", "acted", "edits", "spliced", "verdicts"):
        inbound = inbound.replace(f"{name} AS (", f"in_{name} AS (").replace(f"FROM {name}", f"FROM in_{name}")
    inbound = inbound.replace("FROM judged", "FROM in_judged")
    both = (
        "texts_in AS (SELECT request_id AS k, role, scan_text AS text FROM access WHERE rbac_reason IS NULL), "
        "distinct_in AS (SELECT row_number() OVER () AS d, text FROM (SELECT DISTINCT text FROM texts_in) x), "
        "outs AS (SELECT row_number() OVER () AS o, * FROM results), "
        # inbound texts and results share one detection pass, told apart by the sign of the key
        "src AS (SELECT d AS k, text FROM distinct_in UNION ALL SELECT -o AS k, output AS text FROM outs WHERE output IS NOT NULL), "
        f"{S.spans('src')}, "
        "in_spans AS (SELECT t.k, t.role, s.text, s.category, s.s, s.e, s.span_text FROM spans s JOIN distinct_in d ON d.d = s.k JOIN texts_in t ON t.text = d.text), "
        "out_spans AS (SELECT o.o AS k, o.role, s.text, s.category, s.s, s.e, s.span_text FROM spans s JOIN outs o ON s.k = -o.o)"
    )
    outbound = S.judged("outbound", mode, "'-'", "out_spans")
    return (
        f"WITH RECURSIVE {S.rules_cte()}, {S.bank_cte()}, {S.requests_cte()}, {REFERENCES_SQL}, {RBAC_SQL}, {_results_cte()}, "
        f"{both}, {inbound}, {outbound}, "
        "gated AS (SELECT a.*, vi.n_spans AS n_in, vi.blocked AS in_blocked, vi.violation AS in_violation, vi.violation_reason AS in_reason, "
        "vi.n_mutations AS in_mutations, vi.kinds AS in_kinds, coalesce(mi.mutated, a.scan_text) AS in_text, "
        "CASE WHEN rbac_reason IS NOT NULL THEN 'rbac_denied' WHEN vi.blocked THEN 'blocked' ELSE 'run' END AS gate, "
        "CASE WHEN tool_name = 'sql_query' THEN 'sql' WHEN tool_name = 'customer_api_search' THEN 'search' ELSE 'lookup' END AS kind, "
        "CASE WHEN tool_name = 'sql_query' THEN query WHEN tool_name = 'customer_api_search' THEN concat_ws('|', name, email, \"limit\") "
        "ELSE CAST(customer_id AS VARCHAR) END AS key FROM access a LEFT JOIN in_verdicts vi ON vi.k = a.request_id LEFT JOIN in_spliced mi ON mi.k = a.request_id), "
        "joined AS (SELECT g.*, o.output, o.error AS run_error, v.n_spans AS n_out, v.n_mutations, v.kinds, v.blocked, v.review, v.violation, v.violation_reason, "
        "coalesce(m.mutated, o.output) AS out_text FROM gated g LEFT JOIN outs o ON g.gate = 'run' AND o.kind = g.kind AND o.role = g.role AND o.call_key = g.key "
        "LEFT JOIN verdicts v ON v.k = o.o LEFT JOIN spliced m ON m.k = o.o), "
        "stated AS (SELECT *, CASE WHEN gate <> 'run' THEN gate WHEN output IS NULL THEN 'error' WHEN blocked THEN 'blocked' ELSE 'success' END AS status, "
        "'RBAC denied: role=' || role || ', tool=' || tool_name || ' — ' || rbac_reason AS denial FROM joined), "
        "final AS (SELECT *, CASE WHEN gate = 'rbac_denied' THEN 'deny' WHEN status = 'blocked' THEN 'block' WHEN review THEN 'human_review' ELSE 'allow' END AS final_action, "
        f"CASE gate WHEN 'rbac_denied' THEN denial WHEN 'blocked' THEN '{gateway.INBOUND_REFUSED}' ELSE run_error END AS message, "
        "CASE WHEN gate = 'rbac_denied' THEN denial WHEN gate = 'blocked' THEN 'Policy violation (inbound): BLOCK policy triggered: ' || in_reason "
        f"WHEN status = 'error' THEN 'No PII policy actions triggered' ELSE {S.decision_reason('outbound', 'stated')} END AS last_reason, "
        "CASE WHEN gate = 'rbac_denied' THEN '{\"error\": \"' || denial || '\"}' "
        "WHEN gate = 'blocked' THEN '{\"error\": \"Policy violation: ' || in_violation || ' in inbound — BLOCK policy triggered: ' || in_reason || '\"}' "
        "WHEN status = 'blocked' THEN '{\"error\": \"Policy violation: ' || violation || ' in outbound — BLOCK policy triggered: ' || violation_reason || '\"}' "
        "WHEN status = 'error' THEN in_text ELSE out_text END AS response FROM stated) " + tail
    )


QUERIES["request_log"] = request_log
ORACLES["request_log"] = log_sql(
    "SELECT request_id, role, tool_name, status, final_action, message AS error, coalesce(n_in, 0) AS n_inbound, "
    "CASE WHEN gate = 'run' THEN coalesce(n_out, 0) ELSE 0 END AS n_outbound, last_reason, sha256(response) AS response_hash FROM final"
)


def audit_records(spark: SparkSession, sf: str) -> DataFrame:
    requests = fixtures.requests(spark, sf)
    log = gateway.run_requests(requests, fixtures.bank(sf))
    rows = gateway.audit_rows(log, F.col("ts"), F.lit(1.5))
    return rows.select(
        "request_id", F.col("timestamp_utc").cast("string").alias("timestamp_utc"),
        F.concat_ws("/", "actor.role", "actor.user_id", "actor.session_id").alias("actor"), "tool_name", "raw_query_hash",
        F.array_join(F.transform("inbound_detections", lambda d: d["text"]), ",").alias("inbound_detections"),
        F.array_join(F.transform("policy_decisions_inbound", lambda d: d["action"]), ",").alias("policy_decisions_inbound"),
        F.sha2("tool_input_after_policy", 256).alias("tool_input_hash"), "tool_output_raw_hash",
        F.size("outbound_detections").alias("n_outbound"), F.size("policy_decisions_outbound").alias("n_outbound_decisions"),
        F.sha2("tool_output_final", 256).alias("tool_output_hash"), "status", "latency_ms",
        F.col("review_queue_id"), "policy_version", "model_version",
    )


QUERIES["audit_records"] = audit_records
ORACLES["audit_records"] = log_sql(
    ", in_lists AS (SELECT k, string_agg('[' || category || ']', ',' ORDER BY s) AS d, string_agg(action, ',' ORDER BY s DESC) AS a FROM in_judged GROUP BY k) "
    "SELECT request_id, regexp_replace(CAST(ts AS VARCHAR), '[.]?0+$', '') AS timestamp_utc, role || '/' || user_id || '/' || request_id AS actor, tool_name, sha256(scan_text) AS raw_query_hash, "
    "coalesce(l.d, '') AS inbound_detections, coalesce(l.a, '') AS policy_decisions_inbound, "
    "sha256(CASE gate WHEN 'rbac_denied' THEN response WHEN 'blocked' THEN '' ELSE in_text END) AS tool_input_hash, "
    "sha256(coalesce(output, '')) AS tool_output_raw_hash, CASE WHEN gate = 'run' THEN coalesce(n_out, 0) ELSE 0 END AS n_outbound, "
    "CASE WHEN gate = 'run' THEN coalesce(n_out, 0) ELSE 0 END AS n_outbound_decisions, "
    "sha256(CASE WHEN status = 'success' THEN out_text ELSE '' END) AS tool_output_hash, status, CAST(1.5 AS DOUBLE) AS latency_ms, "
    "CASE WHEN review THEN " + S.uuid_of("concat_ws('|', request_id, 'outbound', 'review')") + " END AS review_queue_id, "
    "CASE WHEN role = 'compliance_officer' THEN 'strict_financial_v1' ELSE 'permissive_analyst_v1' END AS policy_version, "
    "'openai/privacy-filter' AS model_version FROM final LEFT JOIN in_lists l ON l.k = request_id"
).replace("FROM stated) , in_lists", "FROM stated), in_lists")


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    log = gateway.run_requests(fixtures.requests(spark, sf), fixtures.bank(sf))
    rows = gateway.review_entries(log, F.col("ts"))
    return rows.select(
        "review_id", "request_id", "tool_name", "direction", F.size("detections").alias("n_detections"),
        F.array_join(F.array_distinct(F.transform("detections", lambda d: d["category"])), ",").alias("categories"),
        "query_or_result_hash", "status",
    )


QUERIES["review_queue"] = review_queue
ORACLES["review_queue"] = log_sql(
    ", reviewed AS (SELECT k, count(*) AS n, string_agg(DISTINCT category, ',') AS c FROM judged WHERE action = 'review' GROUP BY 1), "
    "keyed AS (SELECT f.*, o.o FROM final f JOIN outs o ON o.kind = f.kind AND o.role = f.role AND o.call_key = f.key WHERE f.review AND f.gate = 'run') "
    "SELECT " + S.uuid_of("concat_ws('|', request_id, 'outbound', 'review')") + " AS review_id, request_id, tool_name, 'outbound' AS direction, "
    "n AS n_detections, c AS categories, sha256(output) AS query_or_result_hash, 'pending' AS status FROM keyed JOIN reviewed ON reviewed.k = keyed.o"
).replace("FROM stated) , reviewed", "FROM stated), reviewed")

# --- evaluation against expected outcomes --------------------------------------------------


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Golden cases, one per SQL request of a known role, with what they should end in. Some expect
    a category that is not there, some have no user: they fail."""
    r = fixtures.requests(spark, sf).filter((F.col("tool_name") == "sql_query") & (F.col("role") != "guest"))
    expected = F.lit(None).cast("string")
    for text, analyst, officer in fixtures.QUERIES:
        expected = F.when(
            F.col("query") == text,
            F.when(F.col("role") == "intern", "rbac_denied").when(F.col("role") == "analyst", analyst).otherwise(officer),
        ).otherwise(expected)
    found = F.filter(
        F.array(*[F.when(F.expr(condition), F.lit(category)) for category, condition in _EXPECTED_FOUND]), lambda c: c.isNotNull()
    )
    return r.withColumns({
        "case_id": F.col("request_id"), "user_id": F.expr(_CASE_USER), "expected_status": expected,
        "expected_rbac": F.when(expected == "rbac_denied", "deny").otherwise("allow"),
        "expected_inbound_categories": F.when(F.col("role") == "intern", F.array().cast("array<string>")).otherwise(found),
    })


# categories that a golden case expects in its text, with the cases that do
_EXPECTED_FOUND = (
    ("private_email", "query LIKE '%alice@example.com%'"), ("private_phone", "query LIKE '%alice@example.com%'"),
    ("account_number", "query LIKE '%1234-5678%'"), ("private_url", "CAST(request_id AS BIGINT) % 19 = 4"),
)
_CASE_USER = "CASE WHEN CAST(request_id AS BIGINT) % 13 = 0 THEN '' ELSE user_id END"


def evaluation_cases(spark: SparkSession, sf: str) -> DataFrame:
    checked = evaluation.evaluate_cases(_cases(spark, sf), fixtures.bank(sf))
    return checked.select(
        "case_id", "status", "rbac_ok", "status_ok", "inbound_ok", "audit_ok",
        F.array_join("missing_categories", ",").alias("missing_categories"),
    )


_EVAL_STATUS = (
    "CASE WHEN gate <> 'run' THEN gate WHEN output IS NULL THEN 'error' WHEN blocked THEN 'blocked' WHEN review THEN 'review_queued' ELSE 'success' END"
)
_EXPECTED = (
    "CASE WHEN role = 'intern' THEN 'rbac_denied' ELSE CASE query || role "
    + " ".join(
        f"WHEN {S.text(t)} || 'analyst' THEN '{a}' WHEN {S.text(t)} || 'compliance_officer' THEN '{c}'" for t, a, c in fixtures.QUERIES
    )
    + " END END"
)


def judged_cases(cases: str) -> str:
    """CTEs ``seen`` and ``checked`` over ``cases`` (case_id, ts, role, user_id, tool_name, status,
    expected, wanted): each of the four scores from what the log holds."""
    return (
        "seen AS (SELECT k, list_distinct(list(category)) AS found FROM in_spans GROUP BY k), "
        "checked AS (SELECT case_id, status, (status = 'rbac_denied') = (expected = 'rbac_denied') AS rbac_ok, "
        "status = expected OR (expected = 'success' AND status = 'review_queued') AS status_ok, len(missing) = 0 AS inbound_ok, "
        "coalesce(case_id <> '' AND ts IS NOT NULL AND user_id <> '' AND tool_name <> '' AND status <> '', false) AS audit_ok, "
        "array_to_string(list_sort(missing), ',') AS missing_categories FROM "
        f"(SELECT c.*, list_filter(wanted, lambda w: NOT list_contains(coalesce(found, CAST([] AS VARCHAR[])), w)) AS missing FROM {cases} c LEFT JOIN seen ON seen.k = c.case_id) m)"
    )


_WANTED = "list_filter([" + ", ".join(f"CASE WHEN {condition} THEN '{category}' END" for category, condition in _EXPECTED_FOUND) + "], lambda c: c IS NOT NULL)"
_EVAL = (
    f", cases AS (SELECT request_id AS case_id, ts, role, tool_name, {_CASE_USER} AS user_id, {_EVAL_STATUS} AS status, {_EXPECTED} AS expected, "
    f"CASE WHEN role = 'intern' THEN CAST([] AS VARCHAR[]) ELSE {_WANTED} END AS wanted FROM final WHERE tool_name = 'sql_query' AND role <> 'guest'), {judged_cases('cases')} "
)
QUERIES["evaluation_cases"] = evaluation_cases
ORACLES["evaluation_cases"] = log_sql(_EVAL + "SELECT * FROM checked").replace("FROM stated) , cases", "FROM stated), cases")


def evaluation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.metrics(evaluation.evaluate_cases(_cases(spark, sf), fixtures.bank(sf)))


def _pct(name: str) -> str:
    return f"CAST(round_even(100.0 * count(*) FILTER ({name}) / count(*), 0) AS BIGINT)"


QUERIES["evaluation_metrics"] = evaluation_metrics
ORACLES["evaluation_metrics"] = log_sql(
    _EVAL + "SELECT count(*) AS total, count(*) FILTER (rbac_ok) AS rbac_correct, count(*) FILTER (status_ok) AS status_correct, "
    "count(*) FILTER (inbound_ok) AS inbound_pii_correct, count(*) FILTER (audit_ok) AS audit_complete, "
    f"{_pct('rbac_ok')} AS rbac_pct, {_pct('status_ok')} AS status_pct, {_pct('inbound_ok')} AS inbound_pii_pct, {_pct('audit_ok')} AS audit_pct, "
    "count(*) FILTER (rbac_ok) + count(*) FILTER (status_ok) + count(*) FILTER (inbound_ok) + count(*) FILTER (audit_ok) AS overall, 4 * count(*) AS max_score FROM checked"
).replace("FROM stated) , cases", "FROM stated), cases")
