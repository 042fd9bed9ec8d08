"""Registered queries: access rules over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.catalog import fixtures, sqlparts as S
from veilframe.functions import hashing
from veilframe.functions.arrays import explode_rows
from veilframe.functions.references import is_select, sql_references
from veilframe.operators import access
from veilframe.plans.gateway import scan_text

QUERIES, ORACLES = {}, {}
RULES = access.AccessRules()


def tool_gate(spark: SparkSession, sf: str) -> DataFrame:
    r = fixtures.requests(spark, sf)
    return r.select(
        "request_id", "role", "tool_name",
        access.tool_reason(RULES, F.col("role"), F.col("tool_name")).alias("reason"),
        access.tool_reason(RULES, F.col("role"), F.col("tool_name"), family=False).alias("exact_reason"),
    )


def _tool_sql(asked: str) -> str:
    return (
        "CASE WHEN role NOT IN ('intern', 'analyst', 'compliance_officer') THEN 'Unknown role: ' || role "
        f"WHEN role = 'intern' THEN 'Role ''intern'' does not have access to tool ''' || tool_name || '''. Allowed tools: none' "
        f"WHEN {asked} NOT IN ('sql_query', 'customer_api') THEN 'Role ''' || role || ''' does not have access to tool ''' || tool_name || "
        "'''. Allowed tools: {''customer_api'', ''sql_query''}' END"
    )


_FAMILY = "CASE WHEN tool_name IN ('customer_api_lookup', 'customer_api_search') THEN 'customer_api' ELSE tool_name END"
QUERIES["tool_gate"] = tool_gate
ORACLES["tool_gate"] = (
    f"WITH {S.requests_cte()} SELECT request_id, role, tool_name, {_tool_sql(_FAMILY)} AS reason, "
    f"{_tool_sql('tool_name')} AS exact_reason FROM requests"
)

# --- references of SQL texts ------------------------------------------------------
_NOISE = r"(?s)''(?:[^'']|'''')*''|--[^\n]*|/\*.*?\*/"
_NAME = r"[a-z_][a-z0-9_]*(?:[.][a-z_][a-z0-9_]*)*"
_ALIASED = rf"{_NAME}(?:\s+(?:as\s+)?[a-z_][a-z0-9_]*)?"
REFERENCES_SQL = (
    "texts AS (SELECT DISTINCT query FROM requests WHERE query IS NOT NULL), "
    f"cleaned AS (SELECT query, lower(regexp_replace(regexp_replace(query, '{_NOISE}', ' ', 'g'), '[\"`]', '', 'g')) AS c FROM texts), "
    rf"listed AS (SELECT query, c, list_concat(flatten(list_transform(regexp_extract_all(c, '\bfrom\s+({_ALIASED}(?:\s*,\s*{_ALIASED})*)', 1), "
    rf"lambda x: list_transform(string_split(x, ','), lambda y: regexp_extract(y, '{_NAME}')))), regexp_extract_all(c, '\bjoin\s+({_NAME})', 1)) AS names FROM cleaned), "
    "refs AS (SELECT query, CASE WHEN len(names) = 0 OR length(replace(c, '(', '')) <> length(replace(c, ')', '')) OR contains(c, '''') OR contains(c, '/*') "
    "THEN ['__UNPARSEABLE__'] ELSE list_sort(list_distinct(list_transform(names, lambda x: string_split(x, '.')[-1]))) END AS tables, "
    r"list_sort(list_distinct(regexp_extract_all(c, '[a-z_][a-z0-9_]*'))) AS columns, "
    r"regexp_matches(c, '(?:\bselect|\bdistinct|\ball|,)\s*[*]|[.]\s*[*]') AS star FROM listed)"
)
_ALLOWED = "['accounts', 'advisors', 'customers', 'transactions']"
TABLE_SQL = (
    f"(SELECT 'Table ''' || list_min(list_filter(f.tables, lambda t: NOT list_contains({_ALLOWED}, t))) || ''' is not accessible for role ''' || r.role || '''')"
)
COLUMN_SQL = (
    "CASE WHEN r.role = 'analyst' AND NOT f.star THEN CASE "
    "WHEN list_contains(f.tables, 'accounts') AND list_contains(f.columns, 'account_number') THEN 'Column ''account_number'' in table ''accounts'' is restricted for role ''analyst''' "
    "WHEN list_contains(f.tables, 'customers') AND list_contains(f.columns, 'ssn') THEN 'Column ''ssn'' in table ''customers'' is restricted for role ''analyst''' END END"
)


def query_references(spark: SparkSession, sf: str) -> DataFrame:
    r = fixtures.requests(spark, sf).filter(F.col("query").isNotNull())
    texts = r.groupBy("query").agg(F.count("*").alias("requests"))
    ref = texts.withColumn("r", sql_references(F.col("query")))
    return ref.select(
        "query", "requests", F.array_join("r.tables", ",").alias("tables"),
        F.array_join("r.columns", ",").alias("columns"), F.col("r.star").alias("star"),
        is_select(F.col("query")).alias("is_select"),
    )


QUERIES["query_references"] = query_references
ORACLES["query_references"] = (
    f"WITH {S.requests_cte()}, {REFERENCES_SQL} SELECT query, n AS requests, array_to_string(tables, ',') AS tables, "
    "array_to_string(columns, ',') AS columns, star, starts_with(upper(trim(query)), 'SELECT') AS is_select "
    "FROM refs JOIN (SELECT query, count(*) AS n FROM requests GROUP BY 1) c USING (query)"
)


def _sql_requests(spark: SparkSession, sf: str) -> DataFrame:
    r = fixtures.requests(spark, sf).filter((F.col("tool_name") == "sql_query") & (F.col("role") != "guest"))
    return r.withColumn("r", sql_references(F.col("query")))


def table_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _sql_requests(spark, sf).select(
        "request_id", access.table_reason(RULES, F.col("role"), F.col("r.tables")).alias("reason")
    )


QUERIES["table_gate"] = table_gate
ORACLES["table_gate"] = (
    f"WITH {S.requests_cte()}, {REFERENCES_SQL} SELECT r.request_id, CASE WHEN r.role <> 'intern' THEN {TABLE_SQL} END AS reason "
    "FROM requests r JOIN refs f USING (query) WHERE r.tool_name = 'sql_query' AND r.role <> 'guest'"
)


def column_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _sql_requests(spark, sf).select(
        "request_id",
        access.column_reason(RULES, F.col("role"), F.col("r.tables"), F.col("r.columns"), F.col("r.star")).alias("reason"),
    )


QUERIES["column_gate"] = column_gate
ORACLES["column_gate"] = (
    f"WITH {S.requests_cte()}, {REFERENCES_SQL} SELECT r.request_id, {COLUMN_SQL} AS reason "
    "FROM requests r JOIN refs f USING (query) WHERE r.tool_name = 'sql_query' AND r.role <> 'guest'"
)

FIELD_SQL = (
    "(SELECT CASE WHEN role = 'analyst' THEN 'Field ''' || list_filter(list_transform(string_split(fields, ','), lambda x: trim(x)), "
    "lambda x: lower(x) IN ('account_number', 'ssn'))[1] || ''' is restricted for role ''analyst''' END)"
)


def field_gate(spark: SparkSession, sf: str) -> DataFrame:
    r = fixtures.requests(spark, sf).filter(F.col("tool_name") == "customer_api")
    wanted = access.requested_fields(F.col("fields"))
    return r.select(
        "request_id", "role", F.size(wanted).alias("n_fields"),
        access.field_reason(RULES, F.col("role"), wanted).alias("reason"),
    )


QUERIES["field_gate"] = field_gate
ORACLES["field_gate"] = (
    f"WITH {S.requests_cte()} SELECT request_id, role, coalesce(len(string_split(fields, ',')), 0) AS n_fields, {FIELD_SQL} AS reason "
    "FROM requests WHERE tool_name = 'customer_api'"
)


def access_verdict(spark: SparkSession, sf: str) -> DataFrame:
    r = fixtures.requests(spark, sf)
    reason = access.rbac_reason(F.col("role"), F.col("tool_name"), F.col("query"), F.col("fields"))
    return r.withColumn("reason", reason).select(
        "request_id", F.col("reason").isNull().alias("granted"), "reason",
        access.denial_text(F.col("role"), F.col("tool_name"), F.col("reason")).alias("denial"),
    )


RBAC_SQL = (
    f"access AS (SELECT r.*, coalesce({_tool_sql(_FAMILY)}, CASE WHEN r.tool_name = 'sql_query' THEN coalesce({TABLE_SQL}, {COLUMN_SQL}) END, "
    f"CASE WHEN r.tool_name = 'customer_api' THEN {FIELD_SQL} END) AS rbac_reason FROM requests r LEFT JOIN refs f ON f.query = r.query)"
)
QUERIES["access_verdict"] = access_verdict
ORACLES["access_verdict"] = (
    f"WITH {S.requests_cte()}, {REFERENCES_SQL}, {RBAC_SQL} SELECT request_id, rbac_reason IS NULL AS granted, rbac_reason AS reason, "
    "'RBAC denied: role=' || role || ', tool=' || tool_name || ' — ' || rbac_reason AS denial FROM access"
)


def _role_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Role and referenced tables of the logged queries."""
    rows = _sql_requests(spark, sf).select("request_id", "role", F.col("r.tables").alias("tables"))
    return explode_rows(rows, F.col("tables"), "table")


def restricted_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = _role_tables(spark, sf).withColumn(
        "restricted", F.array_join(access.restricted_columns(RULES, F.col("role"), F.col("table")), ",")
    )
    return rows.groupBy("role", "table", "restricted").agg(F.count("*").alias("requests"))


QUERIES["restricted_columns"] = restricted_columns
ORACLES["restricted_columns"] = (
    f"WITH {S.requests_cte()}, {REFERENCES_SQL}, x AS (SELECT r.role, unnest(f.tables) AS \"table\" FROM requests r JOIN refs f USING (query) "
    "WHERE r.tool_name = 'sql_query' AND r.role <> 'guest') SELECT role, \"table\", CASE WHEN role = 'analyst' AND \"table\" = 'customers' THEN 'ssn' "
    "WHEN role = 'analyst' AND \"table\" = 'accounts' THEN 'account_number' ELSE '' END AS restricted, count(*) AS requests FROM x GROUP BY 1, 2, 3"
)


def allowed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Named columns that the role may see in the referenced table."""
    rows = explode_rows(
        _sql_requests(spark, sf).select("role", "r.tables", "r.columns"), F.col("tables"), "table"
    )
    seen = access.filter_columns(RULES, F.col("role"), F.col("table"), F.col("columns"))
    return rows.withColumn("visible", F.array_join(F.array_sort(seen), ",")).groupBy("role", "table", "visible").agg(
        F.count("*").alias("requests")
    )


_COLS = {t: "[" + ", ".join(S.text(c) for c in cols) + "]" for t, cols in fixed.ROLE_COLUMNS["analyst"].items()}
_FILTER = (
    "CASE WHEN role = 'analyst' THEN CASE {t} "
    + " ".join(f"WHEN '{t}' THEN list_filter(columns, lambda c: list_contains({v}, c))" for t, v in _COLS.items())
    + " ELSE columns END ELSE columns END"
)
QUERIES["allowed_columns"] = allowed_columns
ORACLES["allowed_columns"] = (
    f"WITH {S.requests_cte()}, {REFERENCES_SQL}, x AS (SELECT r.role, f.columns, unnest(f.tables) AS t FROM requests r JOIN refs f USING (query) "
    f"WHERE r.tool_name = 'sql_query' AND r.role <> 'guest'), y AS (SELECT role, t, array_to_string(list_sort({_FILTER.replace('{t}', 't')}), ',') AS visible FROM x) "
    "SELECT role, t AS \"table\", visible, count(*) AS requests FROM y GROUP BY 1, 2, 3"
)


def visible_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns visible in a result: allowed by any of the queried tables."""
    rows = _sql_requests(spark, sf)
    seen = access.visible_columns(RULES, F.col("role"), F.col("r.tables"), F.col("r.columns"))
    return rows.select("role", "query", F.array_join(F.array_sort(seen), ",").alias("visible")).groupBy(
        "role", "query", "visible"
    ).agg(F.count("*").alias("requests"))


QUERIES["visible_columns"] = visible_columns
ORACLES["visible_columns"] = (
    f"WITH {S.requests_cte()}, {REFERENCES_SQL}, x AS (SELECT r.request_id, r.role, r.query, f.columns, unnest(f.tables) AS t FROM requests r JOIN refs f USING (query) "
    f"WHERE r.tool_name = 'sql_query' AND r.role <> 'guest'), y AS (SELECT request_id, role, query, unnest({_FILTER.replace('{t}', 't')}) AS c FROM x), "
    "z AS (SELECT x.request_id, x.role, x.query, coalesce(string_agg(DISTINCT y.c, ',' ORDER BY y.c), '') AS visible FROM x LEFT JOIN y USING (request_id) GROUP BY 1, 2, 3) "
    "SELECT role, query, visible, count(*) AS requests FROM z GROUP BY 1, 2, 3"
)


def request_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Policy mode, policies, actor and scan text of each request."""
    r = fixtures.requests(spark, sf)
    mode = hashing.policy_mode(F.col("role"))
    who = hashing.actor(F.col("role"), F.col("user_id"), F.col("request_id"))
    return r.select(
        "request_id", mode.alias("mode"), hashing.policy_for_mode(mode).alias("policy"),
        hashing.policy_for_role(F.col("role")).alias("role_policy"),
        F.concat_ws("/", who["role"], who["user_id"], who["session_id"]).alias("actor"),
        scan_text(F.col("tool_name"), F.col("query"), F.col("customer_id"), F.col("name"), F.col("email")).alias("scanned"),
        hashing.audit_action(F.when(F.col("role") == "intern", "deny").when(F.col("tool_name") == "shell", "transform").otherwise("human_review")).alias("audit_action"),
    )


QUERIES["request_mapping"] = request_mapping
ORACLES["request_mapping"] = (
    f"WITH {S.requests_cte()} SELECT request_id, CASE WHEN role = 'compliance_officer' THEN 'strict' ELSE 'permissive' END AS mode, "
    "CASE WHEN role = 'compliance_officer' THEN 'strict_financial' ELSE 'permissive_analyst' END AS policy, "
    "CASE role WHEN 'compliance_officer' THEN 'strict_financial' WHEN 'analyst' THEN 'permissive_analyst' WHEN 'intern' THEN '' END AS role_policy, "
    "role || '/' || user_id || '/' || request_id AS actor, "
    "CASE WHEN tool_name = 'shell' THEN 'Look up customer None' ELSE scan_text END AS scanned, "
    "CASE WHEN role = 'intern' THEN 'block' WHEN tool_name = 'shell' THEN 'redact' ELSE 'review' END AS audit_action FROM requests"
)
