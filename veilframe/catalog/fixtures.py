"""Tables of the governance domain derived from the given tables.

The derivations are plain SQL expressions, so that the registered queries and the SQL
they are checked against start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe import fixed_values as fixed
from veilframe.sources.storage import spread


def _case(expression: str, values) -> str:
    branches = " ".join("WHEN {} THEN {}".format(i, "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE {expression} {branches} END"


def _pad(expression: str, n: int) -> str:
    return f"lpad(CAST({expression} AS STRING), {n}, '0')"


_FIRST = ("Alice", "John", "Sarah", "David", "Maria", "Xaver", "Emma", "Ole")
_LAST = ("Smith", "Jones", "Chen", "Wilson", "Garcia", "Novak", "Okafor")

# one suffix per category, so that every detector and action has work
SUFFIX = """CASE doc_id % 7 WHEN 0 THEN ' SSN 123-45-6789' WHEN 1 THEN ' Please ask Alice Smith'
 WHEN 2 THEN ' see https://example.org/a/1' WHEN 3 THEN ' dated 03/15/2024'
 WHEN 4 THEN ' at 742 Evergreen Terrace Ln' WHEN 5 THEN ' {"balance": 4969596700}' ELSE '' END"""

DOCUMENTS = f"SELECT doc_id, lang, source, text || {SUFFIX} AS text FROM documents"

CONVERSATIONS = f"SELECT conv_id, turn, text || {SUFFIX.replace('doc_id', '(conv_id + turn)')} AS text FROM conversations"
PAGES = f"SELECT page_id, html || {SUFFIX.replace('doc_id', 'page_id')} AS html FROM pages"

CUSTOMERS = f"""SELECT id, first_name, last_name,
 lower(first_name) || '.' || lower(last_name) || CAST(id AS STRING) || '@example.com' AS email,
 '555-' || {_pad('100 + id % 900', 3)} || '-' || {_pad('id % 10000', 4)} AS phone,
 CAST(100 + id % 9000 AS STRING) || ' Maple Ln' AS address,
 {_pad('100 + id % 800', 3)} || '-' || {_pad('10 + id % 90', 2)} || '-' || {_pad('id % 10000', 4)} AS ssn,
 CAST(1940 + id % 60 AS STRING) || '-' || {_pad('1 + id % 12', 2)} || '-' || {_pad('1 + id % 28', 2)} AS date_of_birth
FROM (SELECT c_custkey AS id, {_case('c_custkey % 8', _FIRST)} AS first_name,
 {_case('c_custkey % 7', _LAST)} AS last_name FROM customer) c"""

ACCOUNTS = f"""SELECT o_orderkey AS id, o_custkey AS customer_id,
 {_pad('1000 + o_orderkey % 9000', 4)} || '-' || {_pad('1000 + (o_orderkey * 7) % 9000', 4)} || '-' || {_pad('1000 + (o_orderkey * 13) % 9000', 4)} AS account_number,
 {_case('o_orderkey % 5', fixed.ACCOUNT_TYPES)} AS account_type,
 o_totalprice AS balance, CAST(CAST(o_orderdate AS DATE) AS STRING) AS opened_date FROM orders"""

TRANSACTIONS = f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS account_id, l_extendedprice AS amount,
 CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN {_case('l_orderkey % 15', fixed.PII_DESCRIPTIONS)}
 ELSE {_case('l_partkey % 15', fixed.NEUTRAL_DESCRIPTIONS)} END AS description,
 CAST(CAST(l_shipdate AS DATE) AS STRING) AS timestamp, 'Supplier ' || CAST(l_suppkey AS STRING) AS counterparty
FROM lineitem"""

ADVISORS = f"""SELECT id, first_name || ' Advisor' AS name, lower(first_name) || CAST(id AS STRING) || '@advice.example' AS email,
 '555-' || {_pad('200 + id % 700', 3)} || '-' || {_pad('id % 10000', 4)} AS phone, region
FROM (SELECT s_suppkey AS id, {_case('s_suppkey % 8', _FIRST)} AS first_name,
 {_case('s_suppkey % 10', fixed.REGIONS)} AS region FROM supplier) s"""

BANK = {
    "customers": (CUSTOMERS, "customer"),
    "accounts": (ACCOUNTS, "orders"),
    "transactions": (TRANSACTIONS, "lineitem"),
    "advisors": (ADVISORS, "supplier"),
}

# --- a bank in which a few customers hold a large share of all accounts. What decides the verdict on
# them stands in late accounts only; their own record holds nothing personal
HOT = {"secret": 52, "date": 63, "address": 12, "plain": 23}
_HOT = ", ".join(map(str, HOT.values()))
HOT_CUSTOMERS = f"""SELECT id, first_name, last_name, email, CASE WHEN id IN ({_HOT}) THEN '-' ELSE phone END AS phone,
 CASE WHEN id IN ({_HOT}) THEN '-' ELSE address END AS address, CASE WHEN id IN ({_HOT}) THEN '-' ELSE ssn END AS ssn,
 CASE WHEN id IN ({_HOT}) THEN '-' ELSE date_of_birth END AS date_of_birth FROM ({CUSTOMERS}) h"""
HOT_ACCOUNTS = f"""SELECT id, customer_id, account_number,
 CASE WHEN late AND customer_id = {HOT['secret']} THEN 'see 123-45-6789' WHEN late AND customer_id = {HOT['address']} THEN '742 Evergreen Terrace Ln'
  ELSE account_type END AS account_type, balance,
 CASE WHEN customer_id NOT IN ({_HOT}) OR (late AND customer_id = {HOT['date']}) THEN opened_date ELSE 'open' END AS opened_date
FROM (SELECT id, CASE id % 16 WHEN 0 THEN {HOT['secret']} WHEN 1 THEN {HOT['date']} WHEN 2 THEN {HOT['address']} WHEN 3 THEN {HOT['plain']}
  ELSE customer_id END AS customer_id, account_number, account_type, balance, opened_date, id > 800 AND (id - id % 16) / 16 % 20 = 0 AS late FROM ({ACCOUNTS}) a) b"""
HOT_BANK = {**BANK, "customers": (HOT_CUSTOMERS, "customer"), "accounts": (HOT_ACCOUNTS, "orders")}

# SQL texts of the request log, with what they should end in:
# (text, status for the analyst, status for the compliance officer)
QUERIES = (
    ("SELECT id, first_name, last_name FROM customers ORDER BY id LIMIT 5", "success", "success"),
    ("SELECT id, first_name, email FROM customers WHERE id = 1", "success", "success"),
    ("SELECT id, amount, description FROM transactions ORDER BY id, amount, description LIMIT 10", "success", "success"),
    ("SELECT ssn FROM customers ORDER BY id LIMIT 5", "rbac_denied", "blocked"),
    ("SELECT account_number FROM accounts ORDER BY id LIMIT 5", "rbac_denied", "success"),
    ("SELECT * FROM admin_logs", "rbac_denied", "rbac_denied"),
    ("SELECT id, first_name, last_name, ssn FROM customers ORDER BY id LIMIT 3", "rbac_denied", "blocked"),
    ("SELECT id, account_number, balance FROM accounts ORDER BY id LIMIT 3", "rbac_denied", "success"),
    ("SELECT * FROM customers WHERE email = 'alice@example.com' AND phone = '555-123-4567'", "success", "success"),
    ("SELECT * FROM accounts WHERE account_number = '1234-5678-9012'", "success", "success"),
    ("SELECT id, name, email, phone FROM advisors ORDER BY id LIMIT 5", "success", "success"),
    ("SELECT c.id, c.first_name, a.balance FROM customers c JOIN accounts a ON c.id = a.customer_id ORDER BY a.balance DESC, a.id LIMIT 5", "success", "success"),
    ("SELECT account_type, COUNT(*) AS n, MAX(balance) AS top FROM accounts GROUP BY account_type ORDER BY account_type", "success", "success"),
    ("SELECT id FROM customers WHERE id < 3 UNION SELECT id FROM advisors WHERE id < 5 ORDER BY id", "success", "success"),
    ("SELECT (SELECT MAX(ssn) FROM customers) AS x FROM customers LIMIT 1", "rbac_denied", "blocked"),
    ("SELECT * FROM (", "rbac_denied", "rbac_denied"),
    ("DELETE FROM customers", "error", "error"),
    ("SELECT id, 'SSN 123-45-6789' AS note FROM customers ORDER BY id LIMIT 1", "blocked", "blocked"),
    ("SELECT id, first_name, opened_date FROM customers c JOIN accounts a ON c.id = a.customer_id ORDER BY id LIMIT 3", "error", "error"),
    ("SELECT id, date_of_birth FROM customers ORDER BY id LIMIT 40", "success", "success"),
    ("SELECT * FROM customers ORDER BY id LIMIT 60", "success", "blocked"),
    ("SELECT id /* ssn */, ssn FROM customers -- all", "rbac_denied", "blocked"),
    ("SELECT c.id FROM customers c, admin_logs l WHERE c.id = 1", "rbac_denied", "rbac_denied"),
)

REQUESTS = f"""SELECT CAST(event_id AS STRING) AS request_id, ts, role, CAST(user_id AS STRING) AS user_id, tool_name,
 CASE WHEN tool_name = 'sql_query' THEN sql_text END AS query,
 CASE WHEN tool_name IN ('customer_api', 'customer_api_lookup') THEN CAST(user_id * 10 + event_id % 12 AS BIGINT) END AS customer_id,
 CASE WHEN tool_name = 'customer_api_search' THEN search_name END AS name,
 CASE WHEN tool_name = 'customer_api_search' THEN search_email END AS email,
 CASE WHEN tool_name = 'customer_api_search' THEN CAST(1 + event_id % 4 AS INT) END AS "limit",
 CASE WHEN tool_name = 'customer_api' THEN fields END AS fields,
 CASE WHEN tool_name = 'sql_query' THEN sql_text
  WHEN tool_name = 'customer_api_search' THEN 'Search customers: name=' || coalesce(search_name, 'None') || ', email=' || coalesce(search_email, 'None')
  ELSE 'Look up customer ' || CAST(user_id * 10 + event_id % 12 AS STRING) END AS scan_text
FROM (SELECT event_id, ts, user_id,
  CASE user_id % 7 WHEN 0 THEN 'intern' WHEN 1 THEN 'analyst' WHEN 2 THEN 'analyst' WHEN 3 THEN 'analyst'
   WHEN 4 THEN 'guest' ELSE 'compliance_officer' END AS role,
  CASE event_type WHEN 'click' THEN 'sql_query' WHEN 'signup' THEN 'sql_query' WHEN 'view' THEN 'customer_api_lookup'
   WHEN 'purchase' THEN 'customer_api_search' ELSE CASE WHEN event_id % 9 = 0 THEN 'shell' ELSE 'customer_api' END END AS tool_name,
  {_case(f'event_id % {len(QUERIES)}', [q for q, _, _ in QUERIES])} AS sql_text,
  CASE event_id % 5 WHEN 0 THEN 'ali' WHEN 1 THEN 'SMITH' WHEN 2 THEN 'o' WHEN 3 THEN 'Garc' END AS search_name,
  CASE event_id % 3 WHEN 0 THEN 'alice.' WHEN 1 THEN CAST(user_id AS STRING) || '@EXAMPLE' END AS search_email,
  CASE event_id % 4 WHEN 0 THEN 'name, ssn,email' WHEN 1 THEN 'first_name,Account_Number' WHEN 2 THEN 'id,email' END AS fields
 FROM events) e"""


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, sql: str, table: str, even: bool = False) -> DataFrame:
    df = source(spark, sf_dir, table)
    if even:
        df = spread(df)
    template = sql.replace("{", "{{").replace("}", "}}").replace('"limit"', "limit")
    return spark.sql(template.replace(f"FROM {table}", "FROM {given}"), given=df)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, DOCUMENTS, "documents", even=True)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, CONVERSATIONS, "conversations", even=True)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, PAGES, "pages", even=True)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, REQUESTS, "events", even=True)


def bank(sf_dir: str, tables=None):
    """name -> function from a session to the table, for role sessions."""
    return {
        name: (lambda s, sql=sql, table=table: _derive(s, sf_dir, sql, table))
        for name, (sql, table) in (BANK if tables is None else tables).items()
    }
