import pytest
from pyspark.sql import functions as F

from veilframe.functions.references import is_select, sql_references
from veilframe.operators import access

RULES = access.AccessRules()


def reason(spark, role, tool, query=None, fields=None, **kw):
    df = spark.createDataFrame([(role, tool, query, fields)], "role string, tool string, query string, fields string")
    return df.select(access.rbac_reason(F.col("role"), F.col("tool"), F.col("query"), F.col("fields"), **kw)).first()[0]


@pytest.mark.parametrize(
    "role,query,part",
    [
        ("analyst", "SELECT id, first_name, last_name FROM customers", None),
        ("analyst", "SELECT ssn FROM customers", "ssn"),
        ("analyst", "SELECT customers.ssn FROM customers", "ssn"),
        ("analyst", 'SELECT "SSN" FROM customers', "ssn"),
        ("analyst", "SELECT * FROM admin_logs", "admin_logs"),
        ("compliance_officer", "SELECT ssn, account_number FROM customers", None),
        ("analyst", "SELECT id, /* ssn */ ssn FROM customers", "ssn"),
        ("analyst", "SELECT id /* ssn */ FROM customers -- ssn", None),
        ("analyst", "SELECT id FROM customers WHERE first_name = 'ssn'", None),
        ("analyst", "SELECT (SELECT ssn FROM customers LIMIT 1) as x FROM customers", "ssn"),
        ("analyst", "SELECT id FROM customers UNION SELECT ssn FROM customers", "ssn"),
        ("analyst", "SELECT * FROM (", "__UNPARSEABLE__"),
        ("analyst", "SELECT 1", "__UNPARSEABLE__"),
        ("analyst", "SELECT 'x FROM customers", "__UNPARSEABLE__"),
        ("analyst", "SELECT * FROM accounts WHERE account_number = '1234-5678-9012'", None),
        ("analyst", "SELECT COUNT(*), ssn AS x FROM customers GROUP BY ssn", "ssn"),
        ("analyst", "SELECT c.id FROM customers c, admin_logs l", "admin_logs"),
        ("analyst", "SELECT c.id FROM customers c LEFT JOIN hr.payroll p ON c.id = p.id", "payroll"),
        ("analyst", "SELECT balance * 2 AS b, account_number FROM accounts", "account_number"),
        ("intern", "SELECT id FROM accounts", "does not have access"),
        ("guest", "SELECT id FROM accounts", "Unknown role: guest"),
    ],
)
def test_sql_access(spark, role, query, part):
    got = reason(spark, role, "sql_query", query)
    assert got is None if part is None else part in got


def test_tool_gate(spark):
    assert "customer_api_lookup" in reason(spark, "analyst", "customer_api_lookup", family=False)
    assert reason(spark, "analyst", "customer_api_lookup") is None
    assert reason(spark, "analyst", "shell").endswith("Allowed tools: {'customer_api', 'sql_query'}")
    assert reason(spark, "intern", "sql_query").endswith("Allowed tools: none")


@pytest.mark.parametrize("fields,hit", [("name,ssn,email", "ssn"), ("name, Account_Number", "Account_Number"), ("name", None), (None, None)])
def test_field_gate(spark, fields, hit):
    got = reason(spark, "analyst", "customer_api", fields=fields)
    assert got == (None if hit is None else f"Field '{hit}' is restricted for role 'analyst'")
    assert reason(spark, "compliance_officer", "customer_api", fields=fields) is None


def test_column_sets(spark):
    cols = F.array(*[F.lit(c) for c in ("id", "first_name", "ssn", "email")])
    df = spark.range(1)

    def one(column):
        return df.select(column).first()[0]

    assert one(access.filter_columns(RULES, F.lit("analyst"), F.lit("customers"), cols)) == ["id", "first_name", "email"]
    assert len(one(access.filter_columns(RULES, F.lit("compliance_officer"), F.lit("customers"), cols))) == 4
    assert one(access.filter_columns(RULES, F.lit("guest"), F.lit("customers"), cols)) == []
    assert one(access.restricted_columns(RULES, F.lit("analyst"), F.lit("customers"))) == ["ssn"]
    assert one(access.restricted_columns(RULES, F.lit("compliance_officer"), F.lit("customers"))) == []
    tables = F.array(F.lit("customers"), F.lit("advisors"))
    assert sorted(one(access.visible_columns(RULES, F.lit("analyst"), tables, cols))) == ["email", "first_name", "id"]


def test_references(spark):
    df = spark.createDataFrame([("SELECT c.name, a.balance FROM customers c JOIN accounts a ON c.id = a.customer_id",)], "q string")
    r = df.select(sql_references(F.col("q")).alias("r"), is_select(F.col("q")).alias("s")).first()
    assert r.r.tables == ["accounts", "customers"] and not r.r.star and r.s
    assert {"name", "balance"} <= set(r.r.columns)
