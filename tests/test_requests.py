import json

import pytest
from pyspark.sql import functions as F

from veilframe import schemas
from veilframe.functions.masking import BUNDLED, Policy
from veilframe.plans import evaluation, gateway

# role, query, status, access, inbound categories
GOLDEN = [
    ("analyst", "SELECT id, first_name, last_name FROM customers LIMIT 5", "success", "allow", []),
    ("analyst", "SELECT id, first_name, email FROM customers WHERE id = 1", "success", "allow", []),
    ("analyst", "SELECT id, amount, description FROM transactions LIMIT 10", "success", "allow", []),
    ("intern", "SELECT * FROM customers", "rbac_denied", "deny", []),
    ("intern", "SELECT id FROM accounts", "rbac_denied", "deny", []),
    ("analyst", "SELECT ssn FROM customers", "rbac_denied", "deny", []),
    ("analyst", "SELECT account_number FROM accounts", "rbac_denied", "deny", []),
    ("analyst", "SELECT * FROM admin_logs", "rbac_denied", "deny", []),
    ("compliance_officer", "SELECT id, first_name, last_name, ssn FROM customers LIMIT 3", "blocked", "allow", []),
    ("compliance_officer", "SELECT id, account_number, balance FROM accounts LIMIT 3", "success", "allow", []),
    ("analyst", "SELECT * FROM customers WHERE email = 'alice@example.com' AND phone = '555-123-4567'", "success", "allow", ["private_email", "private_phone"]),
    ("analyst", "SELECT * FROM accounts WHERE account_number = '1234-5678-9012'", "success", "allow", ["account_number"]),
    ("analyst", "SELECT id, name, email, phone FROM advisors LIMIT 5", "success", "allow", []),
    ("compliance_officer", "SELECT id, first_name, last_name, email, phone FROM customers LIMIT 5", "success", "allow", []),
    ("analyst", "SELECT c.id, c.first_name, a.balance FROM customers c JOIN accounts a ON c.id = a.customer_id ORDER BY a.balance DESC LIMIT 5", "success", "allow", []),
]


def request(i, role, tool, query=None, customer_id=None, name=None, email=None, limit=None, fields=None, text=None):
    shown = text or query or (f"Look up customer {customer_id}" if customer_id is not None else f"Search customers: name={name}, email={email}")
    return (str(i), None, role, f"u{i % 3}", tool, query, customer_id, name, email, limit, fields, shown)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.REQUESTS).withColumn("ts", F.to_timestamp(F.lit("2026-01-02 03:04:05")))


@pytest.fixture(scope="module")
def log(spark, bank):
    rows = [request(i, role, "sql_query", query) for i, (role, query, *_) in enumerate(GOLDEN)]
    rows += [
        request(20, "analyst", "sql_query", "SELECT id FROM customers WHERE ssn = '123-45-6789'", text="My SSN is 123-45-6789"),
        request(21, "analyst", "customer_api_lookup", customer_id=3),
        request(22, "analyst", "customer_api_search", name="a", limit=2),
        request(23, "compliance_officer", "customer_api_lookup", customer_id=12345),
        request(24, "analyst", "customer_api", customer_id=1, fields="name,ssn"),
        request(25, "analyst", "sql_query", "UPDATE customers SET id = 1 FROM customers"),
        request(26, "analyst", "sql_query", "SELECT id FROM customers WHERE first_name = '123-45-6789'"),
        request(27, "compliance_officer", "sql_query", "SELECT id, date_of_birth FROM customers ORDER BY id LIMIT 2"),
    ]
    return gateway.run_requests(frame(spark, rows), bank).cache()


def test_statuses(log):
    got = {int(r.request_id): r.status for r in log.collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [g[2] for g in GOLDEN]
    assert [got[i] for i in range(20, 28)] == [
        "rbac_denied", "success", "success", "success", "rbac_denied", "error", "blocked", "success",
    ]


def test_responses(log):
    r = {int(x.request_id): x for x in log.collect()}
    denied = json.loads(r[5].response)["error"]
    assert denied == "RBAC denied: role=analyst, tool=sql_query — Column 'ssn' in table 'customers' is restricted for role 'analyst'"
    assert json.loads(r[8].response)["error"].startswith("Policy violation: secret in outbound")
    assert "[account_number]" in r[9].response and r[11].response == "[]"
    assert "[private_email]" in r[13].response and "@" not in r[13].response
    assert "ssn" not in json.loads(r[21].response)["customer"]
    assert json.loads(r[22].response)["count"] == 2
    assert "not found" in json.loads(r[23].response)["error"]
    assert r[25].error.startswith("ValueError: Only SELECT") and r[25].final_action == "allow"
    assert r[26].error == gateway.INBOUND_REFUSED and "123-45" not in r[26].response
    assert r[27].final_action == "human_review" and r[27].status == "success"
    assert [d.action for d in r[0].decisions] == ["allow", "allow"] and r[5].final_action == "deny"


def test_audit_record(spark, log):
    rows = gateway.audit_rows(log, F.col("ts"))
    assert rows.schema == spark.createDataFrame([], schemas.AUDIT).schema or len(rows.columns) == 17
    by_id = {int(r.request_id): r for r in rows.collect()}
    assert len(by_id) == log.count()
    assert by_id[26].tool_input_after_policy == "" and by_id[26].inbound_detections[0].text == "[secret]"
    assert by_id[8].tool_output_final == "" and by_id[8].policy_decisions_outbound[0].action == "block"
    assert by_id[27].review_queue_id is not None and by_id[13].policy_version == "strict_financial_v1"
    text = json.dumps([r.asDict(True) for r in by_id.values()], default=str)
    assert "123-45-6789" not in text.replace("WHERE ssn = '123-45-6789'", "")


def test_review_and_log_entries(log):
    review = gateway.review_entries(log, F.col("ts")).collect()
    kinds = {r.request_id: {d.category for d in r.detections} for r in review}
    assert all((r.direction, r.status) == ("outbound", "pending") for r in review)
    assert kinds["27"] == {"private_date"} and all(k == {"private_address"} for i, k in kinds.items() if i != "27")
    entry = gateway.log_entries(log, F.col("ts")).filter("request_id = '0'").first()
    assert entry.backend == "spark" and entry.status == "success" and entry.error is None


def test_inbound_review_stops_and_vault_is_deterministic(spark, bank):
    rules = {("inbound", "private_email"): ("review", "r"), ("outbound", "private_email"): ("vault", "v")}
    policies = {n: Policy(n, f"{n}_x", rules) for n in BUNDLED}
    rows = [
        request(1, "analyst", "sql_query", "SELECT id FROM customers WHERE email = 'a@b.com'"),
        request(2, "analyst", "sql_query", "SELECT email FROM customers WHERE id < 3 ORDER BY id"),
    ]
    runs = []
    for _ in range(2):
        log = gateway.run_requests(frame(spark, rows), bank, gateway.Context(policies=policies))
        got = {r.request_id: r for r in log.collect()}
        assert got["1"].status == "review_queued" and got["1"].output is None
        vault = gateway.vault_entries(log, F.col("ts")).collect()
        assert len(vault) == 2 and all(v.vault_ref in got["2"].response for v in vault)
        runs.append((sorted(v.vault_ref for v in vault), got["1"].inbound.review_queue_id, got["2"].response))
    assert runs[0] == runs[1]


def test_reviewed_requests_resume(spark, bank):
    rules = {("inbound", "private_email"): ("review", "r")}
    context = gateway.Context(policies={n: Policy(n, f"{n}_x", rules) for n in BUNDLED})
    query = "SELECT id FROM customers WHERE id = 1 OR email = 'a@b.com'"
    admitted = gateway.admit(frame(spark, [request(i, "analyst", "sql_query", query) for i in range(5)]), context)
    outcomes = spark.createDataFrame(
        [("0", "reviewed", "allow", "fine"), ("1", "reviewed", "block", "no"), ("2", "timeout", "error", "t"), ("3", "cancelled", "error", "t")],
        "request_id string, outcome string, action string, reason string",
    )
    resumed = gateway.resume(admitted, outcomes)
    log = gateway.finish(resumed, gateway.execute(resumed, bank, context), context)
    got = {r.request_id: r for r in log.collect()}
    assert {k: r.status for k, r in got.items()} == {"0": "success", "1": "blocked", "2": "error", "3": "error"}
    assert got["0"].response == '[{"id": 1}]' and [d.action for d in got["0"].decisions] == ["human_review", "allow", "allow"]
    assert got["1"].final_action == "block" and json.loads(got["1"].response) == {"error": gateway.INBOUND_REFUSED}
    assert got["2"].error == gateway.REVIEW_ENDED
    assert gateway.audit_rows(log, F.col("ts")).count() == 4


def test_golden_evaluation(spark, bank):
    cases = frame(spark, [request(i, role, "sql_query", q) for i, (role, q, *_) in enumerate(GOLDEN)]).withColumn("case_id", F.col("request_id"))
    expected = spark.createDataFrame(
        [(str(i), s, a, c) for i, (_, _, s, a, c) in enumerate(GOLDEN)],
        "case_id string, expected_status string, expected_rbac string, expected_inbound_categories array<string>",
    )
    judged = evaluation.evaluate_cases(cases.join(expected, "case_id"), bank)
    m = evaluation.metrics(judged).first()
    assert (m.total, m.overall, m.max_score, m.status_pct) == (15, 60, 60, 100)
    assert evaluation.problems(judged).count() == 0


def test_missing_record_is_reported(spark):
    cases = spark.createDataFrame([("x", "success", "allow", ["secret"])], "case_id string, expected_status string, expected_rbac string, expected_inbound_categories array<string>")
    none = spark.createDataFrame([], schemas.AUDIT)
    judged = evaluation.judge_cases(cases, none)
    assert judged.first().problem == "No audit record produced"
    assert evaluation.metrics(judged).first().overall == 0


def test_text_that_runs_is_the_text_that_was_checked(spark):
    rows = [request(1, "analyst", "sql_query", "SELECT id FROM customers", text="SELECT ssn FROM customers")]
    (row,) = gateway.admit(frame(spark, rows)).select("scan_text", "call_key").collect()
    assert row.scan_text == row.call_key == "SELECT id FROM customers"


def test_failing_request_costs_only_itself(spark, bank):
    rows = [
        request(1, "analyst", "sql_query", "SELECT CAST(first_name AS INT) AS n FROM customers"),
        request(2, "analyst", "sql_query", "SELECT id FROM customers WHERE id = 1"),
        request(3, "analyst", "sql_query", "SELECT `reflect`('java.lang.System', 'getProperty', 'user.dir') AS n FROM customers LIMIT 1"),
    ]
    log = gateway.run_requests(frame(spark, rows), bank)
    got = {r.request_id: (r.status, r.error) for r in log.collect()}
    assert got["2"] == ("success", None)
    assert got["1"][0] == got["3"][0] == "error" and "CAST_INVALID_INPUT" in got["1"][1] and "not available" in got["3"][1]
    assert {r.request_id: r.status for r in gateway.audit_rows(log).collect()} == {"1": "error", "2": "success", "3": "error"}


def test_secret_behind_the_cut_blocks(spark, bank):
    def many(session):
        long = session.range(1, 3000).select("id", F.when(F.col("id") == 2000, "SSN 123-45-6789").otherwise("nothing here").alias("first_name"))
        return long.withColumns({c: F.lit("x") for c in ("last_name", "email", "phone", "address", "ssn", "date_of_birth")})

    rows = [request(1, "compliance_officer", "sql_query", "SELECT id, first_name FROM customers ORDER BY id"),
            request(2, "compliance_officer", "sql_query", "SELECT id, first_name FROM customers WHERE id < 1500 ORDER BY id")]
    got = {r.request_id: r for r in gateway.run_requests(frame(spark, rows), {**bank, "customers": many}).collect()}
    assert (got["1"].status, got["2"].status) == ("blocked", "success")
    assert json.loads(got["1"].response)["error"].startswith("Policy violation: secret in outbound")
    assert got["2"].response.endswith("[truncated]")
    whole = gateway.run_requests(frame(spark, rows), {**bank, "customers": many}, gateway.Context(judge_whole=False))
    assert {r.status for r in whole.collect()} == {"success"}


def test_rows_variant_runs_every_tool(spark, bank):
    rows = [
        request(1, "analyst", "customer_api_lookup", customer_id=3),
        request(2, "analyst", "customer_api_search", name="a", limit=2),
        request(3, "analyst", "customer_api_search", name="a", limit=500),
        request(4, "analyst", "sql_query", "SELECT id FROM customers WHERE id < 0"),
        request(5, "compliance_officer", "customer_api_lookup", customer_id=3),
    ]
    got = {r.request_id: r for r in gateway.run_requests_by_row(frame(spark, rows), bank).collect()}
    assert {i: r.status for i, r in got.items()} == {"1": "review_queued", "2": "review_queued", "3": "success", "4": "success", "5": "blocked"}
    assert got["1"].out_rows == got["5"].out_rows > 1 and [got[i].out_rows for i in "23"] == [2, 1] and got["4"].out_rows is None
    refused = gateway.run_requests(frame(spark, rows), bank).filter("request_id = '3'").first().response
    assert json.loads(refused)["error"].startswith('API error: 422 - {"detail":[{"type":"less_than_equal"')


def test_golden_case_that_is_no_select(spark, bank):
    cases = frame(spark, [request(1, "analyst", "sql_query", "DELETE FROM admin_logs")]).withColumn("case_id", F.col("request_id"))
    cases = cases.withColumns({"expected_status": F.lit("error"), "expected_rbac": F.lit("allow"), "expected_inbound_categories": F.array().cast("array<string>")})
    (judged,) = evaluation.evaluate_cases(cases, bank).collect()
    assert judged.status == "error" and judged.rbac_ok and judged.status_ok


def test_every_account_comes_back(spark):
    from veilframe.operators import lookup

    customers = spark.createDataFrame([(1, "a")], "id long, email string")
    accounts = spark.range(1500).select("id", F.lit(1).cast("long").alias("customer_id"), F.lit(2.5).alias("balance"))
    calls = spark.createDataFrame([("compliance_officer", "1")], "role string, call_key string")
    (row,) = lookup.lookup_outputs(calls, customers, accounts, 10**6).collect()
    assert [a["id"] for a in json.loads(row.output)["accounts"]] == list(range(1500))


def test_by_row_runs_called_kinds_only_and_scans_evenly(spark, bank, monkeypatch):
    from pyspark.sql import functions as F

    from veilframe.plans import gateway

    for name in ("lookup_rows", "search_rows"):
        monkeypatch.setattr(gateway, name, lambda *a: 1 / 0)
    store, stored = gateway.durable, {}

    def watched(df, name):
        stored[name] = df._jdf.queryExecution().analyzed().toString()
        return store(df, name)

    monkeypatch.setattr(gateway, "durable", watched)
    rows = [request(1, "analyst", "sql_query", "SELECT id FROM customers WHERE id = 1"), request(2, "intern", "sql_query", "SELECT ssn FROM customers")]
    log = gateway.run_requests_by_row(frame(spark, rows), bank)
    assert {r.request_id: r.status for r in log.collect()} == {"1": "success", "2": "rbac_denied"}
    assert stored["result-rows"].startswith("RepartitionByExpression")
    one = spark.range(0, 4000, 1, 1).select(F.lit("q").alias("call_key"), F.lit(0).alias("page"), F.col("id").alias("position"))
    parts = gateway._evenly(one).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 4000
