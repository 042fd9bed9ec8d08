"""Results that are longer than their texts: verdicts, counts and hashes over all rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.test_requests import frame, request
from veilframe.operators import governed, lookup
from veilframe.plans import gateway


@pytest.fixture(scope="module")
def hot(bank):
    """Customers 1 to 4 with 5000 accounts each: a secret in account 390 of the first, a date in 390 of
    the second, an address of the third, nothing in the fourth; 5 and 6 have few."""

    def customers(s):
        return s.range(1, 7).select(
            "id", *[F.lit("x").alias(c) for c in ("first_name", "last_name")], F.concat(F.lit("n"), F.col("id").cast("string")).alias("email"),
            *[F.lit("-").alias(c) for c in ("phone", "address", "ssn", "date_of_birth")],
        )

    def accounts(s):
        rows = s.range(20_004).select(
            (F.floor(F.col("id") / 5000) + 1).alias("customer_id"), (F.col("id") % 5000 + F.floor(F.col("id") / 5000) * 10_000).alias("id"), (F.col("id") % 5000).alias("n"),
        )
        note = F.when((F.col("n") == 390) & (F.col("customer_id") == 1), "SSN 123-45-6789").when((F.col("n") == 390) & (F.col("customer_id") == 2), "on 03/15/2024")
        note = note.when((F.col("n") == 390) & (F.col("customer_id") == 3), "742 Evergreen Terrace Ln").otherwise("plain")
        return rows.select("id", "customer_id", F.lit("a").alias("account_number"), note.alias("account_type"), F.lit(1.5).alias("balance"), F.lit("open").alias("opened_date"))

    return {**bank, "customers": customers, "accounts": accounts}


def _rows(hot, spark, customer):
    people = [json.dumps(r.asDict(), sort_keys=True) for r in hot["customers"](spark).filter(f"id = {customer}").collect()]
    held = [json.dumps(r.asDict(), sort_keys=True) for r in hot["accounts"](spark).filter(f"customer_id = {customer}").collect()]
    return people + held


def _hash(rows):
    return hashlib.sha256(str(sum(int(hashlib.sha256(r.encode()).hexdigest()[:15], 16) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def log(spark, hot):
    rows = [request(i, "compliance_officer", "customer_api_lookup", customer_id=i) for i in range(1, 8)]
    rows += [request(13, "analyst", "customer_api_lookup", customer_id=3), request(11, "analyst", "customer_api_lookup", customer_id=1)]
    rows += [request(20, "compliance_officer", "sql_query", "SELECT id, account_type FROM accounts WHERE customer_id = 2 ORDER BY id")]
    return gateway.run_requests(frame(spark, rows), hot).cache()


def test_verdict_behind_the_cut(spark, hot, log):
    got = {int(r.request_id): r for r in log.collect()}
    assert {i: (r.status, r.final_action) for i, r in got.items()} == {
        1: ("blocked", "block"), 2: ("success", "human_review"), 3: ("success", "allow"), 4: ("success", "allow"), 5: ("success", "allow"),
        6: ("success", "allow"), 7: ("success", "allow"), 13: ("success", "human_review"), 11: ("success", "allow"), 20: ("success", "human_review"),
    }
    assert json.loads(got[1].response)["error"].startswith("Policy violation: secret in outbound")
    assert got[2].response.endswith("[truncated]") and "2024" not in got[2].response
    for i, n in ((1, 5001), (2, 5001), (3, 5001), (4, 5001)):
        assert (got[i].totals.rows, got[i].totals.rows_hash) == (n, _hash(_rows(hot, spark, i)))
    assert [got[i].totals.detections for i in (1, 2, 3, 4, 20)] == [1, 1, 1, 0, 1] and got[20].totals.rows == 5000
    assert got[5].totals is None and got[7].totals is None


def test_review_and_totals_of_cut_results(spark, log):
    queued = {r.request_id: r for r in gateway.review_entries(log, F.col("ts")).collect()}
    assert set(queued) == {"2", "13", "20"}
    assert [d.category for d in queued["2"].detections] == ["private_date"] and queued["2"].detections[0].text == "03/15/2024"
    records = {r.request_id: r for r in gateway.audit_rows(log, F.col("ts")).collect()}
    assert records["2"].review_queue_id == queued["2"].review_id and records["1"].review_queue_id is None
    totals = {r.request_id: (r.status, r.rows) for r in gateway.audit_totals(log, F.col("ts")).collect()}
    assert totals == {"1": ("blocked", 5001), "2": ("success", 5001), "3": ("success", 5001), "4": ("success", 5001), "13": ("success", 5001), "11": ("success", 5001), "20": ("success", 5000)}


def test_vaulted_text_leaves_nothing_once_blocked(spark, hot):
    """The shown part has a span for the vault, the rest one that blocks."""
    from veilframe.functions.masking import BUNDLED, Policy

    rules = {("outbound", "private_date"): ("vault", "v"), ("outbound", "secret"): ("block", "b")}
    context = gateway.Context(policies={n: Policy(n, n, rules) for n in BUNDLED})
    rows = [request(i, "analyst", "sql_query", f"SELECT CASE WHEN id = {i * 10000 - 10000} THEN '01/02/2024' ELSE account_type END AS t FROM accounts WHERE customer_id = {i} ORDER BY id") for i in (1, 4)]
    log = gateway.run_requests(frame(spark, rows), hot, context)
    assert {r.request_id: r.status for r in log.collect()} == {"1": "blocked", "4": "success"}
    assert [v.request_id for v in gateway.vault_entries(log, F.col("ts")).collect()] == ["4"]


def test_every_row_without_cut(spark, hot):
    rows = [request(i, "compliance_officer", "customer_api_lookup", customer_id=i) for i in range(1, 8)]
    rows += [request(8, "compliance_officer", "customer_api_search", email="n", limit=3), request(9, "compliance_officer", "customer_api_search", email="zz")]
    rows += [request(10, "compliance_officer", "customer_api_search"), request(12, "compliance_officer", "customer_api_lookup")]
    got = {int(r.request_id): r for r in gateway.run_requests_by_row(frame(spark, rows), hot).collect()}
    assert [got[i].status for i in range(1, 8)] == ["blocked", "review_queued", "success", "success", "success", "success", "success"]
    assert [got[i].out_rows for i in (1, 2, 4, 5, 6, 7, 8, 10)] == [5001, 5001, 5001, 5, 1, 1, 3, 1]
    assert (got[9].status, got[9].out_rows) == ("success", None) and (got[12].status, got[12].out_rows) == ("error", 0)
    assert got[4].tool_output_raw_hash == _hash(_rows(hot, spark, 4))


def test_rows_of_a_customer_are_dealt_to_pages(spark, hot):
    calls = spark.createDataFrame([("analyst", "1"), ("compliance_officer", "1"), ("analyst", "99"), ("analyst", None), ("analyst", "x")], "role string, call_key string")
    rows = lookup.lookup_rows(calls, hot["customers"](spark), hot["accounts"](spark), page_size=100).cache()
    pages = {(r.role, r.page): r["count"] for r in rows.filter("call_key = '1'").groupBy("role", "page").count().collect()}
    assert len(pages) == 100 and max(pages.values()) < 200 and sum(pages.values()) == 2 * 5001
    assert "account_number" not in rows.filter("role = 'analyst' and call_key = '1' and position >= 0").first().row_json
    other = {r.call_key: (r.row_json, r.error) for r in rows.filter("call_key is null or call_key <> '1'").collect()}
    assert "not found" in other["99"][0] and other["99"][1] is None and other[None][0] is None and "required" in other[None][1]


def test_one_run_per_text(spark, bank, monkeypatch):
    """A cut SQL text is computed once; text and verdict come from the stored rows."""
    ran = []
    whole = governed.governed_query
    monkeypatch.setattr(governed, "governed_query", lambda s, query, *a, **k: (ran.append(query), whole(s, query, *a, **k))[1])
    rows = [request(i, "compliance_officer", "sql_query", "SELECT * FROM transactions ORDER BY id") for i in range(3)]
    (first, *rest) = gateway.run_requests(frame(spark, rows), bank).collect()
    assert len(ran) == 1 and first.response.endswith("[truncated]") and all(r.response == first.response for r in rest)


def test_columns_that_share_a_name(spark, bank):
    calls = spark.createDataFrame(
        [("analyst", "SELECT c.id, a.id FROM customers c JOIN accounts a ON c.id = a.customer_id WHERE c.id = 3 ORDER BY a.id LIMIT 2"),
         ("analyst", "SELECT c.*, a.* FROM customers c JOIN accounts a ON c.id = a.customer_id WHERE c.id = 3 ORDER BY a.id LIMIT 1"),
         ("compliance_officer", "SELECT 1 AS x, 2 AS x FROM customers LIMIT 1")], "role string, call_key string")
    got = {(r.role, r.call_key[:10]): r for r in governed.query_outputs(calls, bank, 4096).collect()}
    ids = [r.id for r in bank["accounts"](spark).filter("customer_id = 3").orderBy("id").limit(2).collect()]
    assert json.loads(got["analyst", "SELECT c.i"].output) == [{"id": i} for i in ids]
    (row,) = json.loads(got["analyst", "SELECT c.*"].output)
    assert row["id"] == ids[0] and "ssn" not in row and "account_number" not in row and row["customer_id"] == 3
    assert json.loads(got["compliance_officer", "SELECT 1 A"].output) == [{"x": 2}]
    rows = governed.query_rows(calls, bank).filter("error is not null").collect()
    assert rows == []


def test_texts_take_the_first_rows(spark):
    """Rows lie in many tasks; the text begins with the first ones and stops at the cut."""
    rows = spark.range(0, 5000, 1, 40).select(
        F.lit("r").alias("role"), F.lit("q").alias("call_key"), F.monotonically_increasing_id().alias("position"), F.col("id").cast("string").alias("row_json"), F.lit(None).cast("string").alias("error")
    )
    calls = spark.createDataFrame([("r", "q"), ("r", "none")], "role string, call_key string")
    got = {r.call_key: r.output for r in governed.row_texts(calls, rows, 1000).collect()}
    whole = "[" + ", ".join(map(str, range(5000))) + "]"
    assert got == {"q": whole[:1000] + "\n... [truncated]", "none": "[]"}
