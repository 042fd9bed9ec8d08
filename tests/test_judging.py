"""A result is judged once for all requests that get it; each request adds its ids."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_requests import frame, request
from veilframe.functions import masking
from veilframe.functions.masking import BUNDLED, Policy
from veilframe.functions.spans import detect
from veilframe.plans import gateway

TEXTS = [
    None, "", "nothing here", "call 555-123-4567 or 555-987-6543, mail a@b.com", "mail a@b.com at 742 Evergreen Terrace Ln",
    "SSN 123-45-6789 and 555-123-4567", '{"n": 5551234567, "m": "x@y.org"}',
]
RULES = {
    ("outbound", "private_phone"): ("vault", "v"), ("outbound", "private_email"): ("hash", "h"),
    ("outbound", "private_address"): ("review", "r"),
}
POLICIES = {
    "vaults": Policy("vaults", "1", RULES), "blocks": Policy("blocks", "1", {**RULES, ("outbound", "secret"): ("block", "b")}),
    "strict": Policy("strict", "1", {("outbound", "private_phone"): ("redact", "x"), ("outbound", "private_email"): ("vault", "y")}),
}


def test_judged_once_equals_judged_for_each_request(spark):
    rows = [(t, p, i) for t in TEXTS for p in (*POLICIES, "unknown", None) for i in ("1", "2", None)]
    df = spark.createDataFrame(rows, "text string, policy string, id string").withColumn("spans", detect(F.col("text")))
    text, spans, policy = F.col("text"), F.col("spans"), F.col("policy")
    each = masking.apply_policy(text, spans, policy, "outbound", F.col("id"), POLICIES)
    once = masking.for_request(masking.apply_once(text, spans, policy, "outbound", POLICIES), text, "outbound", F.col("id"))
    got = df.select(each.alias("each"), once.alias("once")).collect()
    assert [r.once for r in got] == [r.each for r in got]
    assert any(r.each.vault for r in got) and any(r.each.has_review_flag for r in got) and any(r.each.blocked for r in got)


def test_requests_of_one_call_share_the_verdict(spark, bank, monkeypatch):
    context = gateway.Context(policies={n: Policy(n, f"{n}_x", {**RULES, ("outbound", "private_person"): ("vault", "p")}) for n in BUNDLED})
    query = "SELECT id, phone, email FROM customers ORDER BY id LIMIT 2"
    rows = [request(i, role, "sql_query", query) for i, role in ((1, "analyst"), (2, "analyst"), (3, "compliance_officer"))]
    admitted = gateway.admit(frame(spark, rows), context)
    outputs = gateway.execute(admitted, bank, context)
    judged = gateway._judged(outputs, admitted, context)
    assert judged.count() == 2  # one a role, not one a request
    monkeypatch.setattr(gateway, "apply_policy", lambda *a: 1 / 0)  # not once more for each request
    got = {r.request_id: r for r in gateway.finish(admitted, outputs, context).collect()}
    refs = {i: [v.vault_ref for v in r.outbound.vault] for i, r in got.items()}
    assert all(refs.values()) and not set(refs["1"]) & set(refs["2"])
    for i, r in got.items():
        assert len(json.loads(r.response)) == 2 and all(v in r.response for v in refs[i])
        assert r.outbound_decision.sanitized_text == r.outbound.mutated_text == r.response and r.outbound_decision.action == "transform"


@pytest.mark.parametrize("rule, status", [("review", "success"), ("block", "blocked")])
def test_ids_and_texts_of_decisions(spark, bank, rule, status):
    context = gateway.Context(policies={n: Policy(n, f"{n}_x", {("outbound", "private_phone"): (rule, "r")}) for n in BUNDLED})
    rows = [request(i, "analyst", "sql_query", "SELECT id, phone FROM customers ORDER BY id LIMIT 1") for i in (1, 2)]
    got = gateway.run_requests(frame(spark, rows), bank, context).collect()
    assert {r.status for r in got} == {status}
    queued = {r.outbound.review_queue_id for r in got}
    assert queued == {r.outbound_decision.review_queue_id for r in got} and len(queued - {None}) == (2 if rule == "review" else 0)
    assert all((r.outbound_decision.sanitized_text is None) == (rule == "block") for r in got)
