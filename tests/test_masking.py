import hashlib

import pytest
from pyspark.sql import functions as F

from tests import brute
from veilframe.catalog import fixtures
from veilframe.functions.masking import BUNDLED, Policy, apply_policy, final_action, get_policy, pipeline_decision
from veilframe.functions.spans import SPAN_TYPE, detect
from veilframe.plans import corpus

TEXT = "My name is Alice Smith, email is alice@example.com, thanks"
SPANS = [("private_person", 11, 22, "Alice Smith", 0.95), ("private_email", 33, 50, "alice@example.com", 0.98)]


def apply(spark, text, spans, policy, direction="outbound", **kw):
    df = spark.createDataFrame([(text, spans)], f"text string, spans {SPAN_TYPE}")
    s = apply_policy(F.col("text"), F.col("spans"), policy.name if isinstance(policy, Policy) else policy, direction,
                     F.lit("r1"), {**BUNDLED, policy.name: policy} if isinstance(policy, Policy) else BUNDLED, **kw)
    return df.select(s.alias("s"), pipeline_decision(s, direction).alias("d")).first()


def uniform(action):
    return Policy.uniform("p", "p_v1", action, "why")


def test_allow(spark):
    out = apply(spark, TEXT, SPANS, uniform("allow"))
    assert out.s.mutated_text == TEXT and out.s.mutations == [] and out.d.action == "allow"
    assert [d.category for d in out.s.decisions] == ["private_email", "private_person"]
    assert out.s.original_text_hash == hashlib.sha256(TEXT.encode()).hexdigest()


def test_redact(spark):
    out = apply(spark, TEXT, SPANS, uniform("redact"))
    assert out.s.mutated_text == "My name is [private_person], email is [private_email], thanks"
    assert [m.start for m in out.s.mutations] == [33, 11]
    assert out.d.reason == "Applied 2 mutations: redact" and out.d.action == "transform"


def test_hash_is_stable_and_tunable(spark):
    out = apply(spark, TEXT, SPANS, uniform("hash"))
    assert "[private_person:8ae10dfc]" in out.s.mutated_text
    longer = apply(spark, TEXT, SPANS, uniform("hash"), hash_length=16, salt="s")
    assert hashlib.sha256(b"sAlice Smith").hexdigest()[:16] in longer.s.mutated_text


def test_hash_uses_span_text_and_splice_uses_offsets(spark):
    spans = [("private_email", 36, 999, "alice@example.com", 0.9)]
    out = apply(spark, TEXT, spans, uniform("hash"))
    token = hashlib.sha256(b"alice@example.com").hexdigest()[:8]
    assert out.s.mutated_text == TEXT[:36] + f"[private_email:{token}]"
    assert out.s.mutations[0].end == len(TEXT)


def test_vault(spark):
    out = apply(spark, TEXT, SPANS, uniform("vault"))
    assert [v.original_text for v in out.s.vault] == ["Alice Smith", "alice@example.com"]
    assert out.s.vault[1].context_hash == hashlib.sha256(TEXT[0:100].encode()).hexdigest()
    for v in out.s.vault:
        assert f":vault-ref-{v.vault_ref}]" in out.s.mutated_text
    assert apply(spark, TEXT, SPANS, uniform("vault")).s.vault == out.s.vault
    assert "Alice" not in out.s.mutated_text


def test_review_leaves_text(spark):
    out = apply(spark, TEXT, SPANS, uniform("review"))
    assert out.s.mutated_text == TEXT and out.s.has_review_flag and len(out.s.review_queue_id) == 36
    assert [r.start for r in out.s.review] == [11, 33] and out.d.action == "human_review"


def test_block_names_rightmost(spark):
    out = apply(spark, TEXT, SPANS, uniform("block"), "inbound")
    assert out.s.blocked and out.s.violation.category == "private_email"
    assert out.d.action == "block" and out.d.sanitized_text is None and out.d.triggered_rules == ["private_email"]
    assert out.d.reason == "Policy violation (inbound): BLOCK policy triggered: why"


def test_mixed_and_missing(spark):
    policy = Policy("p", "v", {("outbound", "private_email"): ("hash", "h")})
    out = apply(spark, TEXT, SPANS, policy)
    assert [d.reason for d in out.s.decisions] == ["h", "No policy defined for private_person in outbound"]
    assert "Alice Smith" in out.s.mutated_text


def test_blocked_text_has_no_vault_or_review_content(spark):
    rules = {("outbound", "private_email"): ("vault", "v"), ("outbound", "private_person"): ("block", "b")}
    out = apply(spark, TEXT, SPANS, Policy("p", "v", rules))
    assert out.s.blocked and out.s.vault == [] and out.s.review == [] and not out.s.has_review_flag


@pytest.mark.parametrize(
    "text,kept",
    [
        ('{"balance": 4969596700}', True),
        ('[4969596700, 1]', True),
        ('[1, 4969596700]', True),
        ('call 555-123-4567 now', False),
        ('call 555-123-4567', True),
        ('x4969596700}', False),
    ],
)
def test_numeric_guard(spark, text, kept):
    df = spark.createDataFrame([(text,)], "text string")
    out = corpus.redact_corpus(df, "strict_financial").first().sanitized
    start = next(s for c, s, e, _ in brute.spans(text) if c == "private_phone")
    before, after = text[max(0, start - 3):start], text[start:]
    assert (out.mutated_text == text) == kept, (before, after)


def test_unknown_names_fail(spark):
    with pytest.raises(ValueError):
        get_policy("nope")
    with pytest.raises(ValueError):
        apply_policy(F.col("t"), F.col("s"), "nope", "outbound")
    with pytest.raises(ValueError):
        apply_policy(F.col("t"), F.col("s"), "strict_financial", "sideways")


def test_many_spans(spark):
    text = " ".join(f"u{i}@x.org é" for i in range(500))
    df = spark.createDataFrame([(text,)], "text string")
    out = corpus.redact_corpus(df, "strict_financial").first()
    expected = brute.splice(text, [(s, e, f"[{c}]") for c, s, e, _ in brute.spans(text)])
    assert out.sanitized.mutated_text == expected and len(out.detections) == 500


def test_masked_corpus_invariants(spark, sf):
    docs = fixtures.documents(spark, sf)
    out = corpus.redact_corpus(docs, "permissive_analyst", request_id=F.col("doc_id").cast("string"))
    for r in out.select("text", "detections", "sanitized").collect():
        assert [(s.category, s.start, s.end, s.text) for s in r.detections] == brute.spans(r.text)
        edits = [(m.start, m.end, m.replacement) for m in r.sanitized.mutations]
        assert r.sanitized.mutated_text == brute.splice(r.text, edits)
        assert len(r.sanitized.mutated_text) == len(r.text) + sum(len(t) - (e - s) for s, e, t in edits)


def test_final_action(spark):
    kind = "array<struct<action:string>>"
    rows = [([("allow",), ("human_review",)],), ([("human_review",), ("block",), ("deny",)],), ([("transform",)],), ([],)]
    df = spark.createDataFrame(rows, f"d {kind}")
    got = [r[0] for r in df.select(final_action(F.col("d"))).collect()]
    assert got == ["human_review", "block", "allow", "allow"]


def test_plan_is_narrow_and_evaluates_detection_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = corpus.redact_corpus(docs, "strict_financial")
    rows = corpus.mutation_rows(out, "doc_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PythonUDF" not in plan
    assert plan.count("regexp_extract_all") == 8
    assert detect is not None
