"""Registered queries: policies, masking, vault and review content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.catalog import fixtures, sqlparts as S
from veilframe.functions import hashing
from veilframe.functions.masking import BUNDLED, Policy, policy_rule, policy_version
from veilframe.plans import corpus

QUERIES, ORACLES = {}, {}

def _masked(policy: str, direction: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = corpus.redact_corpus(
            fixtures.documents(spark, sf), policy, direction, request_id=F.col("doc_id").cast("string")
        )
        return out.select(
            "doc_id",
            F.size("detections").alias("n_spans"),
            F.size("sanitized.mutations").alias("n_mutations"),
            F.col("decision.action").alias("verdict"),
            F.col("decision.reason").alias("reason"),
            F.array_join("decision.triggered_rules", ",").alias("triggered_rules"),
            F.array_join("decision.categories", ",").alias("categories"),
            "sanitized.review_queue_id",
            F.col("sanitized.original_text_hash").alias("original_hash"),
            F.sha2("decision.sanitized_text", 256).alias("masked_text_hash"),
        )

    return run


def _masked_sql(policy: str, direction: str) -> str:
    review = S.uuid_of(f"concat_ws('|', CAST(d.doc_id AS VARCHAR), '{direction}', 'review')")
    return (
        f"WITH RECURSIVE {S.documents_cte()}, {S.rules_cte()}, {S.spans('src')}, {S.judged(direction, S.text(policy))} "
        "SELECT d.doc_id, coalesce(v.n_spans, 0) AS n_spans, coalesce(v.n_mutations, 0) AS n_mutations, "
        f"{S.decision_action()} AS verdict, {S.decision_reason(direction)} AS reason, "
        "CASE WHEN v.blocked THEN v.violation ELSE coalesce(replace(v.kinds, ', ', ','), '') END AS triggered_rules, "
        "CASE WHEN v.blocked THEN '' ELSE coalesce(v.categories, '') END AS categories, "
        f"CASE WHEN v.review THEN {review} END AS review_queue_id, sha256(d.text) AS original_hash, "
        "CASE WHEN coalesce(v.blocked, false) THEN NULL ELSE sha256(coalesce(m.mutated, d.text)) END AS masked_text_hash "
        "FROM docs d LEFT JOIN verdicts v ON v.k = d.doc_id LEFT JOIN spliced m ON m.k = d.doc_id"
    )


for _policy, _short in (("strict_financial", "strict"), ("permissive_analyst", "permissive")):
    for _direction in fixed.DIRECTIONS:
        QUERIES[f"mask_{_short}_{_direction}"] = _masked(_policy, _direction)
        ORACLES[f"mask_{_short}_{_direction}"] = _masked_sql(_policy, _direction)


def mutations(spark: SparkSession, sf: str) -> DataFrame:
    out = corpus.redact_corpus(
        fixtures.documents(spark, sf), "permissive_analyst", "outbound", request_id=F.col("doc_id").cast("string")
    )
    return corpus.mutation_rows(out, "doc_id").select(
        "doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "category", "action",
        "replacement", "vault_ref",
    )


QUERIES["mutations"] = mutations
ORACLES["mutations"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.rules_cte()}, {S.spans('src')}, {S.judged('outbound', S.text('permissive_analyst'))} "
    "SELECT k AS doc_id, s AS span_start, e AS span_end, category, action, replacement, vault_ref FROM edits"
)


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of both policies in one job: the policy is a column."""
    docs = fixtures.documents(spark, sf).withColumn(
        "policy", F.when(F.col("doc_id") % 2 == 0, "strict_financial").otherwise("permissive_analyst")
    )
    out = corpus.redact_corpus(docs, F.col("policy"), "outbound", request_id=F.col("doc_id").cast("string"))
    return corpus.decision_rows(out, "doc_id").select("doc_id", "position", "category", "action", "reason")


QUERIES["decisions_by_row_policy"] = decisions
ORACLES["decisions_by_row_policy"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.rules_cte()}, {S.spans('src')}, "
    + S.judged("outbound", "CASE WHEN k % 2 = 0 THEN 'strict_financial' ELSE 'permissive_analyst' END")
    + " SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY s DESC) - 1 AS position, category, action, reason FROM judged"
)


def policy_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What either policy would do with the spans of the corpus, per direction."""
    rows = corpus.span_rows(corpus.detect_corpus(fixtures.documents(spark, sf)), "doc_id")
    per = rows.groupBy("category").agg(F.count("*").alias("spans"))
    name = F.explode(F.array(*[F.lit(p) for p in fixed.POLICIES])).alias("policy")
    per = per.select("*", name)
    out = None
    for direction in fixed.DIRECTIONS:
        rule = policy_rule(F.col("policy"), direction, F.col("category"))
        part = per.select(
            "policy", policy_version(F.col("policy")).alias("version"), F.lit(direction).alias("direction"), "category",
            rule["action"].alias("action"), rule["reason"].alias("reason"), "spans",
        )
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["policy_actions"] = policy_actions
ORACLES["policy_actions"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.rules_cte()}, {S.spans('src')}, "
    "n AS (SELECT category, count(*) AS spans FROM spans GROUP BY 1) "
    "SELECT r.policy, r.policy || '_v1' AS version, r.direction, r.category, r.action, r.reason, n.spans FROM n JOIN rules r USING (category)"
)

UNIFORM = Policy.uniform("redact_all", "redact_all_v1", "redact", "Redact everything")
PARTIAL = Policy("partial", "partial_v1", {("outbound", "secret"): ("hash", "Hash secrets")})


def _custom(policy: Policy):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = corpus.redact_corpus(
            fixtures.documents(spark, sf), policy.name, "outbound", policies={**BUNDLED, policy.name: policy}
        )
        return corpus.decision_rows(out, "doc_id", ).groupBy("category", "action", "reason").agg(
            F.count("*").alias("decisions"), F.countDistinct("doc_id").alias("documents")
        )

    return run


def _custom_sql(rules: str) -> str:
    return (
        f"WITH RECURSIVE {S.documents_cte()}, rules AS ({rules}), {S.spans('src')}, {S.judged('outbound', S.text('custom'))} "
        "SELECT category, action, reason, count(*) AS decisions, count(DISTINCT k) AS documents FROM judged GROUP BY 1, 2, 3"
    )


QUERIES["uniform_policy"] = _custom(UNIFORM)
ORACLES["uniform_policy"] = _custom_sql(
    "SELECT 'custom' AS policy, 'outbound' AS direction, unnest([" + ", ".join(S.text(c) for c in fixed.CATEGORIES)
    + "]) AS category, 'redact' AS action, 'Redact everything' AS reason"
)
QUERIES["partial_policy"] = _custom(PARTIAL)
ORACLES["partial_policy"] = _custom_sql(
    "SELECT 'custom' AS policy, 'outbound' AS direction, 'secret' AS category, 'hash' AS action, 'Hash secrets' AS reason"
)


def vault_content(spark: SparkSession, sf: str) -> DataFrame:
    out = corpus.redact_corpus(
        fixtures.documents(spark, sf), "permissive_analyst", "outbound", request_id=F.col("doc_id").cast("string")
    )
    return corpus.vault_rows(out, "doc_id")


QUERIES["vault_content"] = vault_content
ORACLES["vault_content"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.rules_cte()}, {S.spans('src')}, {S.judged('outbound', S.text('permissive_analyst'))} "
    "SELECT k AS doc_id, vault_ref, category, span_text AS original_text, "
    "sha256(substr(text, greatest(s - 50, 0) + 1, e + 50 - greatest(s - 50, 0))) AS context_hash FROM judged WHERE action = 'vault'"
)


def review_content(spark: SparkSession, sf: str) -> DataFrame:
    out = corpus.redact_corpus(
        fixtures.documents(spark, sf), "strict_financial", "outbound", request_id=F.col("doc_id").cast("string")
    )
    rows = out.select("doc_id", "sanitized.review_queue_id", F.col("sanitized.review").alias("r"))
    return corpus.span_rows(rows, "doc_id", "review_queue_id", spans="r").select(
        "doc_id", "review_queue_id", "category", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        F.col("text").alias("span_text"),
    )


QUERIES["review_content"] = review_content
ORACLES["review_content"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.rules_cte()}, {S.spans('src')}, {S.judged('outbound', S.text('strict_financial'))} "
    "SELECT j.k AS doc_id, " + S.uuid_of("concat_ws('|', CAST(j.k AS VARCHAR), 'outbound', 'review')") + " AS review_queue_id, "
    "category, s AS span_start, e AS span_end, span_text FROM judged j JOIN verdicts v USING (k) WHERE v.review AND j.action = 'review'"
)


def violations(spark: SparkSession, sf: str) -> DataFrame:
    out = corpus.redact_corpus(fixtures.documents(spark, sf), "strict_financial", "outbound")
    return (
        out.select("sanitized.violation")
        .groupBy("violation.category", "violation.direction", "violation.reason")
        .agg(F.count("*").alias("documents"))
    )


QUERIES["policy_violations"] = violations
ORACLES["policy_violations"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.rules_cte()}, {S.spans('src')}, {S.judged('outbound', S.text('strict_financial'))} "
    "SELECT CASE WHEN v.blocked THEN v.violation END AS category, CASE WHEN v.blocked THEN 'outbound' END AS direction, "
    "CASE WHEN v.blocked THEN 'BLOCK policy triggered: ' || v.violation_reason END AS reason, count(*) AS documents "
    "FROM docs d LEFT JOIN verdicts v ON v.k = d.doc_id GROUP BY 1, 2, 3"
)


def pseudonym_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by pseudonym: the same value has the same token everywhere."""
    rows = corpus.span_rows(corpus.detect_corpus(fixtures.documents(spark, sf)), "doc_id")
    token = F.concat(F.lit("["), "category", F.lit(":"), hashing.sha256_short(F.col("text")), F.lit("]"))
    return rows.groupBy(token.alias("token")).agg(
        F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents")
    )


QUERIES["pseudonym_groups"] = pseudonym_groups
ORACLES["pseudonym_groups"] = (
    f"WITH RECURSIVE {S.documents_cte()}, {S.spans('src')} SELECT '[' || category || ':' || substr(sha256(span_text), 1, 8) || ']' AS token, "
    "count(*) AS spans, count(DISTINCT k) AS documents FROM spans GROUP BY 1"
)


def pseudonym_join(spark: SparkSession, sf: str) -> DataFrame:
    """Customers who share a name, found through its pseudonym alone."""
    customers = fixtures.bank(sf)["customers"](spark)
    name = F.concat_ws(" ", "first_name", "last_name")
    masked = customers.select("id", hashing.sha256_short(name).alias("token"))
    shared = masked.groupBy("token").agg(F.count("*").alias("holders")).filter("holders > 1")
    return masked.join(shared, "token").select("id", "token", "holders")


QUERIES["pseudonym_join"] = pseudonym_join
ORACLES["pseudonym_join"] = (
    f"WITH customers AS ({fixtures.CUSTOMERS}), masked AS (SELECT id, substr(sha256(first_name || ' ' || last_name), 1, 8) AS token FROM customers), "
    "shared AS (SELECT token, count(*) AS holders FROM masked GROUP BY 1 HAVING count(*) > 1) "
    "SELECT id, token, holders FROM masked JOIN shared USING (token)"
)


def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.documents(spark, sf)
    return docs.select(
        "doc_id", hashing.sha256_hash(F.col("text")).alias("full_hash"),
        hashing.sha256_short(F.col("text")).alias("short_hash"),
        hashing.sha256_short(F.col("text"), 16, "pepper").alias("salted_hash"),
    )


QUERIES["text_hashes"] = text_hashes
ORACLES["text_hashes"] = (
    f"WITH {S.documents_cte()} SELECT doc_id, sha256(text) AS full_hash, substr(sha256(text), 1, 8) AS short_hash, "
    "substr(sha256('pepper' || text), 1, 16) AS salted_hash FROM docs"
)
