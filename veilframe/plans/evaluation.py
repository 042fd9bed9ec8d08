"""Evaluation of golden cases against their audit records, and table counts."""

from __future__ import annotations

from dataclasses import replace
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.functions import hashing
from veilframe.functions.masking import policy_version
from veilframe.functions.spans import safe_spans
from veilframe.operators.governed import Tables
from veilframe.plans.gateway import Context, run_requests_by_row


def audit_complete(record: Mapping[str, Column], status: Column) -> Column:
    """Eight required fields present and not empty; a denied request needs no policy."""
    complete = F.lit(True)
    for name, value in record.items():
        present = value.isNotNull() & (value.cast("string") != "")
        if name == "policy_version":
            present = present | (status == "rbac_denied")
        complete = complete & F.coalesce(present, F.lit(False))
    return complete


def required_fields(df: DataFrame) -> dict[str, Column]:
    names = (
        "request_id", "timestamp_utc", "actor", "tool_name", "raw_query_hash", "status", "policy_version",
        "model_version",
    )
    return {n: (F.col("actor.user_id") if n == "actor" else F.col(n)) for n in names}


def audit_rows_by_row(log: DataFrame) -> DataFrame:
    """Audit records of ``run_requests_by_row``; a denied request has no policy version."""
    return log.select(
        "request_id",
        F.col("ts").alias("timestamp_utc"),
        hashing.actor(F.col("role"), F.col("user_id"), F.col("request_id")).alias("actor"),
        "tool_name",
        F.sha2("scan_text", 256).alias("raw_query_hash"),
        safe_spans(F.col("inbound_detections")).alias("inbound_detections"),
        "status",
        "review_queue_id",
        "tool_output_raw_hash",
        F.when(F.col("status") == "rbac_denied", "").otherwise(policy_version(F.col("policy"))).alias("policy_version"),
        F.lit(fixed.MODEL_VERSION).alias("model_version"),
    )


def evaluate_cases(cases: DataFrame, tables: Tables, context: Context = Context()) -> DataFrame:
    """Run request-shaped golden cases and judge each against its audit record.

    ``cases`` are requests with ``case_id``, ``expected_status``, ``expected_rbac`` and
    ``expected_inbound_categories``. Only texts that start with SELECT are checked
    against tables and columns, as a case may be any text.
    """
    requests = cases.withColumn("request_id", F.col("case_id"))
    records = audit_rows_by_row(run_requests_by_row(requests, tables, replace(context, select_only=True)))
    return judge_cases(cases, records)


def judge_cases(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Golden cases joined to their records on the case id carried as request id."""
    expected = cases.select("case_id", "expected_status", "expected_rbac", "expected_inbound_categories")
    joined = expected.join(
        records.withColumn("_found", F.lit(True)), expected["case_id"] == records["request_id"], "left"
    )
    found = F.coalesce("_found", F.lit(False))
    status = F.col("status")
    actual = F.array_distinct(F.transform("inbound_detections", lambda d: d["category"]))
    missing = F.array_sort(
        F.array_except(F.coalesce("expected_inbound_categories", F.array().cast("array<string>")), actual)
    )
    rbac = F.when(status == "rbac_denied", "deny").otherwise("allow")
    return joined.select(
        "case_id",
        "status",
        (found & (rbac == F.col("expected_rbac"))).alias("rbac_ok"),
        F.coalesce(
            found
            & ((status == F.col("expected_status")) | ((F.col("expected_status") == "success") & (status == "review_queued"))),
            F.lit(False),
        ).alias("status_ok"),
        F.coalesce(found & (F.size(missing) == 0), F.lit(False)).alias("inbound_ok"),
        (found & audit_complete(required_fields(joined), status)).alias("audit_ok"),
        missing.alias("missing_categories"),
        F.when(~found, "No audit record produced")
        .when(rbac != F.col("expected_rbac"), F.concat(F.lit("RBAC expected="), "expected_rbac", F.lit(", got="), rbac))
        .when(
            (status != F.col("expected_status")) & ~((F.col("expected_status") == "success") & (status == "review_queued")),
            F.concat(F.lit("Status expected="), "expected_status", F.lit(", got="), status),
        )
        .when(F.size(missing) > 0, F.concat(F.lit("Missing inbound PII categories: "), F.array_join(missing, ", ")))
        .alias("problem"),
    )


def metrics(judged: DataFrame) -> DataFrame:
    """Totals, correct counts, whole percentages and the overall score of four per case."""

    def correct(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("long")), F.lit(0))

    counts = judged.agg(
        F.count("*").alias("total"),
        correct("rbac_ok").alias("rbac_correct"),
        correct("status_ok").alias("status_correct"),
        correct("inbound_ok").alias("inbound_pii_correct"),
        correct("audit_ok").alias("audit_complete"),
    )

    def pct(name: str) -> Column:
        return F.when(F.col("total") == 0, F.lit(0)).otherwise(F.bround(100 * F.col(name) / F.col("total"))).cast("long")

    overall = F.col("rbac_correct") + F.col("status_correct") + F.col("inbound_pii_correct") + F.col("audit_complete")
    return counts.select(
        "*", pct("rbac_correct").alias("rbac_pct"), pct("status_correct").alias("status_pct"),
        pct("inbound_pii_correct").alias("inbound_pii_pct"), pct("audit_complete").alias("audit_pct"),
        overall.alias("overall"), (4 * F.col("total")).alias("max_score"),
    )


def problems(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("problem").isNotNull()).select("case_id", "problem")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table and their total."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    totals = counts.rollup("name").agg(F.sum("rows").alias("rows"))
    return totals.select(F.coalesce("name", F.lit("total")).alias("name"), "rows")
