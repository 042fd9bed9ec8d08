"""Masking of text tables: detect, apply a policy, keep verdicts. No shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.arrays import explode_rows
from veilframe.functions.masking import BUNDLED, Policy, apply_policy, pipeline_decision
from veilframe.functions.spans import above_threshold, detect, scan_summary
from veilframe import fixed_values as fixed


def detect_corpus(
    df: DataFrame, text: str = "text", threshold: float = 0.0, detector: Callable[[Column], Column] = detect
) -> DataFrame:
    """Add ``detections``. ``detector`` is any function from a text column to a span array."""
    spans = detector(F.col(text))
    return df.withColumn("detections", above_threshold(spans, threshold) if threshold > 0 else spans)


def summarize_corpus(df: DataFrame, text: str = "text", threshold: float = fixed.PII_THRESHOLD) -> DataFrame:
    """Add ``scan``: has_pii, confidence, detected_types, detections."""
    return detect_corpus(df, text, threshold).withColumn("scan", scan_summary(F.col("detections"))).drop("detections")


def redact_corpus(
    df: DataFrame,
    policy: str | Column,
    direction: str = "outbound",
    text: str = "text",
    request_id: Column | None = None,
    policies: Mapping[str, Policy] = BUNDLED,
    threshold: float = 0.0,
    hash_length: int = 8,
    salt: str = "",
    detector: Callable[[Column], Column] = detect,
) -> DataFrame:
    """Add ``detections``, ``sanitized`` and ``decision`` to a table of texts."""
    detected = detect_corpus(df, text, threshold, detector)
    return mask_corpus(detected, policy, direction, text, request_id, policies, hash_length, salt)


def mask_corpus(
    detected: DataFrame,
    policy: str | Column,
    direction: str = "outbound",
    text: str = "text",
    request_id: Column | None = None,
    policies: Mapping[str, Policy] = BUNDLED,
    hash_length: int = 8,
    salt: str = "",
) -> DataFrame:
    """Add ``sanitized`` and ``decision`` to texts with ``detections`` beside them, from whatever
    detector or table."""
    return (
        detected.withColumn(
            "sanitized",
            apply_policy(
                F.col(text), F.col("detections"), policy, direction, request_id, policies, hash_length, salt
            ),
        )
        .withColumn("decision", pipeline_decision(F.col("sanitized"), direction))
    )


def span_rows(df: DataFrame, *keys: str, spans: str = "detections") -> DataFrame:
    """One row per detection."""
    return explode_rows(df.select(*keys, F.col(spans).alias("_spans")), F.col("_spans"), "_s").select(*keys, "_s.*")


def vault_rows(df: DataFrame, *keys: str, sanitized: str = "sanitized") -> DataFrame:
    """Vault content, one row per vaulted span. Keep it apart from the audit trail."""
    content = df.select(*keys, F.col(f"{sanitized}.vault").alias("_vault"))
    return explode_rows(content, F.col("_vault"), "_v").select(*keys, "_v.*")


def mutation_rows(df: DataFrame, *keys: str, sanitized: str = "sanitized") -> DataFrame:
    content = df.select(*keys, F.col(f"{sanitized}.mutations").alias("_m"))
    return explode_rows(content, F.col("_m"), "_x").select(*keys, "_x.*")


def decision_rows(df: DataFrame, *keys: str, sanitized: str = "sanitized") -> DataFrame:
    content = df.select(*keys, F.col(f"{sanitized}.decisions").alias("_d"))
    return explode_rows(content, F.col("_d"), "_x", "position").select(*keys, "position", "_x.*")
