"""Questions about the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.functions.arrays import explode_rows

_EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
_ACTIVE = ("redact", "hash", "vault", "review", "block")
_BUCKETS = 200


def layer_status(audit: DataFrame) -> DataFrame:
    """One row per record and layer: ``(request_id, layer_no, layer, layer_status, detail)``.

    A block with a result behind it is an outbound one: it fails the outbound layer and
    the layers before it ran.
    """
    status = F.col("status")
    denied, timed_out = status == "rbac_denied", status == "timeout"
    has_output = ~F.coalesce("tool_output_raw_hash", F.lit("")).isin("", _EMPTY_HASH)
    blocked_in, blocked_out = (status == "blocked") & ~has_output, (status == "blocked") & has_output
    executed = status.isin("success", "review_queued") | blocked_out
    out_ran = executed | timed_out

    def active(name: str) -> Column:
        return F.exists(name, lambda d: d["action"].isin(*_ACTIVE))

    def found(name: str) -> Column:
        kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(name, lambda d: d["category"]))), ",")
        return F.concat(F.size(name).cast("string"), F.lit(" "), kinds)

    def taken(name: str) -> Column:
        return F.array_join(F.transform(name, lambda d: F.concat(d["category"], F.lit(":"), d["action"])), ",")

    states = [
        (F.when(denied, "fail").otherwise("pass"), F.when(denied, "Access denied").otherwise("Access granted")),
        (
            F.when(denied, "skipped").when(F.size("inbound_detections") > 0, "transform").otherwise("pass"),
            F.when(~denied, found("inbound_detections")).otherwise("0 "),
        ),
        (
            F.when(denied, "skipped").when(blocked_in, "fail")
            .when(active("policy_decisions_inbound"), "transform").otherwise("pass"),
            F.when(~denied, taken("policy_decisions_inbound")).otherwise(""),
        ),
        (
            F.when(executed, "pass").when(timed_out | (status == "error"), "fail").otherwise("skipped"),
            F.round("latency_ms", 1).cast("string"),
        ),
        (
            F.when(~out_ran, "skipped").when(F.size("outbound_detections") > 0, "transform").otherwise("pass"),
            F.when(out_ran, found("outbound_detections")).otherwise("0 "),
        ),
        (
            F.when(~out_ran, "skipped").when(blocked_out, "fail")
            .when(active("policy_decisions_outbound"), "transform").otherwise("pass"),
            F.when(out_ran, taken("policy_decisions_outbound")).otherwise(""),
        ),
        (F.lit("pass"), F.concat(status, F.when(F.col("review_queue_id").isNotNull(), " queued").otherwise(""))),
    ]
    layers = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("layer_no"), F.lit(fixed.LAYERS[i]).alias("layer"),
                state.alias("layer_status"), detail.alias("detail"),
            )
            for i, (state, detail) in enumerate(states)
        ]
    )
    return explode_rows(audit.select("request_id", layers.alias("_layers")), F.col("_layers"), "_l").select(
        "request_id", "_l.*"
    )


def layer_counts(audit: DataFrame) -> DataFrame:
    return layer_status(audit).groupBy("layer_no", "layer", "layer_status").agg(F.count("*").alias("records"))


def detection_counts(audit: DataFrame) -> DataFrame:
    """Number and sorted categories of the detections of each record, per direction."""

    def kinds(name: str) -> Column:
        return F.array_sort(F.array_distinct(F.transform(name, lambda d: d["category"])))

    return audit.select(
        "request_id",
        F.size("inbound_detections").alias("n_inbound"), kinds("inbound_detections").alias("inbound_categories"),
        F.size("outbound_detections").alias("n_outbound"), kinds("outbound_detections").alias("outbound_categories"),
    )


def latest_records(audit: DataFrame, *keys: Column) -> DataFrame:
    """Last record per key by time, then request id. The ranking filter is also applied before
    the shuffle, so a user with a large share of the log costs one row per task."""
    last = Window.partitionBy(*keys).orderBy(F.desc("timestamp_utc"), F.desc("request_id"))
    return audit.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= 1).drop("_n")


def policy_in_effect(audit: DataFrame) -> DataFrame:
    """First and last use and number of requests of each policy and model version."""
    return audit.groupBy("policy_version", "model_version").agg(
        F.min("timestamp_utc").alias("first_used"), F.max("timestamp_utc").alias("last_used"),
        F.count("*").alias("requests"),
    )


def review_summary(review: DataFrame) -> DataFrame:
    return review.groupBy("status", "direction").agg(F.count("*").alias("entries"))


def correlate(audit: DataFrame, review: DataFrame, vault: DataFrame) -> DataFrame:
    """Audit records with their review entry and the number of their vault entries.

    Most records have no review id. They get a key of their own, which matches nothing,
    instead of meeting under one null key.
    """
    held = vault.groupBy("request_id").agg(F.count("*").alias("vault_entries"))
    queued = review.select(
        F.col("review_id").alias("_key"), F.col("status").alias("review_status"),
        F.size("detections").alias("review_detections"),
    )
    return (
        audit.withColumn("_key", F.coalesce("review_queue_id", F.concat(F.lit("none-"), "request_id")))
        .join(queued, "_key", "left")
        .drop("_key")
        .join(held, "request_id", "left")
        .withColumn("vault_entries", F.coalesce("vault_entries", F.lit(0)))
    )


def correlate_stored(audit: DataFrame, review: DataFrame, vault: DataFrame) -> DataFrame:
    """``correlate`` by request id alone, for tables stored in buckets of it
    (``sources.bucketed``): neither the join nor the counts shuffle any of the three. A request has
    at most one review entry a direction."""
    held = vault.groupBy("request_id").agg(F.count("*").alias("vault_entries"))
    entry = F.struct(F.col("status").alias("review_status"), F.size("detections").alias("review_detections"))
    queued = review.groupBy("request_id").agg(F.collect_list(F.struct("review_id", entry.alias("entry"))).alias("_entries"))
    own = F.get(F.filter("_entries", lambda e: e["review_id"] == F.col("review_queue_id")), 0)["entry"]
    return (
        audit.join(queued, "request_id", "left").join(held, "request_id", "left")
        .withColumns({"_own": own, "vault_entries": F.coalesce("vault_entries", F.lit(0))})
        .select(*audit.columns, "_own.review_status", "_own.review_detections", "vault_entries")
    )


def latency_statistics(audit: DataFrame, value: str = "latency_ms") -> DataFrame:
    """Count, mean, median and the nearest-rank p90, p95, p99 ``sorted[int(n * p)]``, exactly.

    Equal values are counted before any ranking. Approximate quantiles of a first pass
    cut the value range into buckets of similar size; ranks run inside a bucket, on top
    of the counts of the buckets before it. The cuts only balance the work, so their
    error does not touch the result.
    """
    x = F.col(value).cast("double")
    cuts = audit.agg(F.percentile_approx(x, [i / _BUCKETS for i in range(1, _BUCKETS)], 2000)).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    counted = (
        audit.filter(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("c"))
        .withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("x"))))
    )
    totals = counted.groupBy("bucket").agg(F.sum("c").alias("n"))
    # at most one row per bucket from here on
    before = totals.select(
        "bucket",
        (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("offset"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    within = Window.partitionBy("bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(before, "bucket").withColumn("last", F.col("offset") + F.sum("c").over(within))
    first = F.col("last") - F.col("c")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("last")), F.col("x")))

    n = F.col("total")
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    return placed.agg(
        F.max("total").alias("n"),
        (F.sum(F.col("x") * F.col("c")) / F.max("total")).alias("mean"),
        ((at(low) + at(high)) / 2).alias("p50"),
        *[at(F.floor(n * F.lit(p))).alias(name) for name, p in (("p90", 0.90), ("p95", 0.95), ("p99", 0.99))],
    )
