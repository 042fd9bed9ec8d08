"""The seven governance stages over a table of requests.

Stages 1-3 and 5-7 are columns; a stage is null where an earlier one stopped the
request. Stage 4 runs once per distinct call, not once per request, and its result is
scanned once, before it is joined back to the requests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.functions import hashing
from veilframe.functions.arrays import bind, empty
from veilframe.functions.canonical import error_json
from veilframe.functions.masking import (
    BUNDLED, Policy, apply_once, apply_policy, final_action, for_request, pipeline_decision, policy_version,
)
from veilframe.functions.spans import SPAN_TYPE, above_threshold, detect, safe_spans
from veilframe.operators.access import AccessRules, denial_text, rbac_reason
from veilframe.operators.governed import OUTPUT_SCHEMA, ROWS_SCHEMA, Tables, query_rows, row_texts
from veilframe.operators.lookup import lookup_outputs, lookup_rows, search_outputs, search_rows
from veilframe.sources.storage import durable, nothing, spread

INBOUND_REFUSED = "Inbound policy denied or blocked the request"
REVIEW_NEEDED = "Human review required (async backend cannot wait)"
REVIEW_ENDED = "Request cancelled or human review timeout"
TOTALS = "struct<rows:long,detections:long,rows_hash:string>"
_VIOLATION = "struct<category:string,direction:string,reason:string>"
_WHOLE = f"map<string,struct<violation:{_VIOLATION},review:{SPAN_TYPE}>>"
_DECISION = (
    "struct<action:string,reason:string,triggered_rules:array<string>,sanitized_text:string,"
    "has_review_flag:boolean,review_queue_id:string,categories:array<string>>"
)


@dataclass(frozen=True)
class Context:
    threshold: float = fixed.PII_THRESHOLD
    max_output_chars: int = fixed.MAX_OUTPUT_CHARS
    policies: Mapping[str, Policy] = field(default_factory=lambda: BUNDLED)
    rules: AccessRules = AccessRules()
    # a permission for customer_api covers customer_api_lookup and customer_api_search
    tool_family: bool = True
    detector: Callable[[Column], Column] = detect
    # judge results that the cut at max_output_chars has shortened by all of their rows
    judge_whole: bool = True
    # for golden cases: a text that is no SELECT is not checked against tables and columns
    select_only: bool = False


def scan_text(tool: Column, query: Column, customer_id: Column, name: Column, email: Column) -> Column:
    """The text of a request that is scanned for PII."""
    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("None"))

    return (
        F.when(tool == "sql_query", query)
        .when(
            tool == "customer_api_search",
            F.concat(F.lit("Search customers: name="), shown(name), F.lit(", email="), shown(email)),
        )
        .otherwise(F.concat(F.lit("Look up customer "), shown(customer_id)))
    )


def rewritten_query(tool: Column, query: Column, sanitized_text: Column) -> Column:
    """The text to run: the policy's version for SQL, if it is not empty."""
    return F.when((tool == "sql_query") & (sanitized_text != ""), sanitized_text).otherwise(query)


def _call_kind(tool: Column) -> Column:
    return (
        F.when(tool == "sql_query", "sql")
        .when(tool == "customer_api_search", "search")
        .when(tool.isin("customer_api", "customer_api_lookup"), "lookup")
        .otherwise("unknown")
    )


def admit(requests: DataFrame, context: Context = Context(), policy: Column | None = None) -> DataFrame:
    """Stages 1-3: access, inbound scan, inbound policy. Row-local, so it also runs on a stream.
    The scanned text of a SQL request is always its query, so no text runs unchecked."""
    role, tool = F.col("role"), F.col("tool_name")
    requests = requests.withColumn("scan_text", F.when(tool == "sql_query", F.col("query")).otherwise(F.col("scan_text")))
    checked = F.when(F.upper(F.trim("query")).startswith("SELECT"), F.col("query")) if context.select_only else F.col("query")
    policy = hashing.policy_for_mode(hashing.policy_mode(role)) if policy is None else policy
    granted = F.col("rbac_reason").isNull()
    no_spans = empty(SPAN_TYPE)
    scanned = F.when(granted, above_threshold(context.detector(F.col("scan_text")), context.threshold))
    return (
        requests.withColumn(
            "rbac_reason", rbac_reason(role, tool, checked, F.col("fields"), context.rules, context.tool_family)
        )
        .withColumn("policy", policy)
        .withColumn("inbound_detections", scanned.otherwise(no_spans))
        .withColumn(
            "inbound",
            F.when(
                granted,
                apply_policy(
                    F.col("scan_text"), F.col("inbound_detections"), F.col("policy"), "inbound",
                    F.col("request_id"), context.policies,
                ),
            ),
        )
        .withColumn("inbound_decision", F.when(granted, pipeline_decision(F.col("inbound"), "inbound")))
        .withColumn("review_decision", F.lit(None).cast(_DECISION))
        .withColumn(
            "gate",
            F.when(~granted, "rbac_denied")
            .when(F.col("inbound_decision.action") == "block", "blocked")
            .when(F.col("inbound_decision.action") == "human_review", "review_queued")
            .otherwise("run"),
        )
        .withColumn("call_kind", _call_kind(tool))
        .withColumn(
            "call_key",
            F.when(F.col("call_kind") == "sql", rewritten_query(tool, F.col("query"), F.col("inbound.mutated_text")))
            .when(F.col("call_kind") == "search", F.to_json(F.struct("name", "email", "limit")))
            .otherwise(F.col("customer_id").cast("string")),
        )
    )


def resume(admitted: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Held requests with what became of their review: ``(request_id, outcome, action, reason)``."""
    held = admitted.filter(F.col("gate") == "review_queued")
    given = outcomes.select("request_id", F.struct("outcome", "action", "reason").alias("_review"))
    return decided(held.join(given, "request_id"), "_review")


def decided(held: DataFrame, review: str) -> DataFrame:
    """Held requests under the outcome of their review, a struct ``(outcome, action, reason)`` beside
    them. The reviewer's decision takes the place of the inbound one: unless it denies, the request
    runs as it was asked. A cancel or timeout ends it in an error."""
    outcome, action, reason = (F.col(f"{review}.{c}") for c in ("outcome", "action", "reason"))
    reviewed = outcome == "reviewed"
    decision = F.struct(
        action.alias("action"), reason.alias("reason"),
        F.array(F.lit("human_review")).alias("triggered_rules"), F.lit(None).cast("string").alias("sanitized_text"),
        F.lit(False).alias("has_review_flag"), F.lit(None).cast("string").alias("review_queue_id"),
        empty("array<string>").alias("categories"),
    )
    gate = F.when(~reviewed, "error").when(action.isin("block", "deny"), "blocked").otherwise("run")
    key = F.when(F.col("call_kind") == "sql", F.col("query")).otherwise(F.col("call_key"))
    return held.withColumns({"review_decision": F.when(reviewed, decision), "gate": gate, "call_key": key}).drop(review)


def _calls(admitted: DataFrame, kind: str) -> DataFrame:
    runnable = admitted.filter((F.col("gate") == "run") & (F.col("call_kind") == kind))
    return runnable.select("role", "call_key", "name", "email", "limit")


def _kinds(admitted: DataFrame) -> set[str]:
    """Kinds of calls that some admitted request makes: at most four."""
    return {r.call_kind for r in admitted.filter(F.col("gate") == "run").select("call_kind").distinct().collect()}


def _evenly(rows: DataFrame) -> DataFrame:
    """Rows of results dealt over tasks by their place: a large result may be stored in one file that
    no scan can split, and detection takes far longer than moving it."""
    return rows.repartition("call_key", "page", "position")


def _row_source(tables: Tables, context: Context) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Call kind -> function from calls to all rows of their results, without any cut."""

    def table(calls: DataFrame, name: str) -> DataFrame:
        return tables[name](calls.sparkSession)

    return {
        "lookup": lambda calls: lookup_rows(calls, table(calls, "customers"), table(calls, "accounts"), context.rules),
        "search": lambda calls: search_rows(calls, spread(table(calls, "customers")), context.rules),
    }


def _paged(sql_rows: DataFrame) -> DataFrame:
    """Rows of SQL results in the form of ``RESULT_ROWS``: a page is what one task has written."""
    return sql_rows.select("role", "call_key", F.shiftright("position", 33).cast("int").alias("page"), "position", "row_json", "error")


def execute(admitted: DataFrame, tables: Tables, context: Context = Context()) -> DataFrame:
    """Stage 4 for the distinct calls of admitted requests, with stage 5 on each result.

    A SQL text runs once: its rows are stored, and both the text and the verdict on all rows come
    from them. The texts are written before they are scanned: the scan expression would otherwise
    be planned once per query of the union. A kind that no admitted request calls costs nothing: many
    micro-batches run few kinds, or none.
    """
    most = context.max_output_chars
    kinds = _kinds(admitted)
    people, held = (lambda c: tables["customers"](c.sparkSession)), (lambda c: tables["accounts"](c.sparkSession))
    outputs, sql_rows = {}, nothing(admitted.sparkSession, ROWS_SCHEMA)
    if "sql" in kinds:
        sql = _calls(admitted, "sql")
        sql_rows = query_rows(sql, tables, context.rules, None if context.judge_whole else most // 4 + 2)
        outputs["sql"] = row_texts(sql, sql_rows, most)
    if "lookup" in kinds:
        lookups = _calls(admitted, "lookup")
        outputs["lookup"] = lookup_outputs(lookups, people(lookups), held(lookups), most, context.rules)
    if "search" in kinds:
        searches = _calls(admitted, "search")
        outputs["search"] = search_outputs(searches, spread(people(searches)), most, context.rules)
    united = nothing(admitted.sparkSession, f"call_kind string, {OUTPUT_SCHEMA}")
    for kind, texts in outputs.items():
        united = united.unionByName(texts.withColumn("call_kind", F.lit(kind)))
    written = durable(united, "outputs") if outputs else united
    spans = above_threshold(context.detector(F.col("output")), context.threshold)
    return _with_whole(written, admitted, sql_rows, tables, context).withColumn("outbound_detections", spans)


def page_verdicts(rows: DataFrame, context: Context = Context(), policies: Mapping[str, Column] | None = None) -> DataFrame:
    """Verdicts over the rows of results, per page: ``(role, call_kind, call_key, page, rows,
    detections, row_sum, error, whole)``. ``whole`` maps each policy to its first violation and
    the spans to review of the first row that has some. ``policies``: names to judge by, each
    with a condition for the rows it is for; all by default. ``row_sum`` adds up hashes of rows,
    so it does not depend on their order."""
    policies = {name: F.lit(True) for name in context.policies} if policies is None else policies
    spans = above_threshold(context.detector(F.col("row_json")), context.threshold)
    scanned = rows.withColumn("spans", spans)
    judged = {
        name: F.when(
            own, apply_policy(F.col("row_json"), F.col("spans"), F.lit(name), "outbound", F.sha2("call_key", 256), context.policies)
        )
        for name, own in policies.items()
    }
    scanned = scanned.withColumns({f"_p{i}": j for i, j in enumerate(judged.values())})

    def verdict(j: Column) -> Column:
        place = F.struct("page", "position")
        return F.struct(
            F.min(F.when(j["blocked"], F.struct(place.alias("at"), j["violation"].alias("violation")))).alias("violation"),
            F.min(F.when(j["has_review_flag"], F.struct(place.alias("at"), j["review"].alias("review")))).alias("review"),
        )

    each = [x for i, name in enumerate(judged) for x in (F.lit(name), verdict(F.col(f"_p{i}")))]
    row_hash = F.conv(F.substring(F.sha2("row_json", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return scanned.groupBy("role", "call_kind", "call_key", "page").agg(
        F.count("row_json").alias("rows"), F.sum(F.size("spans")).alias("detections"), F.sum(row_hash).alias("row_sum"),
        F.max("error").alias("error"), F.create_map(*each).alias("whole"),
    )


def call_verdicts(pages: DataFrame, names: Iterable[str]) -> DataFrame:
    """``page_verdicts`` rolled up to calls: ``(role, call_kind, call_key, totals, run_error, whole)``."""

    def first(name: str, part: str) -> Column:
        return F.min(F.col("whole")[name][part])[part]

    def verdict(name: str) -> Column:
        return F.struct(first(name, "violation").alias("violation"), first(name, "review").alias("review"))

    each = [x for name in names for x in (F.lit(name), verdict(name))]
    totals = F.struct(
        F.sum("rows").alias("rows"), F.sum("detections").cast("long").alias("detections"),
        F.sha2(F.sum("row_sum").cast("decimal(38,0)").cast("string"), 256).alias("rows_hash"),
    )
    return pages.groupBy("role", "call_kind", "call_key").agg(
        totals.alias("totals"), F.max("error").alias("run_error"), F.create_map(*each).alias("whole")
    )


def _with_whole(outputs: DataFrame, admitted: DataFrame, sql_rows: DataFrame, tables: Tables, context: Context) -> DataFrame:
    """Outputs with the verdict over all rows of those that were cut: ``whole`` by policy, and
    ``totals``. Null for the others, whose text is the whole result."""
    cut = outputs.filter(F.col("output").endswith(fixed.TRUNCATED)).select("call_kind", "role", "call_key")
    kinds = {r.call_kind for r in cut.select("call_kind").distinct().collect()} if context.judge_whole else set()
    if not kinds:
        schema = f"role string, call_kind string, call_key string, totals {TOTALS}, whole {_WHOLE}"
        verdicts = nothing(outputs.sparkSession, schema)
    else:
        rows = _paged(sql_rows).withColumn("call_kind", F.lit("sql"))
        for kind, source in _row_source(tables, context).items():
            if kind not in kinds:
                continue
            long = _calls(admitted, kind).join(cut.filter(F.col("call_kind") == kind).hint("merge"), ["role", "call_key"], "left_semi")
            rows = rows.unionByName(source(long).withColumn("call_kind", F.lit(kind)))
        judged = durable(_evenly(rows.join(cut, ["call_kind", "role", "call_key"], "left_semi")), "whole-rows")
        verdicts = call_verdicts(page_verdicts(judged, context), context.policies).drop("run_error")
    return outputs.join(verdicts.hint("merge"), ["role", "call_kind", "call_key"], "left")


def _judged(outputs: DataFrame, admitted: DataFrame, context: Context) -> DataFrame:
    """Stage 6 on each result under each policy its role runs with, without the ids of requests: ``sanitized``
    as from ``apply_once`` and ``decision``. Only roles with rules run, so the pairs are few."""
    running = admitted.filter(F.col("gate") == "run").select(F.col("role").alias("_of"), F.col("policy").alias("_policy")).distinct()
    shown = apply_once(F.col("output"), F.col("outbound_detections"), F.col("_policy"), "outbound", context.policies)
    # a block anywhere in the result blocks it and a span for review anywhere queues it, also
    # behind the cut
    def whole(s: Column, v: Column) -> Column:
        blocked = (
            s.withField("blocked", F.lit(True)).withField("violation", F.coalesce(s["violation"], v["violation"]))
            .withField("has_review_flag", F.lit(False)).withField("review_queue_id", F.lit(None).cast("string"))
            .withField("vault", empty(_VAULT)).withField("review", empty(SPAN_TYPE))
        )
        queued = s.withField("has_review_flag", F.lit(True)).withField("review", F.when(s["has_review_flag"], s["review"]).otherwise(v["review"]))
        return (
            F.when(v["violation"].isNotNull(), blocked)
            .when(v["review"].isNotNull() & ~s["blocked"], queued)
            .otherwise(s)
        )

    sanitized = bind(shown, lambda s: bind(F.try_element_at(F.col("whole"), F.col("_policy")), lambda v: whole(s, v)))
    # the text of the decision is that of the result
    decision = bind(pipeline_decision(F.col("_sanitized"), "outbound"), lambda d: d.withField("sanitized_text", F.lit(None).cast("string")))
    return (
        outputs.join(F.broadcast(running), F.col("role") == F.col("_of")).drop("_of")
        .withColumn("_sanitized", F.when(F.col("output").isNotNull(), sanitized)).withColumn("_decision", decision)
    )


def finish(admitted: DataFrame, outputs: DataFrame, context: Context = Context()) -> DataFrame:
    """Stages 6-7: outbound policy, status, decisions, response. A result is judged once for all
    requests that get it under one policy; a request adds its ids."""
    joined = admitted.join(
        _judged(outputs, admitted, context).withColumnRenamed("call_kind", "_kind")
        .withColumnRenamed("call_key", "_key")
        .withColumnRenamed("role", "_role"),
        (F.col("gate") == "run")
        & (F.col("call_kind") == F.col("_kind"))
        & F.col("call_key").eqNullSafe(F.col("_key"))
        & (F.col("role") == F.col("_role"))
        & F.col("policy").eqNullSafe(F.col("_policy")),
        "left",
    ).drop("_kind", "_key", "_role", "_policy")
    ran = F.col("output").isNotNull()
    outbound = for_request(F.col("_sanitized"), F.col("output"), "outbound", F.col("request_id"))
    own = {
        "sanitized_text": F.when(~F.col("outbound.blocked"), F.col("outbound.mutated_text")),
        "review_queue_id": F.col("outbound.review_queue_id"),
    }
    outbound_decision = F.col("_decision")
    for name, value in own.items():
        outbound_decision = outbound_decision.withField(name, value)
    denial = denial_text(F.col("role"), F.col("tool_name"), F.col("rbac_reason"))
    status = (
        F.when(F.col("gate") != "run", F.col("gate"))
        .when(~ran, "error")
        .when(F.col("outbound.blocked"), "blocked")
        .otherwise("success")
    )
    message = (
        F.when(F.col("gate") == "rbac_denied", denial)
        .when(F.col("gate") == "blocked", INBOUND_REFUSED)
        .when(F.col("gate") == "review_queued", REVIEW_NEEDED)
        .when(F.col("gate") == "error", REVIEW_ENDED)
        .when(~ran, F.coalesce(F.col("run_error"), F.concat(F.lit("ValueError: Unknown tool: "), F.col("tool_name"))))
    )
    denied_decision = F.struct(
        F.lit("deny").alias("action"),
        denial.alias("reason"),
        F.array(F.lit("rbac")).alias("triggered_rules"),
        error_json(denial).alias("sanitized_text"),
        F.lit(False).alias("has_review_flag"),
        F.lit(None).cast("string").alias("review_queue_id"),
        empty("array<string>").alias("categories"),
    )
    decisions = F.when(F.col("gate") == "rbac_denied", F.array(denied_decision)).otherwise(
        F.filter(F.array("inbound_decision", "review_decision", "outbound_decision"), lambda d: d.isNotNull())
    )
    return (
        joined.withColumnRenamed("error", "run_error")
        .withColumn("outbound_detections", F.coalesce("outbound_detections", empty(SPAN_TYPE)))
        .withColumn("outbound", F.when(ran, outbound))
        .withColumn("outbound_decision", F.when(ran, outbound_decision))
        .drop("_sanitized", "_decision")
        .withColumn("status", status)
        .withColumn("error", message)
        .withColumn("decisions", decisions)
        .withColumn("final_action", final_action(F.col("decisions")))
        .withColumn("response", _response())
    )


def violation_text(violation: Column) -> Column:
    return F.concat(
        F.lit("Policy violation: "), violation["category"], F.lit(" in "), violation["direction"],
        F.lit(" — "), violation["reason"],
    )


def _response() -> Column:
    """Text for the caller. A blocked request gets the violation, never the raw text."""
    last = F.element_at(F.col("decisions"), -1)["sanitized_text"]
    violation = F.coalesce(F.col("outbound.violation"), F.col("inbound.violation"))
    return (
        F.when(
            F.col("status") == "blocked",
            F.coalesce(error_json(violation_text(violation)), error_json(F.col("error"))),
        )
        .when(last.isNotNull() & (last != ""), last)
        .when(F.col("error").isNotNull(), error_json(F.col("error")))
        .otherwise(F.coalesce(last, F.lit("")))
    )


def run_requests(requests: DataFrame, tables: Tables, context: Context = Context()) -> DataFrame:
    """All stages over a request table: one row per request with decisions, status and
    response. The admitted requests are written once, as three steps read them."""
    admitted = durable(admit(requests, context), "admitted")
    return finish(admitted, execute(admitted, tables, context), context)


def audit_rows(log: DataFrame, timestamp: Column | None = None, latency_ms: Column | None = None) -> DataFrame:
    """The 17-field audit record: hashes, safe spans and masked texts, no raw text."""
    return log.select(*audit_columns(timestamp, latency_ms))


def audit_columns(timestamp: Column | None = None, latency_ms: Column | None = None) -> list[Column]:
    """The fields of ``audit_rows``."""
    ts = F.current_timestamp() if timestamp is None else timestamp
    latency = F.lit(0.0) if latency_ms is None else latency_ms
    last = F.element_at(F.col("decisions"), -1)["sanitized_text"]
    return [
        F.coalesce("request_id", hashing.uuid_from(F.col("scan_text"))).alias("request_id"),
        ts.alias("timestamp_utc"),
        hashing.actor(F.col("role"), F.col("user_id").cast("string"), F.col("request_id")).alias("actor"),
        F.col("tool_name"),
        F.sha2(F.coalesce("scan_text", F.lit("")), 256).alias("raw_query_hash"),
        safe_spans(F.col("inbound_detections")).alias("inbound_detections"),
        F.coalesce("inbound.decisions", empty("array<struct<category:string,action:string,reason:string>>")).alias(
            "policy_decisions_inbound"
        ),
        F.coalesce(F.get(F.col("decisions"), 0)["sanitized_text"], F.lit("")).alias("tool_input_after_policy"),
        F.sha2(F.coalesce("output", F.lit("")), 256).alias("tool_output_raw_hash"),
        safe_spans(F.col("outbound_detections")).alias("outbound_detections"),
        F.coalesce("outbound.decisions", empty("array<struct<category:string,action:string,reason:string>>")).alias(
            "policy_decisions_outbound"
        ),
        F.when(F.size("decisions") > 1, F.coalesce(last, F.lit(""))).otherwise("").alias("tool_output_final"),
        F.col("status"),
        latency.cast("double").alias("latency_ms"),
        F.coalesce("inbound.review_queue_id", "outbound.review_queue_id").alias("review_queue_id"),
        policy_version(F.col("policy")).alias("policy_version"),
        F.lit(fixed.MODEL_VERSION).alias("model_version"),
    ]


def for_sinks(log: DataFrame, timestamp: Column | None = None, latency_ms: Column | None = None, *others: str) -> DataFrame:
    """What the stored tables take from a result, without the texts that none of them holds: ``audit``, the
    finished record, the columns that ``review_entries``, ``vault_entries`` and ``audit_totals`` read, and ``others``."""

    def side(name: str) -> Column:
        fields = [F.col(name)[c].alias(c) for c in ("has_review_flag", "review_queue_id", "review", "original_text_hash", "vault")]
        return F.when(F.col(name).isNotNull(), F.struct(*fields)).alias(name)

    audit = F.struct(*audit_columns(timestamp, latency_ms)).alias("audit")
    return log.select("request_id", "ts", "role", "user_id", "tool_name", "gate", "status", "totals", side("inbound"), side("outbound"), audit, *others)


def audit_totals(log: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Beside the audit record of a request whose result text was cut: rows and spans of the whole
    result, and a hash over all rows that does not depend on their order."""
    ts = F.current_timestamp() if timestamp is None else timestamp
    return log.filter("totals is not null").select("request_id", ts.alias("timestamp_utc"), "status", "totals.*")


def log_entries(log: DataFrame, timestamp: Column | None = None, latency_ms: Column | None = None) -> DataFrame:
    """The entry returned to the caller next to the response."""
    ts = F.current_timestamp() if timestamp is None else timestamp
    latency = F.lit(0.0) if latency_ms is None else latency_ms
    return log.select(
        "request_id", ts.alias("timestamp"), "role", "tool_name", "decisions", "final_action",
        latency.cast("long").alias("duration_ms"), F.lit("spark").alias("backend"), "status", "error",
    )


def vault_entries(log: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Vaulted spans of both directions."""
    from veilframe.plans.corpus import vault_rows

    ts = F.current_timestamp() if timestamp is None else timestamp
    both = F.concat(
        F.coalesce("inbound.vault", empty(_VAULT)), F.coalesce("outbound.vault", empty(_VAULT))
    )
    rows = log.select("request_id", ts.alias("timestamp_utc"), F.struct(both.alias("vault")).alias("sanitized"))
    return vault_rows(rows, "request_id", "timestamp_utc").select(
        "vault_ref", "request_id", "timestamp_utc", "category", "original_text", "context_hash"
    )


_VAULT = "array<struct<vault_ref:string,category:string,original_text:string,context_hash:string>>"


def review_entries(log: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """One pending entry per direction with a REVIEW span."""
    from veilframe.functions.arrays import explode_rows

    ts = F.current_timestamp() if timestamp is None else timestamp

    def side(name: str) -> Column:
        s = F.col(name)
        return F.when(
            s["has_review_flag"],
            F.struct(
                s["review_queue_id"].alias("review_id"),
                F.lit(name).alias("direction"),
                s["review"].alias("detections"),
                s["original_text_hash"].alias("query_or_result_hash"),
            ),
        )

    rows = log.select(
        "request_id",
        ts.alias("timestamp_utc"),
        hashing.actor(F.col("role"), F.col("user_id").cast("string"), F.col("request_id")).alias("actor"),
        "tool_name",
        F.array(side("inbound"), side("outbound")).alias("_sides"),
    )
    return explode_rows(rows, F.col("_sides"), "_r").select(
        "_r.review_id", "request_id", "timestamp_utc", "actor", "tool_name", "_r.direction",
        "_r.detections", "_r.query_or_result_hash", F.lit("pending").alias("status"),
    )


def run_requests_by_row(requests: DataFrame, tables: Tables, context: Context = Context()) -> DataFrame:
    """The variant without threshold and output cut.

    The policy follows the role, REVIEW does not stop a request, outbound REVIEW queues
    it. A result has no size limit here: it is scanned row by row (of a lookup, the customer
    and each account; of a search, each hit), and verdicts are rolled up per page and per distinct
    call; ``tool_output_raw_hash`` is a digest over the row hashes that does not depend on their
    order. The masked rows are ``masked_rows``. A request that nothing can run ends in an error.
    """
    everything = replace(context, threshold=0.0)
    admitted = durable(
        admit(requests, everything, hashing.policy_for_role(F.col("role"))).withColumn(
            "gate", F.when(F.col("gate") == "review_queued", "run").otherwise(F.col("gate"))
        ),
        "admitted",
    )
    own = {
        name: hashing.policy_for_role(F.col("role")) == name for name in everything.policies
    }
    pages = page_verdicts(durable(_evenly(result_rows(admitted, tables, everything)), "result-rows"), everything, own)
    verdicts = call_verdicts(pages, everything.policies)
    joined = admitted.join(
        verdicts.withColumnsRenamed({"call_key": "_key", "role": "_role", "call_kind": "_kind"}).hint("merge"),
        (F.col("gate") == "run") & (F.col("call_kind") == F.col("_kind"))
        & F.col("call_key").eqNullSafe(F.col("_key")) & (F.col("role") == F.col("_role")),
        "left",
    ).drop("_key", "_role", "_kind")
    verdict = F.try_element_at(F.col("whole"), F.col("policy"))
    joined = joined.select(
        "*", verdict["violation"].isNotNull().alias("out_blocked"), verdict["review"].isNotNull().alias("out_review"),
        F.col("totals.rows").alias("out_rows"), F.col("totals.detections").alias("out_detections"), F.col("totals.rows_hash").alias("tool_output_raw_hash"),
    ).drop("totals", "whole")
    # a query without rows, or a search without hits, has no verdict
    ran = F.col("out_rows").isNotNull() | F.col("call_kind").isin("sql", "search")
    inbound_review = F.coalesce(F.col("inbound.has_review_flag"), F.lit(False))
    return joined.withColumn(
        "status",
        F.when(F.col("gate") != "run", F.col("gate"))
        .when(F.col("run_error").isNotNull() | ~ran, "error")
        .when(F.coalesce(F.col("out_blocked"), F.lit(False)), "blocked")
        .when(inbound_review | F.coalesce(F.col("out_review"), F.lit(False)), "review_queued")
        .otherwise("success"),
    ).withColumn(
        "review_queue_id",
        F.coalesce(
            F.col("inbound.review_queue_id"),
            F.when(F.col("status") == "review_queued", hashing.uuid_from(F.col("request_id"), F.lit("outbound"), F.lit("review"))),
        ),
    )


def result_rows(admitted: DataFrame, tables: Tables, context: Context = Context()) -> DataFrame:
    """``(call_kind, role, call_key, page, position, row_json, error)``: all rows of the results of
    the distinct admitted calls, whatever their number."""
    kinds = _kinds(admitted)
    sql = query_rows(_calls(admitted, "sql"), tables, context.rules) if "sql" in kinds else nothing(admitted.sparkSession, ROWS_SCHEMA)
    rows = _paged(sql).withColumn("call_kind", F.lit("sql"))
    for kind, source in _row_source(tables, context).items():
        if kind not in kinds:
            continue
        rows = rows.unionByName(source(_calls(admitted, kind)).withColumn("call_kind", F.lit(kind)))
    return rows


def masked_rows(admitted: DataFrame, tables: Tables, context: Context = Context()) -> DataFrame:
    """``result_rows``, each scanned and masked by the policy of its role."""
    return (
        durable(_evenly(result_rows(admitted, tables, context)), "result-rows")
        .withColumn("detections", above_threshold(context.detector(F.col("row_json")), context.threshold))
        .withColumn(
            "sanitized",
            apply_policy(
                F.col("row_json"), F.col("detections"), hashing.policy_for_role(F.col("role")), "outbound",
                F.sha2("call_key", 256), context.policies,
            ),
        )
    )
