"""Policy application to detected spans as column expressions.

``apply_policy`` turns a text and its spans into one struct: mutated text, mutations
and decisions (descending by start), review flag, violation, vault and review content.
Spans must be disjoint; offsets beyond the text are clamped to its length.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.functions.arrays import CHUNK, bind, chunk_starts, empty
from veilframe.functions.hashing import literal_map, sha256_short, uuid_from
from veilframe.functions.spans import SPAN_TYPE

_MUTATING = ("redact", "hash", "vault")
MUTATION_TYPE = "array<struct<start:int,end:int,category:string,action:string,replacement:string,vault_ref:string>>"
DECISION_TYPE = "array<struct<category:string,action:string,reason:string>>"
VAULT_TYPE = "array<struct<vault_ref:string,category:string,original_text:string,context_hash:string>>"


@dataclass(frozen=True)
class Policy:
    """direction -> category -> (action, reason), with a version for the audit trail."""

    name: str
    version: str
    rules: Mapping[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    @staticmethod
    def uniform(name: str, version: str, action: str, reason: str) -> "Policy":
        """The same action for every category in both directions."""
        return Policy(
            name, version, {(d, c): (action, reason) for d in fixed.DIRECTIONS for c in fixed.CATEGORIES}
        )


BUNDLED = {
    name: Policy(name, version, {(d, c): (action, reason) for d, c, action, reason in rows})
    for name, (version, rows) in fixed.POLICIES.items()
}


def get_policy(name: str) -> Policy:
    if name not in BUNDLED:
        raise ValueError(f"Unknown policy: {name}. Available: {list(BUNDLED)}")
    return BUNDLED[name]


def policy_version(policy: Column, policies: Mapping[str, Policy] = BUNDLED) -> Column:
    return F.try_element_at(literal_map({p.name: p.version for p in policies.values()}), policy)


def policy_rule(
    policy: Column, direction: str, category: Column, policies: Mapping[str, Policy] = BUNDLED
) -> Column:
    """``struct<action,reason>`` of a category, null where the policy has no rule."""
    rules = {
        f"{p.name}|{rule_category}": {"action": action, "reason": reason}
        for p in policies.values()
        for (d, rule_category), (action, reason) in p.rules.items()
        if d == direction
    }
    if not rules:
        return F.lit(None).cast("struct<action:string,reason:string>")
    return F.try_element_at(literal_map(rules), F.concat(policy, F.lit("|"), category))


def numeric_json_value(text: Column, start: Column, end: Column) -> Column:
    """True where a span is a bare number in a JSON value position."""
    before = F.substr(text, F.greatest(start - 3, F.lit(0)) + 1, F.least(start, F.lit(3)))
    after = F.substr(text, end + 1, F.lit(3))
    space = fixed.WHITESPACE
    return (
        F.rlike(F.substr(text, start + 1, end - start), F.lit(rf"^[{fixed.DIGIT}.\-]+$"))
        & F.rlike(before, F.lit(rf"(?:{space}|[:\[,]){space}*$"))
        & F.rlike(after, F.lit(rf"^(?:{space}|\])*(?:[,}}\]]|\z)"))
    )


def _judge(
    text: Column, spans: Column, policy: Column, direction: str, reference: Callable[[Column], Column],
    policies: Mapping[str, Policy], hash_length: int, salt: str,
) -> Column:
    """Spans with the action, reason and replacement of the policy. ``reference`` gives the vault's
    reference of a span."""

    def decided(s: Column) -> Column:
        rule = policy_rule(policy, direction, s["category"], policies)
        suppressed = (
            (rule["action"] == "redact")
            & (s["category"] == "private_phone")
            & numeric_json_value(text, s["start"], s["end"])
        )
        missing = F.concat(F.lit("No policy defined for "), s["category"], F.lit(f" in {direction}"))
        return F.struct(
            s["category"].alias("category"),
            s["start"].alias("start"),
            F.least(s["end"], F.length(text)).alias("end"),
            s["text"].alias("text"),
            s["confidence"].alias("confidence"),
            F.when(rule.isNull() | suppressed, "allow").otherwise(rule["action"]).alias("action"),
            F.when(rule.isNull(), missing)
            .when(suppressed, fixed.PHONE_SUPPRESSED)
            .otherwise(rule["reason"]).alias("reason"),
            F.when(rule["action"] == "vault", reference(s)).alias("vault_ref"),
        )

    def replaced(s: Column) -> Column:
        body = (
            F.when(s["action"] == "hash", F.concat(F.lit(":"), sha256_short(s["text"], hash_length, salt)))
            .when(s["action"] == "vault", _vault_body(s["vault_ref"]))
            .otherwise("")
        )
        token = F.concat(F.lit("["), s["category"], body, F.lit("]"))
        return s.withField("replacement", F.when(s["action"].isin(*_MUTATING), token))

    return F.transform(F.transform(spans, decided), replaced)


def _vault_body(reference: Column) -> Column:
    return F.concat(F.lit(":vault-ref-"), reference)


def splice(text: Column, edits: Column) -> Column:
    """Replace disjoint ascending spans. Each chunk of spans works on its own block of
    the text, so a long text with many spans is not rescanned from its head per span."""

    def block_text(first: Column) -> Column:
        part = F.slice(edits, first, F.lit(CHUNK))
        low = F.coalesce(F.get(edits, first - 2)["end"], F.lit(0))

        def pieces(b: Column) -> Column:
            return F.array_join(
                F.transform(
                    b["part"],
                    lambda e, i: F.concat(
                        bind(
                            F.coalesce(F.get(b["part"], i - 1)["end"], b["low"]),
                            lambda previous: F.substr(b["block"], previous - b["low"] + 1, e["start"] - previous),
                        ),
                        e["replacement"],
                    ),
                ),
                "",
            )

        high = F.element_at(part, -1)["end"]
        return bind(
            F.struct(part.alias("part"), low.alias("low"), F.substr(text, low + 1, high - low).alias("block")),
            pieces,
        )

    spliced = F.concat(
        F.array_join(F.transform(chunk_starts(edits), block_text), ""),
        F.substr(text, F.element_at(edits, -1)["end"] + 1, F.length(text)),
    )
    return F.when(F.size(edits) > 0, spliced).otherwise(text)


def apply_policy(
    text: Column,
    spans: Column,
    policy: Column | str,
    direction: str,
    request_id: Column | None = None,
    policies: Mapping[str, Policy] = BUNDLED,
    hash_length: int = 8,
    salt: str = "",
) -> Column:
    """Apply a policy to the spans of a text.

    ``policy`` is a policy name or a column of names, so one job can serve rows under
    different policies. A BLOCK anywhere refuses the whole text: the rightmost blocked
    span names the violation and no vault or review content is produced.
    """
    if direction not in fixed.DIRECTIONS:
        raise ValueError(f"Unknown direction: {direction}")
    if isinstance(policy, str):
        if policy not in policies:
            raise ValueError(f"Unknown policy: {policy}. Available: {list(policies)}")
        policy = F.lit(policy)
    request_id = F.lit("") if request_id is None else request_id
    reference = lambda s: uuid_from(request_id, F.lit(direction), _place(s))
    queue_id = uuid_from(request_id, F.lit(direction), F.lit("review"))
    return _sanitized(text, spans, policy, direction, reference, queue_id, policies, hash_length, salt)


def _place(span: Column) -> Column:
    """What tells a span from the others of a text."""
    return F.concat_ws("|", span["start"].cast("string"), span["end"].cast("string"), span["category"])


def apply_once(
    text: Column, spans: Column, policy: Column, direction: str, policies: Mapping[str, Policy] = BUNDLED
) -> Column:
    """``apply_policy`` for a text that several requests get: all but the ids, which ``for_request`` fills in."""
    return _sanitized(text, spans, policy, direction, _place, F.lit(""), policies, 8, "")


def for_request(sanitized: Column, text: Column, direction: str, request_id: Column) -> Column:
    """The result of ``apply_once`` with the ids of one request, as ``apply_policy`` has them. Only a text
    with spans for the vault is put together again, as their references stand in it."""

    def reference(place: Column) -> Column:
        return uuid_from(request_id, F.lit(direction), place)

    def named(m: Column) -> Column:
        def token(r: Column) -> Column:
            return F.concat(F.lit("["), m["category"], _vault_body(r), F.lit("]"))

        own = bind(reference(m["vault_ref"]), lambda r: m.withField("vault_ref", r).withField("replacement", token(r)))
        return F.when(m["action"] == "vault", own).otherwise(m)

    def refer(s: Column, queue_id: Column) -> Column:
        return bind(
            F.transform(s["mutations"], named),
            lambda edits: s.withField("mutations", edits)
            .withField("mutated_text", splice(F.coalesce(text, F.lit("")), F.reverse(edits)))
            .withField("vault", F.transform(s["vault"], lambda v: v.withField("vault_ref", reference(v["vault_ref"]))))
            .withField("review_queue_id", queue_id),
        )

    # a field set on an expression would have it evaluated once for each of the others
    def filled(s: Column) -> Column:
        queue_id = F.when(s["has_review_flag"], reference(F.lit("review")))
        vaulted = F.exists(s["mutations"], lambda m: m["action"] == "vault")
        return F.when(vaulted, refer(s, queue_id)).otherwise(s.withField("review_queue_id", queue_id))

    return bind(sanitized, filled)


def _sanitized(
    text: Column, spans: Column, policy: Column, direction: str, reference: Callable[[Column], Column], queue_id: Column,
    policies: Mapping[str, Policy], hash_length: int, salt: str,
) -> Column:
    def assemble(j: Column) -> Column:
        t, judged = j["text"], j["judged"]
        blocked = F.exists(judged, lambda s: s["action"] == "block")
        edits = F.filter(judged, lambda s: s["replacement"].isNotNull())
        reviewed = F.filter(judged, lambda s: s["action"] == "review")
        violation = F.element_at(F.filter(judged, lambda s: s["action"] == "block"), -1)
        review = (F.size(reviewed) > 0) & ~blocked
        return F.struct(
            F.sha2(t, 256).alias("original_text_hash"),
            splice(t, edits).alias("mutated_text"),
            F.transform(
                F.reverse(edits),
                lambda s: F.struct(
                    *[s[c].alias(c) for c in ("start", "end", "category", "action", "replacement", "vault_ref")]
                ),
            ).alias("mutations"),
            F.transform(
                F.reverse(judged),
                lambda s: F.struct(*[s[c].alias(c) for c in ("category", "action", "reason")]),
            ).alias("decisions"),
            review.alias("has_review_flag"),
            F.when(review, queue_id).alias("review_queue_id"),
            blocked.alias("blocked"),
            F.when(
                blocked,
                F.struct(
                    violation["category"].alias("category"),
                    F.lit(direction).alias("direction"),
                    F.concat(F.lit("BLOCK policy triggered: "), violation["reason"]).alias("reason"),
                ),
            ).alias("violation"),
            F.when(
                ~blocked,
                F.transform(
                    F.filter(judged, lambda s: s["action"] == "vault"),
                    lambda s: F.struct(
                        s["vault_ref"].alias("vault_ref"),
                        s["category"].alias("category"),
                        s["text"].alias("original_text"),
                        context_hash(t, s["start"], s["end"]).alias("context_hash"),
                    ),
                ),
            ).otherwise(empty(VAULT_TYPE)).alias("vault"),
            F.when(
                review,
                F.transform(
                    reviewed,
                    lambda s: F.struct(*[s[c].alias(c) for c in ("category", "start", "end", "text", "confidence")]),
                ),
            ).otherwise(empty(SPAN_TYPE)).alias("review"),
        )

    ordered = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    return bind(
        F.coalesce(text, F.lit("")),
        lambda t: bind(
            F.struct(
                t.alias("text"),
                _judge(t, ordered, policy, direction, reference, policies, hash_length, salt).alias("judged"),
            ),
            assemble,
        ),
    )


def context_hash(text: Column, start: Column, end: Column) -> Column:
    """SHA-256 of the span with fifty characters on either side."""
    low = F.greatest(start - 50, F.lit(0))
    return F.sha2(F.substr(text, low + 1, end + 50 - low), 256)


def pipeline_decision(sanitized: Column, direction: str) -> Column:
    """Text-level decision over the span-level ones of ``apply_policy``."""

    def decide(s: Column) -> Column:
        kinds = F.array_sort(F.array_distinct(F.transform(s["mutations"], lambda m: m["action"])))
        n = F.size(s["mutations"])
        action = (
            F.when(s["blocked"], "block")
            .when(s["has_review_flag"], "human_review")
            .when(n > 0, "transform")
            .otherwise("allow")
        )
        reason = (
            F.when(s["blocked"], F.concat(F.lit(f"Policy violation ({direction}): "), s["violation"]["reason"]))
            .when(s["has_review_flag"], "Human review required for flagged PII categories")
            .when(n > 0, F.concat(F.lit("Applied "), n.cast("string"), F.lit(" mutations: "), F.array_join(kinds, ", ")))
            .otherwise("No PII policy actions triggered")
        )
        return F.struct(
            action.alias("action"),
            reason.alias("reason"),
            F.when(s["blocked"], F.array(s["violation"]["category"])).otherwise(kinds).alias("triggered_rules"),
            F.when(~s["blocked"], s["mutated_text"]).alias("sanitized_text"),
            s["has_review_flag"].alias("has_review_flag"),
            s["review_queue_id"].alias("review_queue_id"),
            F.when(s["blocked"], empty("array<string>")).otherwise(
                F.array_sort(F.array_distinct(F.transform(s["decisions"], lambda d: d["category"])))
            ).alias("categories"),
        )

    return bind(sanitized, decide)


def final_action(decisions: Column) -> Column:
    """First block or deny wins, else human_review, else allow; never transform."""
    refused = F.filter(decisions, lambda d: d["action"].isin("block", "deny"))
    return F.coalesce(
        F.get(refused, 0)["action"],
        F.when(F.exists(decisions, lambda d: d["action"] == "human_review"), F.lit("human_review")),
        F.lit("allow"),
    )
