"""Pieces of DuckDB SQL that state the same semantics a second time, for checking."""

from __future__ import annotations

from veilframe import fixed_values as fixed
from veilframe.catalog import fixtures

_NAMES = "|".join(h.replace(".", r"\.") for h in fixed.HONORIFICS) + "|" + "|".join(fixed.FIRST_NAMES)

# --- fixed values: the eight detectors for RE2, in tie-break order
RE2 = (
    ("private_email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("private_phone", r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
    ("account_number", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}(?:[-\s]?\d{4})?\b"),
    ("secret", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("private_url", r"https?://[^\s]+"),
    ("private_date", r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"),
    ("private_address", rf"(?i)\b\d{{1,5}}\s+(?:[A-Z][a-z]+\s+){{1,3}}(?:{'|'.join(fixed.STREET_TYPES)})\.?\b"),
    ("private_person", rf"\b(?:{_NAMES})\s+[A-Z][a-z]+\b"),
)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def matches(source: str, categories=None) -> str:
    """CTEs ``raw``, ``placed``: all matches of a relation ``(k, text)`` with offsets."""
    parts = [
        f"SELECT k, text, '{c}' AS category, {i} AS ord, regexp_extract_all(text, {text(p)}) AS m, "
        f"string_split_regex(text, {text(p)}) AS g FROM {source} WHERE regexp_matches(text, {text(p)})"
        for i, (c, p) in enumerate(RE2)
        if categories is None or c in categories
    ]
    return (
        "raw AS (" + " UNION ALL ".join(parts) + "), "
        "placed AS (SELECT k, text, category, ord, m[i] AS span_text, "
        "CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + "
        "coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n "
        "FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw) r)"
    )


def spans(source: str) -> str:
    """CTEs up to ``spans(k, text, category, s, e, span_text)``: overlaps resolved."""
    return (
        matches(source) + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, -n, ord) AS rn FROM placed), "
        "walk AS (SELECT k, rn, true AS keep, s + n AS last_end FROM ranked WHERE rn = 1 UNION ALL "
        "SELECT r.k, r.rn, r.s >= w.last_end, CASE WHEN r.s >= w.last_end THEN r.s + r.n ELSE w.last_end END "
        "FROM walk w JOIN ranked r ON r.k = w.k AND r.rn = w.rn + 1), "
        "spans AS (SELECT r.k, r.text, r.category, r.s, r.s + r.n AS e, r.span_text FROM ranked r "
        "JOIN walk w ON r.k = w.k AND r.rn = w.rn WHERE w.keep)"
    )


def documents_cte() -> str:
    return f"docs AS ({fixtures.DOCUMENTS}), src AS (SELECT doc_id AS k, text FROM docs)"


def rules_cte() -> str:
    rows = ", ".join(
        f"({text(name)}, {text(d)}, {text(c)}, {text(a)}, {text(r)})"
        for name, (_, per) in fixed.POLICIES.items()
        for d, c, a, r in per
    )
    return f"rules AS (SELECT * FROM (VALUES {rows}) AS v(policy, direction, category, action, reason))"


def uuid_of(expression: str) -> str:
    h = f"sha256({expression})"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || "
        f"substr({h},17,4) || '-' || substr({h},21,12))"
    )


def judged(direction: str, policy: str, request_id: str = "CAST(k AS VARCHAR)", source: str = "spans", rules: str = "rules") -> str:
    """CTEs ``judged`` (one row per span with action and replacement) and ``masked``
    (one row per text with spans). ``policy`` is an SQL expression over ``source``."""
    before = "substr(text, greatest(s - 3, 0) + 1, least(s, 3))"
    after = "substr(text, e + 1, 3)"
    guard = (
        f"(action0 = 'redact' AND category = 'private_phone' AND regexp_matches(substr(text, s + 1, e - s), '^[\\d.\\-]+$') "
        f"AND regexp_matches({before}, '[:\\[,\\s]\\s*$') "
        f"AND (regexp_matches({after}, '^[\\s\\]]*[,}}\\]]') OR regexp_matches({after}, '^\\s*$')))"
    )
    ref = uuid_of(f"concat_ws('|', {request_id}, '{direction}', CAST(s AS VARCHAR), CAST(e AS VARCHAR), category)")
    return (
        f"with_rule AS (SELECT x.*, r.action AS action0, r.reason AS reason0 FROM (SELECT *, {policy} AS policy FROM {source}) x "
        f"LEFT JOIN {rules} r ON r.policy = x.policy AND r.direction = '{direction}' AND r.category = x.category), "
        f"acted AS (SELECT * EXCLUDE (action0, reason0), CASE WHEN action0 IS NULL OR {guard} THEN 'allow' ELSE action0 END AS action, "
        f"CASE WHEN action0 IS NULL THEN 'No policy defined for ' || category || ' in {direction}' "
        f"WHEN {guard} THEN {text(fixed.PHONE_SUPPRESSED)} ELSE reason0 END AS reason, "
        f"CASE WHEN action0 = 'vault' THEN {ref} END AS vault_ref FROM with_rule), "
        "judged AS (SELECT *, CASE action WHEN 'redact' THEN '[' || category || ']' "
        "WHEN 'hash' THEN '[' || category || ':' || substr(sha256(span_text), 1, 8) || ']' "
        "WHEN 'vault' THEN '[' || category || ':vault-ref-' || vault_ref || ']' END AS replacement FROM acted), "
        "edits AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS prev FROM judged WHERE replacement IS NOT NULL), "
        "spliced AS (SELECT k, string_agg(substr(text, prev + 1, s - prev) || replacement, '' ORDER BY s) || "
        "substr(any_value(text), CAST(max(e) AS BIGINT) + 1) AS mutated FROM edits GROUP BY k), "
        "verdicts AS (SELECT k, count(*) AS n_spans, count(replacement) AS n_mutations, "
        "string_agg(DISTINCT CASE WHEN replacement IS NOT NULL THEN action END, ', ' ORDER BY CASE WHEN replacement IS NOT NULL THEN action END) AS kinds, "
        "string_agg(DISTINCT category, ',' ORDER BY category) AS categories, "
        "bool_or(action = 'block') AS blocked, bool_or(action = 'review') AND NOT bool_or(action = 'block') AS review, "
        "arg_max(category, s) FILTER (WHERE action = 'block') AS violation, "
        "arg_max(reason, s) FILTER (WHERE action = 'block') AS violation_reason FROM judged GROUP BY k)"
    )


def decision_action(v: str = "v") -> str:
    return (
        f"CASE WHEN coalesce({v}.blocked, false) THEN 'block' WHEN coalesce({v}.review, false) THEN 'human_review' "
        f"WHEN coalesce({v}.n_mutations, 0) > 0 THEN 'transform' ELSE 'allow' END"
    )


def decision_reason(direction: str, v: str = "v") -> str:
    return (
        f"CASE WHEN coalesce({v}.blocked, false) THEN 'Policy violation ({direction}): BLOCK policy triggered: ' || {v}.violation_reason "
        f"WHEN coalesce({v}.review, false) THEN 'Human review required for flagged PII categories' "
        f"WHEN coalesce({v}.n_mutations, 0) > 0 THEN 'Applied ' || CAST({v}.n_mutations AS VARCHAR) || ' mutations: ' || {v}.kinds "
        f"ELSE 'No PII policy actions triggered' END"
    )


def json_row(fields: dict[str, str]) -> str:
    """Canonical JSON of a row; ``fields``: column -> 's' text or 'n' number."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        value = f"'\"' || {name} || '\"'" if fields[name] == "s" else f"CAST({name} AS VARCHAR)"
        parts.append(f"'{', ' if i else '{'}\"{name}\": ' || coalesce({value}, 'null')")
    return "(" + " || ".join(parts) + " || '}')"


CUSTOMER_FIELDS = {
    "id": "n", "first_name": "s", "last_name": "s", "email": "s", "phone": "s",
    "address": "s", "ssn": "s", "date_of_birth": "s",
}
ACCOUNT_FIELDS = {
    "id": "n", "customer_id": "n", "account_number": "s", "account_type": "s", "balance": "n", "opened_date": "s",
}


def without(fields: dict[str, str], *names: str) -> dict[str, str]:
    return {k: v for k, v in fields.items() if k not in names}


def bank_cte() -> str:
    return ", ".join(f"{name} AS ({sql})" for name, (sql, _) in fixtures.BANK.items())


def requests_cte() -> str:
    return f"requests AS ({fixtures.REQUESTS})"


def truncated(expression: str) -> str:
    return (
        f"CASE WHEN length({expression}) > {fixed.MAX_OUTPUT_CHARS} THEN substr({expression}, 1, {fixed.MAX_OUTPUT_CHARS}) "
        f"|| chr(10) || '... [truncated]' ELSE {expression} END"
    )
