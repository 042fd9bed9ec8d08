"""PII detection as one native column expression.

``detect(text)`` gives ``array<struct<category,start,end,text,confidence>>``:
disjoint spans, ascending, half-open 0-based offsets in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe import fixed_values as fixed
from veilframe.functions.arrays import bind, empty, scan

SPAN_TYPE = "array<struct<category:string,start:int,end:int,text:string,confidence:double>>"
_HITS = "array<struct<rank:int,category:string,pattern:string,matches:array<string>>>"
_RANKED = "array<struct<start:int,neg_length:int,rank:int,end:int,category:string,text:string>>"

_PATTERN = dict(fixed.PATTERNS)
_RANK = {category: i for i, (category, _) in enumerate(fixed.PATTERNS)}
_GUARD = {"private_email": "@", "private_url": "://"}
_NUMERIC = ("private_phone", "account_number", "secret", "private_date", "private_address")


def _place(text: Column, hit: Column) -> Column:
    """Offsets of the matches of one detector: a running sum over the lengths of the
    gaps between matches and of the matches themselves."""
    gaps = F.split(text, hit["pattern"], F.lit(-1))
    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hit["matches"])),
        hit["matches"],
        lambda gap, found: F.struct(F.length(gap).alias("gap"), F.length(found).alias("size"), found.alias("text")),
    )

    def placed(cursor: Column, x: Column) -> Column:
        return F.array(F.struct(
            (cursor + x["gap"]).alias("start"),
            (-x["size"]).alias("neg_length"),
            hit["rank"].alias("rank"),
            (cursor + x["gap"] + x["size"]).alias("end"),
            hit["category"].alias("category"),
            x["text"].alias("text"),
        ))

    return bind(
        pairs,
        lambda p: scan(p, F.lit(0), lambda cursor, x: cursor + x["gap"] + x["size"], placed, _RANKED),
    )


def _hit(text: Column, category: str) -> Column:
    """Match texts of one detector. The guard is a cheap test that every text with a
    match passes, so most texts never reach the regex."""
    matches = F.regexp_extract_all(text, F.lit(_PATTERN[category]), F.lit(0))
    if category in _GUARD:
        matches = F.when(F.contains(text, F.lit(_GUARD[category])), matches).otherwise(empty("array<string>"))
    return F.struct(
        F.lit(_RANK[category]).alias("rank"),
        F.lit(category).alias("category"),
        F.lit(_PATTERN[category]).alias("pattern"),
        matches.alias("matches"),
    )


def _candidates(text: Column, categories: list[str]) -> Column:
    """Matches of several detectors with offsets, overlaps included."""
    numeric = [c for c in categories if c in _NUMERIC]
    rest = [_hit(text, c) for c in categories if c not in _NUMERIC]
    hits = []
    if numeric:
        hits.append(
            F.when(F.rlike(text, F.lit(fixed.DIGIT)), F.array(*[_hit(text, c) for c in numeric]))
            .otherwise(empty(_HITS))
        )
    if rest:
        hits.append(F.array(*rest))
    found = F.filter(F.concat(*hits), lambda h: F.size(h["matches"]) > 0)
    return F.flatten(F.transform(found, lambda h: _place(text, h)))


def detect_category(text: Column, category: str) -> Column:
    """All matches of one detector, before overlaps between detectors are resolved."""
    return bind(F.coalesce(text, F.lit("")), lambda t: F.transform(_candidates(t, [category]), _as_span))


def _as_span(c: Column) -> Column:
    return F.struct(
        c["category"].alias("category"),
        c["start"].alias("start"),
        c["end"].alias("end"),
        c["text"].alias("text"),
        F.lit(fixed.RULE_CONFIDENCE).alias("confidence"),
    )


def resolve_overlaps(candidates: Column) -> Column:
    """Order by (start, longest, detector order); keep a span iff it starts at or
    after the end of the last kept one."""

    def keep(ordered: Column) -> Column:
        return scan(
            ordered,
            F.lit(-1),
            lambda last_end, c: F.when(c["start"] >= last_end, c["end"]).otherwise(last_end),
            lambda last_end, c: F.when(c["start"] >= last_end, F.array(c)).otherwise(empty(_RANKED)),
            _RANKED,
        )

    return bind(
        F.array_sort(candidates),
        lambda ordered: F.when(F.size(ordered) > 1, keep(ordered)).otherwise(ordered),
    )


def detect(text: Column) -> Column:
    """Detect all eight categories in a text column. A null or blank text has no spans."""

    categories = [c for c, _ in fixed.PATTERNS]
    return bind(
        F.coalesce(text, F.lit("")),
        lambda t: F.transform(resolve_overlaps(_candidates(t, categories)), _as_span),
    )


def above_threshold(spans: Column, threshold: Column | float) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.filter(spans, lambda s: s["confidence"] >= limit)


def scan_summary(spans: Column) -> Column:
    """``struct<has_pii,confidence,detected_types,detections>`` of a span array."""
    return bind(
        spans,
        lambda s: F.struct(
            (F.size(s) > 0).alias("has_pii"),
            F.coalesce(F.array_max(F.transform(s, lambda d: d["confidence"])), F.lit(0.0)).alias("confidence"),
            F.array_sort(F.array_distinct(F.transform(s, lambda d: d["category"]))).alias("detected_types"),
            s.alias("detections"),
        ),
    )


def safe_spans(spans: Column) -> Column:
    """Spans for the audit trail: the text is replaced by ``[category]``."""
    return F.transform(
        spans, lambda s: s.withField("text", F.concat(F.lit("["), s["category"], F.lit("]")))
    )
