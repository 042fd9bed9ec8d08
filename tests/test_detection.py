import random

import pytest
from pyspark.sql import functions as F

from tests import brute
from veilframe import fixed_values as fixed
from veilframe.functions.spans import above_threshold, detect, detect_category, safe_spans, scan_summary
from veilframe.plans import corpus

TEXTS = [
    "Contact John Smith at john@example.com or 555-123-4567",
    "a@b.com1x@d.com",
    "(555) 123-4567, +1 555.123.4567",
    "é1234-5678-9012 x 1234 5678 9012²",
    "742 evergreen terrace St. x and 1 Main St.x, 2 oak ave.",
    "Dr. Alice Smith met Mr. Bob",
    "𝒳 Alice Smith 😀 555-123-4567   555 123 4567",
    "Alice\x1cSmith http://x.y/é z",
    "12 ſouth St",
    "a" * 3000 + "@b.co",
    "1-2-2020 3-4-99 2024/01/02",
    "555-123-4567 " * 300,
    "1234-5678-9012-3456 and 123-45-6789",
    "The weather is nice today",
    "",
    "   \n\t  ",
]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", detect(F.col("text")).alias("s")).collect()
    return {r.i: [(s.category, s.start, s.end, s.text) for s in r.s] for r in rows}


def test_equals_sequential_rule(spark):
    got = found(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        assert got[i] == brute.spans(text), text[:60]


def test_random_texts(spark):
    rng = random.Random(7)
    parts = [
        "555-123-4567", "1234-5678-9012", "123-45-6789", "a.b@c.org", "@", "http://q.z/1", "1/2/2024", "12 Oak Rd",
        "Alice", " Smith", "Mr.", " ", ".", "-", "é", "😀", "12", "x", "\n", "Ann", "St", "(", ")", "+1",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(600)]
    got = found(spark, texts)
    assert [got[i] for i in range(len(texts))] == [brute.spans(t) for t in texts]


@pytest.mark.parametrize(
    "text,category",
    [("alice@example.com", "private_email"), ("555-123-4567", "private_phone"), ("1234-5678-9012", "account_number")],
)
def test_single(spark, text, category):
    assert found(spark, [text])[0] == [(category, 0, len(text), text)]


def test_one_detector_keeps_overlaps(spark):
    df = spark.createDataFrame([("1234-5678-9012",)], "text string")
    one = df.select(detect_category(F.col("text"), "account_number").alias("s")).first().s
    assert [(s.start, s.end) for s in one] == [(0, 14)]


def test_null_text_has_no_spans(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(detect(F.col("text")).alias("s")).first().s == []


def test_threshold_and_summary(spark):
    df = spark.createDataFrame([("a@b.com 555-123-4567",), ("none",)], "text string")
    d = detect(F.col("text"))
    rows = df.select(
        above_threshold(d, 0.99).alias("none"), scan_summary(above_threshold(d, 0.7)).alias("s"), safe_spans(d).alias("safe")
    ).collect()
    assert rows[0].none == [] and rows[0].s.has_pii and rows[0].s.confidence == 0.95
    assert rows[0].s.detected_types == ["private_email", "private_phone"]
    assert [s.text for s in rows[0].safe] == ["[private_email]", "[private_phone]"]
    assert not rows[1].s.has_pii and rows[1].s.confidence == 0.0


def test_partitioning_does_not_matter(spark, sf):
    from veilframe.catalog import fixtures

    docs = fixtures.documents(spark, sf)
    counts = []
    for n in (1, 50):
        rows = corpus.span_rows(corpus.detect_corpus(docs.repartition(n)), "doc_id")
        counts.append(sorted((r.doc_id, r.start, r.category) for r in rows.collect()))
    assert counts[0] == counts[1] and counts[0]


def test_detector_is_pluggable(spark):
    df = spark.createDataFrame([("x",)], "text string")
    fake = lambda t: F.array(F.struct(F.lit("secret").alias("category"), F.lit(0).alias("start"), F.lit(1).alias("end"), t.alias("text"), F.lit(0.5).alias("confidence")))
    out = corpus.redact_corpus(df, "permissive_analyst", detector=fake, request_id=F.lit("r")).first()
    assert out.sanitized.mutations[0].action == "vault"


def test_closed_sets():
    assert len(fixed.CATEGORIES) == 8 and {c for c, _ in fixed.PATTERNS} == set(fixed.CATEGORIES)
    for _, rows in fixed.POLICIES.values():
        assert {(d, c) for d, c, _, _ in rows} == {(d, c) for d in fixed.DIRECTIONS for c in fixed.CATEGORIES}
