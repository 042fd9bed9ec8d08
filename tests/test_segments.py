import random

from pyspark.sql import functions as F

from veilframe.operators.segments import detect_long, seams, segments
from veilframe.plans import corpus

PARTS = [
    "a.b@c-d.org", "+1 (555) 123-4567", "1234-5678-9012", "123-45-6789", "https://x.example/a?b", "03/15/2024", "742 maple grove hill Ln",
    "12 oak Ave.", "Alice  Smith", "Mr. Brown", "Dr.\nLane", "7 one two three four St", "555", "1234 5678", "Alice", "St", "ß", "é🙂", "\n\n", "  ", "x@y", "https", "::",
]


def text(rng, n):
    lower = lambda: "".join(rng.choice("abcdeß") for _ in range(rng.randint(1, 6)))
    return " ".join(rng.choice(PARTS) if rng.random() < 0.25 else lower() for _ in range(n))


def test_spans_equal_those_of_the_whole_text(spark):
    rng = random.Random(11)
    rows = [(i, text(rng, rng.randrange(400))) for i in range(150)] + [(200, None), (201, ""), (202, "12 " * 500), (203, text(rng, 30_000))]
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("seq", F.lit("x")).withColumn("at", F.lit("y"))
    expected = corpus.span_rows(corpus.detect_corpus(df), "doc").collect()
    for most in (1, 60, 1000):
        got = detect_long(df, "doc", most=most).collect()
        key = lambda r: (r.doc, r.start)
        assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(expected, key=key)]
    assert len(expected) > 3000


def test_segments_make_up_the_text(spark):
    rng = random.Random(12)
    rows = [(i, text(rng, 2000)) for i in range(5)] + [(9, "x" * 5000), (10, None)]
    parts = segments(spark.createDataFrame(rows, "doc long, text string"), "doc", most=500).collect()
    for doc, whole in rows:
        own = sorted((r.seq, r.at, r.segment) for r in parts if r.doc == doc)
        assert [at for _, at, _ in own] == [sum(len(s or "") for *_, s in own[:k]) for k in range(len(own))]
        assert "".join(s for *_, s in own if s is not None) == (whole or "") and len(own) > (10 if doc < 5 else 0)
    assert seams("one two three four five six seven", 5) == [0, 27, 33] and seams("short", 50) == [0, 5]
