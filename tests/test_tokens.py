import random

from pyspark.sql import functions as F

from tests import brute
from veilframe.operators.model import detect_with_model
from veilframe.operators.tokens import BIOES_LABELS, decode_bioes, parse_label, score_tokens, split_words, with_span_text

SCHEMA = "doc long, idx long, label string, s int, e int, p double"


def decode(spark, rows):
    return decode_bioes(spark.createDataFrame(rows, SCHEMA), "doc", "idx", "label", "s", "e", "p")


def test_labels(spark):
    labels = ["O", "B-private_person", "S-secret", "B-unknown_category", "GARBAGE", "", "X-secret", "O-secret", "E-private_person-x"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = [tuple(r.p) for r in df.select(parse_label(F.col("label")).alias("p")).collect()]
    assert got[:4] == [("O", None), ("B", "private_person"), ("S", "secret"), ("O", None)]
    assert got[4:7] == [("O", None)] * 3 and got[8] == ("O", None)


def test_multi_token_span(spark):
    text = "My name is Alice Marie Smith okay"
    words, at, rows = text.split(" "), 0, []
    labels = {3: ("B-private_person", 0.95), 4: ("I-private_person", 0.93), 5: ("E-private_person", 0.96)}
    for i, w in enumerate(words):
        label, p = labels.get(i, ("O", 0.9))
        rows.append((1, i, label, at, at + len(w), p))
        at += len(w) + 1
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    r = with_span_text(decode(spark, rows), docs, "doc", "text").first()
    assert (r.category, r.start, r.end, r.span_text) == ("private_person", 11, 28, "Alice Marie Smith")
    assert abs(r.confidence - (0.95 + 0.93 + 0.96) / 3) < 1e-12


def test_random_sequences(spark):
    rng = random.Random(3)
    rows, expected = [], []
    for doc in range(300):
        tokens = []
        for i in range(12):
            label = rng.choice(["O", "B-secret", "I-secret", "E-secret", "S-secret", "B-private_url", "E-private_url", "I-private_url", "junk", "O-secret"])
            offsets = rng.choice([None, (0, 0)] + [(i * 5 + 1, i * 5 + 4)] * 6)
            p = rng.randint(1, 99) / 100
            rows.append((doc, i, label, offsets and offsets[0], offsets and offsets[1], p))
            known = "-" in label and label != "junk"
            tokens.append((label[0] if known else "O", label[2:] if known else None, offsets, p))
        expected += [(doc, c, s, e, round(p, 9)) for c, s, e, p in brute.bioes(tokens)]
    got = [(r.doc, r.category, r.start, r.end, round(r.confidence, 9)) for r in decode(spark, rows).collect()]
    assert sorted(got) == sorted(expected)


def test_scores(spark):
    df = spark.createDataFrame([([0.0, 2.0, 1.0],), ([5.0],)], "l array<double>")
    rows = score_tokens(df, "l", ("O", "S-secret")).collect()
    assert rows[0].label == "S-secret" and abs(rows[0].prob - 0.6652409557748219) < 1e-9
    assert rows[1].label == "O" and rows[1].prob == 1.0


def test_split_words(spark):
    df = spark.createDataFrame([(1, "aé  b " + "x " * 200)], "doc long, text string")
    rows = sorted(split_words(df, "doc", "text").collect(), key=lambda r: r.idx)
    assert all(r.text[r.t_start:r.t_end] == r.word for r in rows) and len(rows) == 204


def test_model_detector(spark):
    def load():
        def predict(texts):
            out = []
            for text in texts:
                tokens, at = [], 0
                for word in text.split(" "):
                    label = "S-private_email" if "@" in word else "O"
                    tokens.append((at, at + len(word), [4.0 if x == label else 0.0 for x in BIOES_LABELS]))
                    at += len(word) + 1
                out.append(tokens)
            return out

        return predict

    df = spark.createDataFrame([(1, "mail a@b.com now"), (2, " "), (3, "none")], "doc long, text string")
    rows = detect_with_model(df, "doc", "text", load).collect()
    assert [(r.doc, r.category, r.start, r.end) for r in rows] == [(1, "private_email", 5, 12)]


def test_texts_are_neither_folded_nor_copied(spark):
    """Words come without a fold over the text, and a text is joined to its spans as one row."""
    docs = spark.createDataFrame([(1, "ab cd ef")], "doc long, text string")
    plan = split_words(docs, "doc", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
    spans = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 6, 8), (1, 5, 3)], "doc long, start int, end int")
    out = with_span_text(spans, docs, "doc", "text")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
    assert sorted(map(tuple, out.collect())) == [(1, 0, 2, "ab"), (1, 3, 5, "cd"), (1, 5, 3, ""), (1, 6, 8, "ef")]
