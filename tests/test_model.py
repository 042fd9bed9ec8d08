"""A model as the detector of masking, gateway and streams."""

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_requests import frame, request
from veilframe.functions.spans import detect
from veilframe.operators import model
from veilframe.operators.tokens import BIOES_LABELS
from veilframe.plans import corpus, gateway


def random_model(folder=None):
    """Labels by the word, so that runs, breaks and orphans of all kinds come up."""
    def load():
        if folder:
            with open(f"{folder}/{os.getpid()}", "a") as log:
                log.write("x")

        def predict(texts):
            out = []
            for text in texts:
                at, row = 0, []
                for word in text.split(" "):
                    rng = random.Random(word)
                    place = None if word.startswith("n") else (0, 0) if word.startswith("z") else (at, at + len(word))
                    logits = [rng.choice([0.0, 1.0]) for _ in range(len(BIOES_LABELS) + 2)]
                    if word.startswith("e"):
                        logits[0] = 9.0
                    elif rng.random() < 0.9:
                        logits[1 + rng.randrange(8)] = 5.0
                    row.append((*(place or (None, None)), logits))
                    at += len(word) + 1
                out.append(row)
            return out

        return predict

    return load


def texts(spark, n=300):
    rng = random.Random(5)
    word = lambda: rng.choice("abenz") + str(rng.randrange(40))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(30)))) for i in range(n)] + [(n, None), (n + 1, "  "), (n + 2, "é🙂 a1 b2")]
    return spark.createDataFrame(rows, "doc long, text string").repartition(6)


def test_spans_in_the_plan_equal_the_table(spark, tmp_path):
    docs = texts(spark).cache()
    detector = model.model_detector(random_model(str(tmp_path)), batch=7)
    got = corpus.span_rows(docs.withColumn("s", detector(F.col("text"))), "doc", spans="s").collect()
    table = model.detect_with_model(docs, "doc", "text", random_model()).collect()
    inside = {}
    for r in sorted(table, key=lambda r: (r.doc, r.start)):
        last = inside.setdefault(r.doc, [])
        if r.end > r.start and (not last or r.start >= last[-1].end):
            last.append(r)
    expected = sorted((r.doc, r.category, r.start, r.end, round(r.confidence, 9)) for rs in inside.values() for r in rs)
    assert sorted((r.doc, r.category, r.start, r.end, round(r.confidence, 9)) for r in got) == expected and len(expected) > 100
    by_id = {r.doc: r.text for r in docs.collect()}
    assert all(by_id[r.doc][r.start:r.end] == r.text for r in got)
    docs.select(detector(F.col("text"))).collect()
    assert all(os.path.getsize(tmp_path / f) == 1 for f in os.listdir(tmp_path))  # one load a process


def test_masking_by_column_and_by_stored_spans(spark, tmp_path):
    docs = texts(spark)
    spans = model.detect_with_model(docs, "doc", "text", random_model()).filter(F.col("end") > F.col("start"))
    spans.write.parquet(str(tmp_path / "spans"))
    stored = model.stored_detections(docs, "doc", "text", spark.read.parquet(str(tmp_path / "spans")))
    one = {r.doc: r for r in corpus.mask_corpus(stored, "permissive_analyst").select("doc", "sanitized.mutated_text", "decision.action").collect()}
    two = {r.doc: r for r in corpus.redact_corpus(docs, "permissive_analyst", detector=model.model_detector(random_model())).select("doc", "sanitized.mutated_text", "decision.action").collect()}
    assert one == two and sum("[" in r.mutated_text for r in one.values()) > 50


def _emails():
    def predict(batch):
        out = []
        for text in batch:
            at, row = 0, []
            for word in text.split(" "):
                label = BIOES_LABELS.index("S-secret") if word == "hush" else 0
                row.append((at, at + len(word), [9.0 if i == label else 0.0 for i in range(len(BIOES_LABELS))]))
                at += len(word) + 1
            out.append(row)
        return out

    return predict


def test_gateway_with_a_model(spark, bank):
    context = gateway.Context(detector=model.model_detector(_emails))
    rows = [request(1, "analyst", "sql_query", "SELECT id FROM customers WHERE first_name = ' hush '"), request(2, "compliance_officer", "sql_query", "SELECT id, ' hush ' AS t FROM customers LIMIT 1", text="x")]
    rows += [request(3, "compliance_officer", "sql_query", "SELECT ssn FROM customers LIMIT 1"), request(4, "analyst", "customer_api_lookup", customer_id=1)]
    got = {r.request_id: r.status for r in gateway.run_requests(frame(spark, rows), bank, context).collect()}
    assert got == {"1": "blocked", "2": "blocked", "3": "success", "4": "success"}
    assert gateway.Context().detector is detect


def test_stream_with_a_model(spark, tmp_path):
    from veilframe.streaming.requests import run_to_table

    texts(spark, 40).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc long, text string").parquet(str(tmp_path / "in"))
    masked = corpus.redact_corpus(stream, "strict_financial", detector=model.model_detector(random_model())).select("doc", F.size("detections").alias("n"))
    assert run_to_table(masked, spark, str(tmp_path / "out"), str(tmp_path / "cp")).agg(F.sum("n")).first()[0] > 5


def test_tokens_leave_the_model_in_bounded_groups(monkeypatch):
    """Neither the texts of a group nor the rows of a batch grow with the Arrow batch they came in."""
    monkeypatch.setattr(model, "BATCH_CHARS", 100)
    monkeypatch.setattr(model, "BATCH_TOKENS", 7)
    texts = ["ab cd"] * 150 + ["x" * 500] + ["y " * 30] * 3
    groups = list(model._groups(texts))
    assert [i for a, b in groups for i in range(a, b)] == list(range(len(texts)))
    assert all(b - a <= model.BATCH and (b == a + 1 or sum(map(len, texts[a:b])) <= 100) for a, b in groups)
    results = [[(i, i + 1, [0.0, float(i)]) for i in range(n)] for n in (0, 20, 3)]
    batches = list(model._token_batches("doc", pa.array([5, 6, 7]), results))
    assert max(b.num_rows for b in batches) == 7
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["doc"], r["idx"]) for r in rows] == [(6, i) for i in range(20)] + [(7, i) for i in range(3)]
    assert all(r["logits"] == [0.0, float(r["idx"])] and r["t_end"] == r["t_start"] + 1 for r in rows)


def test_only_labelled_tokens_are_decoded():
    names = ("O", "S-secret", "GARBAGE")
    logits = [[5.0, 0.0, 0.0, 0.0]] * 3 + [[0.0, 2.0, 0.0, 0.0], [0.0, 0.0, 0.0, 9.0], [0.0, 0.0, 2.0, 0.0]]
    places, labels, probs = model._labels(logits, names)
    assert places == [3, 5] and labels == ["S-secret", "GARBAGE"] and len(probs) == 2
    assert model._labels([[1.0, 0.0]], names) == ([], [], [])
