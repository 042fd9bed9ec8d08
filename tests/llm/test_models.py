import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import crc_mod, frame, rows

LABELS = "doc_id long, quality int, toxic int"


def _joined(spark, sf, scored, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    return scored.join(labels, "doc_id").toPandas()


def test_toxicity_held_out(spark):
    from veilframe.llm.toxicity import score_toxicity

    sf = "/root/testdata/sf0.01"
    got = _joined(spark, sf, score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")), "toxic")
    held = got[got.held_out]
    assert [crc_mod(i, 3) == 1 for i in got.doc_id] == got.held_out.tolist()
    hit = held.predicted == 1
    assert (held.toxic[hit] == 1).mean() >= 0.95 and hit[held.toxic == 1].mean() >= 0.6
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()


def test_quality_held_out(spark):
    from veilframe.llm.quality import score_quality

    sf = "/root/testdata/sf0.01"
    got = _joined(spark, sf, score_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")), "quality")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95
    assert held.predicted[held.quality == 1].mean() >= 0.98


def _awkward_labels(spark):
    data = [(i, int(i % 3 == 0), int(i % 2)) for i in range(0, 60, 2)] + [(2, None, None), (4, 1, 1), (4, 1, 1), (None, 1, 1), (10**6, 0, 0)]
    return spark.createDataFrame(data, LABELS).withColumn("text", F.lit("x")).withColumn("id", F.lit("y"))


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_scores_of_awkward_rows(spark, name):
    from veilframe.llm import quality, toxicity

    score = quality.score_quality if name == "quality" else toxicity.score_toxicity
    got = score(frame(spark), _awkward_labels(spark)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == sorted(-1 if i is None else i for i, _ in rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (crc_mod(r.doc_id, 3) == 1) for r in got)
    assert score(frame(spark, []), _awkward_labels(spark)).collect() == []
    assert {r.score for r in score(frame(spark), _awkward_labels(spark).limit(0)).collect()} == {0.5}


def test_factorization_machine_learns_a_pair():
    """Two terms that are harmless alone count together, which no additive weights can tell."""
    from veilframe.llm.toxicity import FactorizationMachine

    rng = np.random.default_rng(3)
    keys, offsets, y = [], [0], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        own = [k for k, here in ((1, a), (2, b), (3, not a), (4, not b)) if here]
        keys += own
        offsets.append(len(keys))
        y.append(float(a == b))
    model = FactorizationMachine(np.arange(8), 16)
    model.fit(np.array(keys), np.array(offsets), np.array(y), rate=0.1, decay=0)
    assert ((model.score(np.array(keys), np.array(offsets)) > 0.5) == np.array(y)).mean() > 0.95
    at, doc = model.rows(np.array([1, 2, 3]), np.array([0, 3, 3]))
    plain = model.bias + model.weight[[1, 2, 3]].sum() + sum(model.factor[i] @ model.factor[j] for i, j in ((1, 2), (1, 3), (2, 3)))
    assert model.raw(at, doc, 2)[0] == pytest.approx([plain, model.bias])


def test_network_sees_every_byte_once():
    """Scores equal a plain convolution over the whole text, across chunk borders."""
    from veilframe.llm.quality import FILTERS, WIDTH, ByteNetwork, chunked
    from veilframe.llm.text import Texts

    rng = random.Random(5)
    network = ByteNetwork()
    texts = ["", "a", "é" * 3, *("".join(rng.choice("abc %é\n") for _ in range(n)) for n in (5, 250, 251, 255, 256, 257, 600, 5000))]
    data, first = chunked(Texts(pa.array(texts)))
    most, _ = network.pooled(data, first)
    peaks = np.maximum.reduceat(most, first[:-1], axis=0)
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        # zeros to the end of the last chunk, as the network pads
        size = (first[k + 1] - first[k]) * 256
        padded = np.concatenate([raw, np.zeros(size - len(raw), np.uint8)])
        own = max_over = np.full(FILTERS, -np.inf)
        for i in range(size - WIDTH + 1):
            own = np.maximum(max_over, sum(network.table[j, padded[i + j]] for j in range(WIDTH)))
            max_over = own
        assert np.allclose(peaks[k], np.maximum(own + network.shift, 0), atol=1e-4)


def _align(item, text):
    best = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            best[i][j] = max(0, best[i - 1][j - 1] + (2 if item[i - 1] == text[j - 1] else -1), best[i - 1][j] - 1, best[i][j - 1] - 1)
    return max(map(max, best))


def test_alignment_equals_the_plain_table():
    from veilframe.llm.decontamination import align

    rng = random.Random(8)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randint(0, 12))]
        text = [rng.randrange(6) for _ in range(rng.randint(0, 25))]
        score, first, last = align(np.array(item, np.int64), np.array(text, np.int64))
        assert score == _align(item, text)
        if score:
            assert score == _align(item, text[first:last + 1])


@pytest.mark.parametrize("item_bytes", [1 << 20, 300])
def test_benchmark_matches(spark, monkeypatch, item_bytes):
    from veilframe.llm import decontamination

    monkeypatch.setattr(decontamination, "ITEM_BYTES", item_bytes)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (12, 30, 50, 40)]

    def edited(k, share):
        out = []
        for w in items[k]:
            p = rng.random()
            out += [word()] if p < share / 2 else [] if p < share * 0.75 else [w, word()] if p < share else [w]
        return " ".join(out)

    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [(k, f"{noise(20)} {' '.join(items[k % 4]).upper()}, {noise(9)}") for k in range(8)]
    docs += [(100 + k, f"{noise(5)}. {edited(k % 3 + 1, 0.2)}! {noise(15)}") for k in range(12)]
    docs += [(200 + k, f"{noise(30)} {' '.join(items[k % 4][:4])} {noise(30)}") for k in range(8)]
    docs += [(300, f"{' '.join(items[1])} {noise(3)} {' '.join(items[2])}"), (301, None), (302, ""), (303, noise(3000)), (None, " ".join(items[3])), (304, "ab"), (305, " ".join(items[3])), (305, " ".join(items[3]))]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(7, None), (8, ""), (9, "ab"), (None, " ".join(items[0]))], "item_id long, text string").withColumn("n", F.lit(1))
    got = decontamination.benchmark_matches(frame(spark, docs), bench).collect()
    pairs = sorted(((-1 if r.doc_id is None else r.doc_id), -1 if r.item_id is None else r.item_id) for r in got)
    expected = [(k, k % 4) for k in range(8)] + [(100 + k, k % 3 + 1) for k in range(12)] + [(300, 1), (300, 2), (-1, 3), (305, 3)]
    expected += [(k, -1) for k in (0, 4)]
    assert pairs == sorted(expected)
    exact = [r for r in got if r.doc_id is not None and r.doc_id < 8]
    assert all(r.score == 1 and (r.first_word, r.last_word) == (20, 19 + len(items[r.doc_id % 4])) for r in exact)
    assert decontamination.benchmark_matches(frame(spark, []), bench).collect() == []
    assert decontamination.benchmark_matches(frame(spark, docs), bench.limit(0)).collect() == []


@pytest.mark.parametrize("copies", [17, 1000])
def test_many_copies_of_an_edited_item(spark, copies):
    from veilframe.llm.decontamination import benchmark_matches

    rng = random.Random(5)
    item = [f"w{k}" for k in range(30)]
    edited = list(item)
    for k in (2, 5, 8, 11, 14, 17, 20):  # six 3-grams in a row are left at the end, and none before
        edited[k] = f"x{k}"
    assert sum(edited[k:k + 3] == item[k:k + 3] for k in range(28)) < 14
    docs = [(k, " ".join([f"n{rng.randrange(10**6)}", *edited, f"n{rng.randrange(10**6)}"])) for k in range(copies)]
    docs.append((-5, "w27 w28 w29 alone says little"))
    bench = spark.createDataFrame([(3, " ".join(item))], "item_id long, text string")
    got = benchmark_matches(frame(spark, docs), bench).collect()
    assert sorted(r.doc_id for r in got) == list(range(copies))
    assert {(r.first_word, r.last_word, r.score) for r in got} == {(1, 30, (2 * 23 - 7) / 60)}
