import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import frame, lowered, rows, words


def _components(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    from veilframe.llm.components import components
    from veilframe.llm.store import Workspace

    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    links += [(5, 5), (None, 3), (61, 59)]
    with Workspace(spark, "test") as work:
        got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), work).collect()}
        assert components(spark.createDataFrame([], "a long, b long"), work, "none").collect() == []
    solid = [(a, b) for a, b in links if a is not None and a != b]
    assert got == _components(solid, {x for pair in solid for x in pair})


def _sets(data, size=5):
    out = []
    for _, text in data:
        w = lowered(text)
        out.append(frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def _similar(data, percent=80):
    sets = _sets(data)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, _components(links, range(len(sets)))


def _linked_rows():
    """Sets around the threshold, chains, families with common shingles, copies."""
    rng = random.Random(9)
    some = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    data = list(rows())
    for f in range(5):
        base = some(rng.randint(20, 90))
        for i in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(100)}"
            data.append((5000 + 100 * f + i, " ".join(w[rng.randint(0, 6):])))
    line = " ".join(some(12))
    data += [(7000 + i, f"{line} {' '.join(some(rng.randint(0, 40)))}") for i in range(30)]
    return data


@pytest.mark.parametrize("options", [{}, {"list_rows": 3, "common": 5, "tile": 3}])
def test_similar_sets(spark, monkeypatch, options):
    from veilframe.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "OFTEN", 2 if options else 64)
    data = _linked_rows()
    sets, component = _similar(data)
    named = {}
    for k, root in component.items():
        named.setdefault(root, []).append(data[k][0])
    smallest = {root: min((i for i in ids if i is not None), default=None) for root, ids in named.items()}
    got = jaccard_join.similar_sets(frame(spark, data), **options).collect()
    expected = collections.Counter((i, len(sets[k]), smallest[component[k]]) for k, (i, _) in enumerate(data))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    assert {r.doc_id for r in got if r.kept and r.n_shingles and r.doc_id is not None} == {v for k, v in smallest.items() if v is not None and sets[k]}


def _family(n, seed, edits):
    """Copies of one text of 60 words with some words replaced, the text itself first."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    data = [(0, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for at in rng.sample(range(60), edits(rng)):
            w[at] = f"e{rng.randrange(40)}" if rng.random() < 0.5 else f"u{i}x{at}"
        data.append((i, " ".join(w)))
    return data


@pytest.mark.parametrize("loose", [50, 80, 5])
def test_family_around_the_threshold(spark, monkeypatch, loose):
    """Sets that resemble each other just not enough, shared edits among them; answers derived from
    a first set are those of comparing all."""
    from veilframe.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "LOOSE", loose)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 50)
    data = _family(700, 4, lambda rng: rng.choice([0, 1, 2, 3, 3, 4, 5, 9])) + [(1000 + i, t) for i, t in _family(150, 5, lambda rng: rng.choice([1, 2, 3]))[1:]]
    data += [(5, data[700][1]), (5, data[40][1]), (None, data[30][1])]  # several texts of one id
    data += [(2000 + i, " ".join(f"o{rng}" for rng in range(i, i + 30))) for i in range(0, 40, 3)]
    sets = _sets(data)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    ids = {}
    for k, (i, _) in enumerate(data):
        ids.setdefault(i, []).append(k)
    links += [(a, b) for i, ks in ids.items() if i is not None for a, b in zip(ks, ks[1:])]
    component = _components(links, range(len(sets)))
    smallest = {}
    for k, root in component.items():
        smallest[root] = min([smallest.get(root, 10**9)] + [data[k][0]] * (data[k][0] is not None))
    got = jaccard_join.similar_sets(frame(spark, data, clash=False), tile=64).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == collections.Counter((i, smallest[component[k]]) for k, (i, _) in enumerate(data))


def test_family_of_twenty_thousand(spark, monkeypatch):
    """No more rows than a few per set leave the index lists and the tiles."""
    from veilframe.llm import jaccard_join

    data = _family(20_000, 6, lambda rng: rng.choice([1, 1, 1, 12]))
    made = {}
    whole = jaccard_join.Workspace.table

    def table(self, df, name):
        out = whole(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join.Workspace, "table", table)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_sets(frame(spark, data, clash=False)).collect()}
    far = sum(i != c for i, c in got.items())
    assert abs(far - 15_000) < 400 and made["pairs"] < 100_000 and made["near"] < 60_000


def test_one_of_each_keeps_columns(spark):
    from veilframe.llm.jaccard_join import one_of_each

    data = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "g h i j k"), (4, None), (5, ""), (None, "q r s t u v"), (None, "q r s t u v"), (None, "g h i j k")]
    docs = frame(spark, data)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text) == [(-1, "q r s t u v"), (1, "a b c d e f"), (3, "g h i j k")]
    assert kept.filter("text is null or text = ''").count() == 2
    assert one_of_each(frame(spark, [])).collect() == []


def _without(data, window):
    split = [words(t) for _, t in data]
    seen = collections.Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = True
        out.append((len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"hot": 2, "digests": 0}, {"window": 6, "gram": 2}])
def test_repeated_passages(spark, options):
    from veilframe.llm.substring_dedup import repeated_passages

    data = rows() + [(8000 + i, "x y z " * (20 * i)) for i in range(3)]
    got = repeated_passages(frame(spark, data), **options).collect()
    expected = collections.Counter((i, n, gone, hashlib.sha256(kept).hexdigest()) for (i, _), (n, gone, kept) in zip(data, _without(data, options.get("window", 35))))
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected
    for r in got:
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed


def test_texts_without_passages(spark):
    from veilframe.llm.substring_dedup import repeated_passages, without_passages

    docs = frame(spark)
    left = without_passages(docs, repeated_passages(docs))
    assert left.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text, r.n_chars) for r in left.collect())
    expected = []
    for (i, text), (_, gone, kept) in zip(rows(), _without(rows(), 35)):
        new = kept.decode() if gone else text
        expected.append((i, new, len(new) if new is not None else None))
    assert got == collections.Counter(expected)
    assert without_passages(frame(spark, []), repeated_passages(frame(spark, []))).collect() == []


def test_near_vectors(spark):
    from veilframe.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(2)
    data, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(rng.integers(1, 9)):
                data.append((k, (centre + rng.normal(0, 0.25, 16)).astype(np.float32).tolist(), label))
                k += 1
    tight = rng.standard_normal(16)
    data += [(k + i, (tight + rng.normal(0, 0.02, 16)).astype(np.float32).tolist(), 0) for i in range(40)]
    k += 40
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1e30] * 16, [2e30] * 16, [1.0] * 8]
    data += [(k + i, v, 0) for i, v in enumerate(odd)] + [(None, [1.0] * 16, 0)]
    frame_ = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("x")).withColumn("id", F.lit("y"))
    fine = {}
    for i, v, label in data:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(float)
            u /= np.abs(u).max()
            fine[i] = (label, u / np.linalg.norm(u))
    links = [(a, b) for a in fine for b in fine if a < b and fine[a][0] == fine[b][0] and len(fine[a][1]) == len(fine[b][1]) and fine[a][1] @ fine[b][1] >= 0.93]
    count = collections.Counter(x for pair in links for x in pair)
    component = _components(links, {i for i, _, _ in data if i is not None})
    for options in ({}, {"tile": 8}, {"bucket": 8, "miss": 1e-9, "sure": 8.0}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame_, **options).collect()}
        assert got.pop(None) == (0, None, None)
        assert got == {i: (count[i], c, c == i) for i, c in component.items()}
    assert len(links) > 700
    assert near_vectors(frame_.limit(0)).collect() == []


def test_estimate_is_unbiased_and_bounded():
    from veilframe.llm.embedding_dedup import codes, may_reach

    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(0, 0.06, x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    turned, _, _ = codes(x)
    _, corner, factor = codes(y)
    estimate = (turned * corner).sum(1) / factor
    exact = (x * y).sum(1)
    assert abs((estimate - exact).mean()) < 0.005
    open_ = np.array([may_reach(turned[i:i + 1], corner[i:i + 1], factor[i:i + 1], 0.93, 4.0)[0, 0] for i in range(len(x))])
    assert open_[exact >= 0.93].mean() > 0.999
    strangers = may_reach(turned[:500], corner[500:1000], factor[500:1000], 0.93, 4.0)
    assert strangers.mean() < 0.001
