import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import frame, rows


@given(st.lists(st.tuples(st.text("ab", max_size=12).map(lambda t: t.encode() * 2), st.integers(0, 50)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_trie_holds_the_least(pairs):
    from veilframe.llm.filter_audit import Trie

    trie, least = Trie(), {}
    for text, value in pairs:
        trie.insert(text, (value, text))
        least[text] = min(value, least.get(text, value))
    assert sorted(trie.terminals()) == sorted((v, t) for t, v in least.items())


def _plain(data, labels):
    """The figures by running every order over the rows."""
    texts = [t or "" for _, _, t in data]
    fails = []
    for (i, _, _), t in zip(data, texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and any(j is not None and j < i and u == t for (j, _, _), u in zip(data, texts))
        fails.append({c for c, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), e)) if bad})
    out, shapley = {}, {}
    for part in {s or "" for _, s, _ in data}:
        own = [k for k, (_, s, _) in enumerate(data) if (s or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [k for k in left if c in fails[k]]
                before = len([k for k in own if c in fails[k]]) - len(gone)
                left = [k for k in left if c not in fails[k]]
                lost = [sum(labels.get(data[k][0], (0, 0))[j] for k in gone) for j in (0, 1)]
                out[part, "".join(order), step] = (len(left), len(gone), before, sum(fails[k] == {c} for k in own), *lost)
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def _cases():
    rng = random.Random(3)
    some = lambda k: " ".join(rng.choice(["Word", "a", "b#", "to", "on", "IS", "x%", *"cdefghij"]) for _ in range(k))
    texts = [t for _, t in rows(n=25)] + [some(rng.randint(30, 80)) for _ in range(20)]
    texts += ["head " * 400 + some(3) for _ in range(25)] + ["same text"] * 8 + [" ".join(f"w{i}" for i in range(70))] * 5
    data = [(rng.choice([k, k, k, 7, None]), rng.choice(["s1", "s2", "", None]), t) for k, t in enumerate(texts)]
    return data + data[:6]  # repeated rows


@pytest.mark.parametrize("options", [{}, {"held_bytes": 50, "trie_bytes": 300}])
def test_audit_equals_running_every_order(spark, monkeypatch, options):
    from veilframe.llm import filter_audit

    if options:
        whole = filter_audit.first_of_each
        monkeypatch.setattr(filter_audit, "first_of_each", lambda *a: whole(*a, **options))
    data = _cases()
    known = {k: (k % 2, int(k % 3 == 0)) for k in range(0, 60, 2)}
    rows_of_labels = [(i, q, t) for i, (q, t) in known.items()] + [(4, 1, None), (6, None, 1), (None, 1, 1)]
    labels = spark.createDataFrame(rows_of_labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x")).withColumn("part", F.lit("y"))
    known |= {4: (1, known[4][1]), 6: (known[6][0], 1)}
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    for name in ("id", "h", "part", "mask", "n", "good", "toxic", "first", "cell", "size"):
        docs = docs.withColumn(name, F.lit("other"))
    got = filter_audit.filter_audit(docs.repartition(5), labels).collect()
    figures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    expected = _plain(data, known)
    assert len(got) == len(expected) == 3 * 600
    assert {(r.part, r.filter_order, r.step): tuple(r[f] for f in figures) for r in got} == expected


def test_audit_of_awkward_tables(spark):
    from veilframe.llm.filter_audit import filter_audit

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(frame(spark, []), none).collect() == []
    long = "".join(f"Aa{i} " for i in range(900_000))
    docs = spark.createDataFrame([(2, "s", long), (1, "s", long), (3, "s", long[:-1]), (4, "s", None), (5, "s", "")], "doc_id long, source string, text string")
    first = {r.step: r for r in filter_audit(docs, none).filter("filter_order = 'EABCD'").collect()}
    assert (first[1].removed, first[2].removed, first[4].removed, first[5].kept) == (2, 1, 2, 0)
    own = filter_audit(docs, none, filters={"X": F.length("text") < 5}, repeated="Y").filter("filter_order = 'XY'").collect()
    assert sorted((r.step, r.removed, r.redundant) for r in own) == [(1, 2, 0), (2, 1, 1)]


def test_cuts_go_as_deep_as_texts_demand(spark):
    from veilframe.llm.filter_audit import prefix_cuts

    rng = random.Random(8)
    texts = ["t" * 3000 + f"{rng.random()}" for _ in range(800)] + [f"{rng.random()} begins otherwise" for _ in range(200)]
    cuts = prefix_cuts(spark.createDataFrame([(t,) for t in texts], "text string"), 20)
    cells = [sum(c <= t.encode() for c in cuts) for t in texts]
    assert 15 <= len(cuts) <= 30 and max(cells.count(c) for c in set(cells)) <= 120
    assert max(map(len, cuts)) < 3020 and min(map(len, cuts)) < 10
    assert prefix_cuts(spark.createDataFrame([("same",)] * 50, "text string"), 20) == []
    assert prefix_cuts(spark.createDataFrame([], "text string"), 20) == []
