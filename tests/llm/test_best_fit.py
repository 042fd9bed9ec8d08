import collections
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import frame, rows


def _bins(lengths, capacity):
    """The same rule, one piece at a time."""
    large = sorted((x for x in lengths if 3 * x > capacity), reverse=True)
    gaps = []
    while large:
        x = large.pop(0)
        fit = next((y for y in large if x + y <= capacity), None)
        if fit is not None:
            large.remove(fit)
        gaps.append(capacity - x - (fit or 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        best = min((g for g in gaps if g >= x), default=None)
        if best is not None:
            gaps.remove(best)
        gaps.append((capacity if best is None else best) - x)
    return len(gaps)


def _placed(counts, capacity):
    from veilframe.llm.best_fit_packing import Plan

    plan = Plan(dict(counts), capacity)
    taken = collections.defaultdict(list)
    for length, n in counts.items():
        sequence, offset = plan.places(np.full(n, length), np.arange(n))
        for q, o in zip(sequence.tolist(), offset.tolist()):
            taken[q].append((o, length))
    for pieces in taken.values():
        at = 0
        for o, length in sorted(pieces):
            assert o == at
            at += length
        assert at <= capacity
    return plan, taken


@given(st.lists(st.integers(1, 24), max_size=120))
@settings(max_examples=150, deadline=None)
def test_plan_is_greedy_matching_and_best_fit(lengths):
    plan, taken = _placed(collections.Counter(lengths), 24)
    assert len(taken) == plan.sequences == _bins(lengths, 24)


def test_plan_does_not_grow_with_the_data():
    rng = random.Random(1)
    counts = {x: rng.randrange(1, 40) for x in range(1, 257)}
    small, taken = _placed(counts, 256)
    large, _ = _placed({x: 1000 * n for x, n in counts.items()}, 256)
    assert len(large.runs) < 2000 and len(large.runs) < 2 * len(small.runs)
    assert large.sequences <= 1000 * small.sequences
    assert len(taken) == _bins([x for x, n in counts.items() for _ in range(n)], 256)


def test_pieces_hold_every_id_once(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from veilframe.llm.best_fit_packing import best_fit, sequences

    data = rows() + [(None, None), (5, "again"), (5, "again"), (9000, "abc def " * 300_000)]
    packed = best_fit(frame(spark, data).withColumn("rank", F.lit("x")).withColumn("number", F.lit("y")).withColumn("ids", F.lit("z")), path("byte_bpe_50k.json"), capacity=64)
    got = packed.collect()
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    expected = collections.Counter()
    for i, text in data:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids), 64), len(ids)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            expected[i, k, a, z - a, tuple(ids[a:z])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == expected
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
    joined = {r.sequence_id: r for r in sequences(packed).collect()}
    assert set(joined) == set(by_sequence)
    for q, pieces in by_sequence.items():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) == joined[q].n_tokens <= 64
        assert joined[q].ids == b"".join(bytes(r.ids) for r in pieces)
    assert len(by_sequence) == _bins([r.length for r in got], 64)
    assert best_fit(frame(spark, []), path("byte_bpe_50k.json")).collect() == []


def test_query_digests(spark, sf):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from veilframe.llm.queries import QUERIES

    got = QUERIES["op13_best_fit_packing"](spark, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at:at + r.length].tobytes()))
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    assert len({r.sequence_id for r in got}) <= 1.02 * -(-total // 2048) + 1
