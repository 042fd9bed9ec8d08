import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import crc_mod, frame, lowered, rows

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_vocabulary_gives_the_library_s_ids():
    from veilframe.llm.vocabulary import Vocabulary

    rng = random.Random(3)
    signs = list("ab' 'sSREtrevlld\n\t  .,!1٣½éΣσßİ中🙂 　\x1c\x85​᠎_-́eÅ")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(800)] + [t for _, t in rows()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        known = Vocabulary(public_tokenizers.path(name))
        for _ in range(2):  # the second time from the worker's memory
            ids, bounds = known.encode(pa.array(texts))
        expected = [e.ids for e in known.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:z].tolist() for a, z in zip(bounds, bounds[1:])] == expected


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_on_every_code_point(name):
    """Alone, between letters and before 's: all checked code points, and a share of all others."""
    from tokenizers import Tokenizer

    from veilframe.llm.vocabulary import CHECKED, Vocabulary

    codes = [c for low, high in CHECKED for c in range(low, high + 1)] + [*range(0x300, 0xD800, 11), *range(0xE000, 0x110000, 997), 0x558, 0x1C89, 0xA7CB, 0x10D50]
    vocabulary, library = Vocabulary(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for context in ("{}", "a{}b", "{}'s", "é {}1{}"):
        texts = [context.replace("{}", chr(c)) for c in codes]
        ids, bounds = vocabulary.encode(pa.array(texts))
        expected = library.encode_batch(texts, add_special_tokens=False)
        wrong = [hex(c) for c, e, a, b in zip(codes, expected, bounds, bounds[1:]) if ids[a:b].tolist() != e.ids]
        assert wrong == []


@pytest.mark.parametrize("head", [1, 1 << 16])
def test_token_counts_equal_encoding(spark, head):
    import sentencepiece

    from veilframe.llm.token_counts import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark), path, limit=100, head=head).collect()}
    expected = collections.defaultdict(lambda: [0, 0])
    for i, text in rows():
        expected[i][0] += len((text or "").encode())
        expected[i][1] += len(library.encode(text or ""))
    assert got == {i: (b, n, n > 100) for i, (b, n) in expected.items()}


def test_token_counts_of_nothing(spark):
    from veilframe.llm.token_counts import token_counts

    assert token_counts(frame(spark, []), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def _scores(data, states, least, discount, end="\0end"):
    """The same model, one token at a time."""
    count, pairs = collections.Counter(), collections.Counter()
    train = [t for i, t in data if crc_mod(i, 7) != 2]
    for text in train:
        count.update([*lowered(text), end])
    total, kinds = sum(count.values()), len(count)
    top = sorted((w for w in count if w != end), key=lambda w: (-count[w], w))[:states - 1]
    alphabet = {*top, end}
    for text in train:
        for a, b in zip([end, *lowered(text)], [*lowered(text), end]):
            pairs[a, b] += a in alphabet and b in alphabet
    arcs = {p: n for p, n in pairs.items() if n >= least}
    rest = {h: 1 - sum(n - discount for (a, _), n in arcs.items() if a == h) / count[h] for h in alphabet}
    root = lambda w: (count[w] + 1) / (total + kinds + 1)
    out = collections.defaultdict(lambda: [0, 0, 0.0, 0.0])
    for i, text in data:
        sums = out[i]
        for a, b in zip([end, *lowered(text)], [*lowered(text), end]):
            p = root(b)
            if a in alphabet:
                p = rest[a] * p + (max(arcs[a, b] - discount, 0) / count[a] if (a, b) in arcs else 0)
            sums[0] += 1
            sums[1] += count[b] > 0
            sums[2] += math.log10(root(b))
            sums[3] += math.log10(p)
    mass = [sum(rest[h] * root(w) + (arcs[h, w] - discount if (h, w) in arcs else 0) / count[h] for w in count) + rest[h] / (total + kinds + 1) for h in alphabet]
    return total, out, mass


@pytest.mark.parametrize("states, head", [(40, 100), (2048, 1 << 16)])
def test_language_model(spark, states, head):
    from veilframe.llm.language_model import score_texts

    total, expected, mass = _scores(rows(), states, 2, 0.75)
    assert np.allclose(mass, 1)  # each state is a distribution
    got = score_texts(frame(spark), states=states, head=head).collect()
    assert {r.train_tokens for r in got} == {total}
    assert {r.doc_id: (r.n_tokens, r.n_known, r.held_out) for r in got} == {i: (v[0], v[1], crc_mod(i, 7) == 2) for i, v in expected.items()}
    for r in got:
        assert r.base_score == pytest.approx(expected[r.doc_id][2], rel=1e-9)
        assert r.score == pytest.approx(expected[r.doc_id][3], rel=1e-9)


@pytest.mark.parametrize("options", [{}, {"head": 100, "arcs_head": 50}])
def test_language_model_has_a_state_for_every_word(spark, options):
    from veilframe.llm.language_model import score_texts

    rng = np.random.default_rng(3)  # 3 000 words, half of them always followed by the same one
    data = [(k, " ".join(f"a{w} b{w}" for w in rng.integers(0, 1500, 60))) for k in range(150)]
    _, expected, _ = _scores(data, 10**6, 2, 0.75)
    got = score_texts(frame(spark, data), **options).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.base_score == pytest.approx(expected[r.doc_id][2], rel=1e-9)
        assert r.score == pytest.approx(expected[r.doc_id][3], rel=1e-9)


@pytest.mark.parametrize("options", [{"arcs_head": 0}, {"arcs_head": 0, "head": 0}])
def test_language_model_in_many_buckets(spark, monkeypatch, options):
    """Pairs by their words' places and by hash, null ids and repeated ones, in buckets of few tokens."""
    from veilframe.llm import language_model

    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 200)
    rng = np.random.default_rng(4)
    data = [(k, " ".join(f"w{w}" for w in rng.integers(0, 60, 50))) for k in range(60)]
    _, expected, _ = _scores(data, 10**6, 2, 0.75)
    got = {r.doc_id: r for r in language_model.score_texts(frame(spark, data), **options).collect()}
    assert len(got) == len(data)
    for i, row in expected.items():
        assert [got[i].n_tokens, got[i].n_known] == list(row[:2]) and got[i].score == pytest.approx(row[3], rel=1e-9)
    twice = language_model.score_texts(frame(spark, data + [(None, "w1 w2")] * 3 + [(7, "w1 w2 w3")])).collect()
    assert {r.doc_id: r.n_tokens for r in twice} == {k: 51 + 4 * (k == 7) for k in range(60)} | {None: 9}


def test_language_model_moves_pairs_packed():
    """A pair of two frequent words takes few bytes, where its hashes would take sixteen."""
    from veilframe.llm import language_model

    rng = np.random.default_rng(5)
    key = np.unique((rng.integers(0, 1 << 18, 100_000) << 32) | rng.integers(0, 1 << 18, 100_000))
    column = [np.diff(key, prepend=np.int64(0)), np.ones(len(key), np.int64)]
    data = language_model._pack(*column)
    assert len(data) < 8 * len(key)
    assert [c.tolist() for c in language_model._unpack(data, len(key), 2)] == [c.tolist() for c in column]


def test_language_model_looks_words_up_once_and_sums_before_rows():
    """Keys of whole texts equal those of single pairs; gains of a block's texts are one sum each."""
    import pyarrow as pa

    from veilframe.llm import language_model as m

    places = m.Known(pa.table({"h": np.array([m.END, 5, 9, -3])}))
    history, word = np.array([m.END, 5, 7, m.END, 9]), np.array([5, 7, m.END, 9, m.END])
    key, here, at = m._text_keys(history, word, places)
    assert key.tolist() == m._key(history, word, places.find(history), places.find(word)).tolist()
    assert here.tolist() == [True, False, True, True, True] and places.key[at[here]].tolist() == [5, m.END, 9, m.END]
    key, which, n = m._distinct_pairs(np.array([4, 2, 4, 4, 2]), np.array([0, 0, 0, 1, 2]))
    assert list(zip(key.tolist(), which.tolist(), n.tolist())) == [(2, 0, 1), (2, 2, 1), (4, 0, 2), (4, 1, 1)]
    there, sums = m._sum_within(np.array([7, 2, 7]), np.array([0.5, 1.0, 0.25]))
    assert (there.tolist(), sums.tolist()) == ([2, 7], [1.0, 0.75])


def test_language_model_frees_its_tables(spark, monkeypatch):
    """What nothing reads any more is gone before texts are scored."""
    import os

    from veilframe.llm import language_model
    from veilframe.llm.store import Workspace

    write, there = Workspace.table, []

    def watched(work, df, name):
        if name == "documents":
            there.extend(sorted(n for n in os.listdir(work.path("").split(":")[-1]) if not n.startswith(".")))
        return write(work, df, name)

    monkeypatch.setattr(Workspace, "table", watched)
    assert len(language_model.score_texts(frame(spark)).collect()) == len({i for i, *_ in rows()})
    assert there == ["arcs", "words"]


def test_hashing_words_holds_little():
    """Hashes of a block's words equal those of each word alone, and take little more memory than themselves."""
    import tracemalloc

    from veilframe.llm.text import HASHED_BYTES, Texts, slice_hashes

    rng = np.random.default_rng(6)
    words = ["x" * int(n) for n in rng.integers(1, 9, 1_000_000)] + ["y" * (HASHED_BYTES + 5), "z", "x"]
    texts = Texts(pa.array([" ".join(words)]))
    starts, ends, _ = texts.words()
    slice_hashes(texts.data[:1000], starts[:9], ends[:9])
    tracemalloc.start()
    hashes = slice_hashes(texts.data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(texts.data)  # sums, values and powers of all bytes took five times that
    at = np.append(rng.integers(0, len(words), 300), [0, len(words) - 3, len(words) - 2, len(words) - 1])
    for i in at:
        alone = np.frombuffer(words[i].encode(), np.uint8)
        assert hashes[i] == slice_hashes(alone, np.array([0]), np.array([len(alone)]))[0]
    empty = np.zeros(0, np.int64)
    assert len(slice_hashes(texts.data, empty, empty)) == 0
    assert len(set(slice_hashes(texts.data[:4], np.array([0, 4, 4]), np.array([0, 4, 4])).tolist())) == 1


def test_language_model_names_the_words_of_pairs():
    """Pairs that are chosen get their words by place, or from the list of those without places."""
    from veilframe.llm.language_model import _words_of

    places = np.array([50, 60, 70])
    key = np.array([-9, -4, 1 << 32, 2, -9, 2 << 32 | 1])
    a, b = _words_of(key, np.array([4, 5, 1, 3]), np.array([1, 2, 3]), np.array([4, 5, 6]), places)
    assert (a.tolist(), b.tolist()) == ([3, 70, 2, 50], [6, 60, 5, 70])


def test_language_model_sorts_only_frequent_words(spark):
    """The most frequent words are found among little more than themselves."""
    from veilframe.llm.language_model import _upper

    words = spark.createDataFrame([(f"w{k}", 1 + 5000 // (k % 5000 + 1)) for k in range(10_000)], "piece string, n long").repartition(4)
    top = lambda df, n: [r.piece for r in df.orderBy(F.desc("n"), "piece").limit(n).collect()]
    for n in (0, 1, 7, 100, 20_000):
        assert top(_upper(words, n), n) == top(words, n)
    assert 100 <= _upper(words, 100).count() < 130 and _upper(words, 20_000).count() == 10_000
    assert _upper(words.limit(0), 5).collect() == []


def test_language_model_starts_no_second_kind_of_worker(spark, monkeypatch):
    """Rows made by Python's parallelize would start workers of their own, which stay in an executor's memory."""
    from pyspark import SparkContext

    from veilframe.llm.language_model import score_texts

    docs = frame(spark)
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("parallelize"))
    assert len(score_texts(docs).collect()) == len({i for i, *_ in rows()})


def test_language_model_of_little(spark):
    from veilframe.llm.language_model import score_texts

    assert score_texts(frame(spark, [])).collect() == []
    held = next(i for i in range(100) if crc_mod(i, 7) == 2)
    (row,) = score_texts(frame(spark, [(held, "nobody taught this")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (4, 0, 0, 0.0)


def test_wavelet_shard_answers():
    from veilframe.llm.wavelet import Shard, build

    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (3000, 50), (1537, 49408), (600, 1 << 20)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        shard = Shard(build(ids, [7, None], np.array([n, 0])))
        names, known, lengths = shard.documents()
        assert (names[0], known.tolist(), lengths.tolist()) == (7, [True, False], [n, 0])
        assert shard.ids().tolist() == ids.tolist()
        for i in rng.integers(0, n, 40) if n else ():
            token = int(ids[i])
            places = np.flatnonzero(ids == token)
            assert shard.access(int(i)) == token
            assert shard.count(token) == len(places)
            assert shard.count(token, int(i)) == (places >= i).sum()
            assert shard.occurrence(token, len(places) - 1) == places[-1]
        assert shard.count(1 << 25) == 0


def test_shards_round_trip(spark):
    from tokenizers import Tokenizer

    from veilframe.llm.wavelet import store_and_read

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = store_and_read(frame(spark), path, shard_tokens=700).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows()), key=lambda i: -1 if i is None else i)
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows()]
    crc = sorted((i or -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == crc
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert store_and_read(frame(spark, []), path).collect() == []


@pytest.mark.parametrize("options", [{}, {"targets": {"s0": 3.0, "s1": 1.0}, "quantum": 16, "length": 64}, {"queues": 2, "length": 100}])
def test_packing_covers_every_id_once(spark, options):
    from tokenizers import Tokenizer

    from veilframe.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    length = options.get("length", 1024)
    got = pack(frame(spark), path, **options).toPandas()
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == np.cumsum([0, *sequence.length])[:-1].tolist()
    sizes = got.groupby("sequence_id").length.sum()
    assert sorted(sizes.index) == list(range(len(sizes))) and (sizes.iloc[:-1] == length).all() and sizes.iloc[-1] <= length
    expected = collections.defaultdict(list)
    for i, t in rows():
        expected[-1 if i is None else i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    assert sizes.sum() == sum(len(x) for v in expected.values() for x in v)
    got["doc_id"] = got.doc_id.fillna(-1)
    for i, pieces in got.sort_values("start").groupby("doc_id"):
        for p in pieces.itertuples():
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for x in expected[i])
        if len(expected[i]) == 1:
            assert pieces.start.tolist() == np.cumsum([0, *pieces.length])[:-1].tolist()


def test_mixture_holds_in_every_stretch():
    from veilframe.llm.packing import Mixture

    totals = [70_000, 20_050, 9_937, 3]
    mixture = Mixture(totals, totals, 16)
    packed = np.full(sum(totals), -1)
    for q, total in enumerate(totals):
        k = np.arange(-(-total // 16))
        for turn, place in zip(k, mixture.places(np.full(len(k), q), k)):
            size = min(16, total - 16 * turn)
            assert (packed[place:place + size] == -1).all()
            packed[place:place + size] = q
    assert (packed >= 0).all()
    for end in range(1024, len(packed), 1024):  # no deficit grows beyond a quantum or two
        for q, total in enumerate(totals):
            assert abs((packed[:end] == q).sum() - end * total / len(packed)) <= 32
    assert Mixture([], [], 16).places(np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_every_source_of_many_has_its_share(spark):
    from veilframe.llm.packing import pack

    data = [(k, f"text {k} of source {k % 40} " * 20) for k in range(1200)]
    docs = spark.createDataFrame([(i, t, f"s{i % 40:02}") for i, t in data], "doc_id long, text string, source string").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    options = {"targets": {f"s{k:02}": 8.0 if k == 7 else 1.0 for k in range(40)}, "quantum": 16, "length": 1024}
    few, many = (pack(docs, path, queues=q, **options).toPandas() for q in (64, 4))
    assert few.length.sum() == many.length.sum() and few.sequence_id.max() == many.sequence_id.max()
    for got in (few, many):
        early = got[got.sequence_id < 20]  # s07 has ended later than that
        shares = early.groupby(early.doc_id % 40).length.sum() / early.length.sum()
        assert len(shares) == 40 and abs(shares[7] - 8 / 47) < 0.01 and (shares.drop(7) - 1 / 47).abs().max() < 0.01
    key = ["doc_id", "start"]
    assert few.sort_values(key).reset_index(drop=True).equals(many.sort_values(key).reset_index(drop=True))


def test_packing_of_nothing(spark):
    from veilframe.llm.packing import pack

    assert pack(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
