"""A word n-gram model as a weighted backoff automaton, and its score of whole texts.

States are histories. The root has an arc for every word: (c + 1) / (N + V + 1), with one share
for all unknown words. Every word of training also has a state of its own, with an arc for each
word that followed it at least `least` times, weighted by the discounted count; its failure arc
leads to the root and carries the rest of the probability, so that the weights of a state always
sum to one. In each state the arc of the next token is taken, or the failure arc and then the
root's, and the logarithms are added. So a text's score is the sum of its tokens' root arcs, of
its histories' failure arcs, and for each arc that is taken of what it gains over these two.
Frequent words and arcs are in broadcasts of bounded size; texts get all others by joins, so
neither has a limit. Pairs move in packed blocks, one for each bucket of keys: two frequent words
are named by their places, so that sorted keys take two or three bytes each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.counting import HEAD, piece_counts, rare_pieces
from veilframe.llm.store import Workspace
from veilframe.llm.text import Texts, blocks, mix, run_ids, slice_hashes

#: Arcs in the broadcast lookup, 16 bytes each; texts get the others by a join.
ARCS = 1 << 20
#: Tokens of training for each bucket of pairs.
BUCKET_TOKENS = 1 << 20
#: The end of a text, among the words' hashes; it also stands before a text's first word.
END = 0x2545F4914F6CDD1D
DISCOUNT = 0.75


def _cut(column: pa.Array):
    texts = Texts(column).lowered()
    return (texts, *texts.words())


def _pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's history and own hash, ends included, and which text it is of."""
    count = len(first) - 1
    doc = np.repeat(np.arange(count), np.diff(first) + 1)
    word = np.full(len(hashes) + count, END, dtype=np.int64)
    word[np.arange(len(hashes)) + run_ids(first)] = hashes.view(np.int64)
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[first[:-1] + np.arange(count)] = END
    return history, word, doc


def _hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One negative hash for a pair."""
    return mix(mix(history.view(np.uint64)) * np.uint64(0xD1342543DE82EF95) + word.view(np.uint64)).view(np.int64) | np.int64(-1 << 63)


def _key(history: np.ndarray, word: np.ndarray, found: tuple[np.ndarray, np.ndarray], found_b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One number for a pair: the places of both words if they have one, else its hash. `found`: which
    of the words have a place, and which place."""
    (here, at), (here_b, at_b) = found, found_b
    key = at << 32 | at_b
    other = ~(here & here_b)
    key[other] = _hash(history[other], word[other])
    return key


def _words_of(key: np.ndarray, at: np.ndarray, rare_a: np.ndarray, rare_b: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both words of the pairs key[at]. The pairs without places have theirs in rare_a and rare_b, in the order of `key`."""
    chosen = key[at]
    a, b, other = chosen >> 32, chosen & 0xFFFFFFFF, chosen < 0
    a[~other], b[~other] = words[a[~other]], words[b[~other]]
    nth = np.cumsum(key < 0)[at[other]] - 1
    a[other], b[other] = rare_a[nth], rare_b[nth]
    return a, b


def _text_keys(history: np.ndarray, word: np.ndarray, places: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the pairs of whole texts, whose histories are the words before, so that words are
    looked up once; and which of the words have a place, and which place."""
    here, at = places.find(word)
    if not len(word):
        return word, here, at
    end = places.find(np.array([END]))
    after_end = history == END
    before = [np.where(after_end, e[0], np.concatenate((e, w[:-1]))) for e, w in zip(end, (here, at))]
    return _key(history, word, (before[0], before[1]), (here, at)), here, at


def _distinct_pairs(key: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, which) in this order and how often each occurs; `which` comes in ascending order."""
    order = np.argsort(key, kind="stable")
    key, which = key[order], which[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (which[1:] != which[:-1])
    first = np.flatnonzero(new)
    return key[first], which[first], np.diff(np.append(first, len(key)))


def _sum_within(which: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ones occur, in ascending order, and the sum of the values of each."""
    if not len(which):
        return which, values
    sums = np.bincount(which, values)
    there = np.flatnonzero(np.bincount(which))
    return there, sums[there]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, compressed byte by byte."""
    return pa.compress(b"".join(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=size * columns * 8, codec="zstd", asbytes=True), dtype=np.uint8)
    return [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in raw.reshape(columns, 8, size)]


def _by_bucket(key: np.ndarray, buckets: int):
    """Each bucket that has some of these keys, and where they are, in their order."""
    bucket = key % buckets
    order = np.argsort(bucket.astype(np.int16 if buckets < 1 << 15 else np.int32), kind="stable")  # 16 bits: a radix sort
    cuts = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b]:cuts[b + 1]]


class Known:
    """Rows of numbers by key, sorted, to look up many at once."""

    def __init__(self, table: pa.Table):
        key, *values = (c.to_numpy() for c in table.columns)
        order = np.argsort(key)
        self.key, self.values = key[order], [v[order] for v in values]

    def aligned(self, keys: np.ndarray) -> Known:
        """These sorted keys with the values they have here; all of them are here, or this is empty."""
        if len(self.key):
            _, at = self.find(keys)
            self.key, self.values = keys, [v[at] for v in self.values]
        return self

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these are here, and where (0 for the others)."""
        if not len(self.key):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        here = self.key[at] == keys
        return here, np.where(here, at, 0)

    def value(self, i: int, here: np.ndarray, at: np.ndarray, other: float) -> np.ndarray:
        return np.where(here, self.values[i][at], other) if len(self.key) else np.full(len(here), other)


def _most_frequent(arcs: DataFrame, most: int) -> DataFrame:
    """At most so many arcs: all whose count is in the upper ones of logarithmic classes."""
    size = F.floor(F.log2("n") * 8)
    least, sum_ = None, 0
    for r in arcs.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 8 * 64 rows
        sum_ += r["count"]
        if sum_ > most:
            break
        least = r["size"]
    return arcs.filter(size >= least) if least is not None else arcs.limit(0)


def _upper(words: DataFrame, least: int) -> DataFrame:
    """The words of the upper logarithmic classes that hold at least so many together, all if there are fewer:
    the most frequent ones are among these, so that one task need not sort those of the whole vocabulary."""
    size = F.floor(F.log2("n") * 8)
    sum_ = 0
    for r in words.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 8 * 64 rows
        sum_ += r["count"]
        if sum_ >= least:
            return words.filter(size >= r["size"])
    return words


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", fold: int = 7, held: int = 2, states: int | None = None, least: int = 2, discount: float = DISCOUNT, head: int = HEAD, arcs_head: int = ARCS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per id.

    Tokens are lower-cased (A-Z) runs without blanks, then one end per text. Learns from texts
    whose crc32(id as text) mod `fold` is not `held`; scores all. base_score is the root's alone,
    score the automaton's. With `states`, only the end and the states - 1 most frequent words have
    states and arcs to them. A null or empty text is its end token. A null id counts as the text ''.
    Rows that share an id are separate texts of one document: their numbers add up. With nothing
    to learn from, each token's probability is that of the unknown. Other columns are not read."""
    spark = docs.sparkSession
    remainder = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % fold
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), (remainder == held).alias("held_out"))
    train = ~F.col("held_out")
    kind = docs.schema["id"].dataType.simpleString()
    with Workspace(spark, "language-model") as work:
        def named(batches):
            for batch in batches:
                texts = Texts(batch.column(0))
                hashes = slice_hashes(texts.data, texts.offsets[:-1], texts.offsets[1:])
                yield pa.record_batch({"piece": batch.column(0), "n": batch.column(1), "h": pa.array(hashes.view(np.int64))})

        unigrams = work.table(piece_counts(docs, "text", _cut, train).mapInArrow(named, "piece string, n long, h long"), "unigrams")
        n_texts = docs.filter(train).count()
        n_words, distinct = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        total, kinds = n_words + n_texts, distinct + (1 if n_texts else 0)
        alphabet = None
        if states is not None:
            top = unigrams.orderBy(F.desc("n"), "piece").limit(states - 1).select("h").toArrow().column(0).to_numpy()
            alphabet = spark.sparkContext.broadcast(np.append(top, END))

        head_words = _upper(unigrams, head).orderBy(F.desc("n"), "piece").limit(head).select("h").toArrow().column(0).to_numpy()
        places = spark.sparkContext.broadcast(Known(pa.table({"h": np.append(head_words, END)})))
        buckets = int(n_words // BUCKET_TOKENS) | 1

        def pairs(batches):
            for batch, _ in blocks(batches, "text"):
                if rows := counted(batch.column(0)):
                    yield pa.RecordBatch.from_pylist(rows, packed)

        def counted(column):
            texts, starts, ends, first = _cut(column)
            history, word, _ = _pairs(slice_hashes(texts.data, starts, ends), first)
            del texts, starts, ends
            if alphabet is not None:
                both = np.isin(history, alphabet.value) & np.isin(word, alphabet.value)
                history, word = history[both], word[both]
                found, found_b = places.value.find(history), places.value.find(word)
                key = _key(history, word, found, found_b)
            else:
                key, _, _ = _text_keys(history, word, places.value)
            order = np.argsort(key)
            ordered = key[order]
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else order
            key, where, n = ordered[first], order[first], np.diff(np.append(first, len(key)))
            rows = []
            for bucket, at in _by_bucket(key, buckets):
                rare = where[at[key[at] < 0]]
                rows.append({"bucket": bucket, "size": len(at), "pairs": _pack(np.diff(key[at], prepend=np.int64(0)), n[at]), "rare": _pack(history[rare], word[rare])})
            return rows

        def merge(table):
            found = []
            for size, data, rare in zip(*(table.column(c) for c in ("size", "pairs", "rare"))):
                key, n = _unpack(data.as_py(), size.as_py(), 2)
                key = np.cumsum(key)
                found.append((key, n, *_unpack(rare.as_py(), int((key < 0).sum()), 2)))
            key, n, rare_a, rare_b = (np.concatenate(c) for c in zip(*found))
            del found
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
            sums = np.add.reduceat(n[order], first)
            often = sums >= least
            at = order[first[often]]
            a, b = _words_of(key, at, rare_a, rare_b, places.value.key)
            return pa.table({"a": a, "b": b, "n": sums[often]})

        packed = pa.schema([("bucket", pa.int32()), ("size", pa.int32()), ("pairs", pa.binary()), ("rare", pa.binary())])
        seen = work.table(docs.filter(train).select("text").mapInArrow(pairs, "bucket int, size int, pairs binary, rare binary")
                          .groupBy("bucket").applyInArrow(merge, "a long, b long, n long"), "pairs")
        # Words with what their failure arc carries: one row on either side of each join key.
        kept = F.greatest(F.col("n") - discount, F.lit(0.0))
        end_row = spark.range(1 if n_texts else 0).select(F.lit(None).cast("string").alias("piece"), F.lit(n_texts).cast("long").alias("n"), F.lit(END).alias("h"))
        given = seen.groupBy(F.col("a").alias("h")).agg(F.sum(kept).alias("given"))
        rest = F.greatest(F.lit(1e-12), F.least(F.lit(1.0), 1 - F.coalesce("given", F.lit(0.0)) / F.col("n")))
        words = work.table(unigrams.unionByName(end_row).join(given, "h", "left").select("piece", "h", "n", rest.alias("rest")), "words")
        frequent = Known(words.join(F.broadcast(spark.createDataFrame(pa.table({"h": places.value.key}))), "h", "left_semi").select("h", "n", "rest").toArrow())
        learnt = n_texts > 0
        log_unknown = -np.log10(total + kinds + 1)
        frequent = frequent.aligned(places.value.key)  # a word's place is its row
        frequent.values += [np.log10(frequent.values[0] + 1.0) + log_unknown, np.log10(frequent.values[1])]  # n, rest and their logarithms
        known = spark.sparkContext.broadcast(frequent)

        def look_up(batches):
            for batch in batches:
                here, at = known.value.find(batch.column(0).to_numpy())
                here_b, at_b = known.value.find(batch.column(1).to_numpy())
                yield pa.record_batch({
                    "a": batch.column(0), "b": batch.column(1), "n": batch.column(2),
                    "visits": pa.array(known.value.value(0, here, at, 0).astype(np.int64), mask=~here), "rest": pa.array(known.value.value(1, here, at, 0.0), mask=~here),
                    "c": pa.array(known.value.value(0, here_b, at_b, 0).astype(np.int64), mask=~here_b)})

        # Only arcs of rare words are joined with them, and those of one rare word are few.
        arcs = work.table(seen.mapInArrow(look_up, "a long, b long, n long, visits long, rest double, c long"), "looked-up")
        arcs = arcs.filter("visits is not null").unionByName(
            arcs.filter("visits is null").drop("visits", "rest").join(words.select(F.col("h").alias("a"), F.col("n").alias("visits"), "rest"), "a"))
        arcs = arcs.filter("c is not null").unionByName(
            arcs.filter("c is null").drop("c").join(words.select(F.col("h").alias("b"), F.col("n").alias("c")), "b"))
        root = (F.col("c") + 1.0) / F.lit(float(total + kinds + 1))
        gain = F.log10(kept / F.col("visits") + F.col("rest") * root) - F.log10("rest") - F.log10(root)

        def keyed(batches):
            for batch in batches:
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                yield pa.record_batch({"key": pa.array(_key(a, b, places.value.find(a), places.value.find(b))), "n": batch.column(2), "gain": batch.column(3)})

        arcs = work.table(arcs.select("a", "b", "n", gain.alias("gain")).mapInArrow(keyed, "key long, n long, gain double"), "arcs")
        for name in ("unigrams", "pairs", "looked-up"):  # read no more
            work.delete(work.path(name))
        hot = spark.sparkContext.broadcast(Known(_most_frequent(arcs, arcs_head).select("key", "gain").toArrow()))
        end = words.filter(F.col("h") == END).first()
        end_log, end_fail = float(np.log10(n_texts + 1.0) + log_unknown), float(np.log10(end.rest)) if end else 0.0

        def score(batches):
            number = TaskContext.get().partitionId() << 33
            for batch, _ in blocks(batches, "text"):
                yield from scored_block(batch, number)
                number += batch.num_rows

        def scored_block(batch, number):
            texts, starts, ends, first = _cut(batch.column(1))
            doc, hashes = run_ids(first), slice_hashes(texts.data, starts, ends)
            key, here, at, which, hit, taken = found_arcs(hashes, first, texts.count)
            here &= learnt
            base = np.bincount(doc, known.value.value(2, here, at, 0.0), minlength=texts.count) + end_log
            fail = np.bincount(doc, known.value.value(3, here, at, 0.0), minlength=texts.count)
            n_known = np.bincount(doc, here, minlength=texts.count).astype(np.int64)
            del at
            yield filled({
                "doc": pa.array(number + np.arange(texts.count)), "id": batch.column(0), "held_out": batch.column(2),
                "n_tokens": pa.array(np.diff(first) + 1, pa.int64()), "n_known": pa.array(n_known + learnt, pa.int64()),
                "base_score": pa.array(base), "score": pa.array(base + end_fail + fail + taken),
                "rare": rare_pieces(texts, starts, ends, hashes, doc, ~here),
            }, texts.count, batch.column(0).type)
            del texts, starts, ends, hashes, doc, here
            if learnt:
                key, which, n = _distinct_pairs(key[~hit], which[~hit])
                parts = [(b, len(at), _pack(np.diff(key[at], prepend=np.int64(0)), which[at], n[at])) for b, at in _by_bucket(key, buckets)]
                if parts:
                    bucket, size, data = zip(*parts)
                    yield filled({"doc": pa.array([number] * len(parts), pa.int64()), "bucket": pa.array(bucket, pa.int32()), "size": pa.array(size, pa.int32()), "pairs": pa.array(data, pa.binary())},
                                 len(parts), batch.column(0).type)

        def found_arcs(hashes, first, count):
            """The key of each token's pair and its text, which words have a place and which place, whether the
            pair is in the broadcast, and the sum of the broadcast's gains for each text."""
            history, word, which = _pairs(hashes, first)
            key, here, at = _text_keys(history, word, places.value)
            own = np.arange(len(hashes)) + run_ids(first)  # the words among the tokens, without the ends
            here, at = here[own], at[own]
            del history, word, own
            hit, place = hot.value.find(key)
            return key, here, at, which, hit, np.bincount(which, hot.value.value(0, hit, place, 0.0), minlength=count)

        def filled(columns, rows, id_type):
            return pa.record_batch({name: columns[name] if name in columns else pa.nulls(rows, type_ or id_type) for name, type_ in layout.items()})

        def gains(blocks_of_pairs, arcs_there):
            found = Known(arcs_there.select(["key", "gain"]))
            rows = []
            for number, size, data in zip(*(blocks_of_pairs.column(c).to_pylist() for c in ("doc", "size", "pairs"))):
                key, which, n = _unpack(data, size, 3)
                here, at = found.find(np.cumsum(key))
                if here.any():
                    there, sums = _sum_within(which[here], n[here] * found.values[0][at[here]])
                    rows.append({"block": number, "size": len(there), "sums": _pack(there, sums.view(np.int64))})
            return pa.Table.from_pylist(rows, gained_rows)

        def add_up(table):
            parts = [_unpack(data, size, 2) for size, data in zip(table.column("size").to_pylist(), table.column("sums").to_pylist())]
            there, sums = _sum_within(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].view(np.float64) for p in parts]))
            return pa.table({"doc": table.column("block")[0].as_py() + there, "score": sums})

        gained_rows = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("sums", pa.binary())])
        layout = {
            "doc": pa.int64(), "id": None, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(),
            "rare": pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())])), "bucket": pa.int32(), "size": pa.int32(), "pairs": pa.binary(),
        }
        # Texts, and the pairs of each block of them whose arcs are not in the broadcast. A block's texts are numbered on from `doc`.
        written = work.table(docs.select("id", "text", "held_out").mapInArrow(
            score, f"doc long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<piece: string, n: long>>, bucket int, size int, pairs binary"), "documents")
        scored = written.filter("bucket is null").select("doc", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare")
        log = F.col("n") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0) + F.lit(float(log_unknown)))
        fail = F.col("n") * F.log10(F.coalesce(F.col("rest"), F.lit(1.0)))
        rare = (
            scored.select("doc", F.explode("rare").alias("r")).select("doc", "r.piece", "r.n")
            .join(words.select("piece", F.col("n").alias("c"), "rest"), "piece", "left")
            .groupBy("doc").agg(F.sum(log).alias("base_score"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(log + fail).alias("score"))
        )
        gained = (
            written.filter("bucket is not null").select("bucket", "doc", "size", "pairs").groupBy("bucket")
            .cogroup(arcs.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key", "gain").groupBy("bucket"))
            .applyInArrow(gains, "block long, size int, sums binary").groupBy("block").applyInArrow(add_up, "doc long, score double")
        )
        columns = ("n_tokens", "n_known", "base_score", "score")
        summed = (
            scored.drop("rare").unionByName(rare, allowMissingColumns=True).unionByName(gained, allowMissingColumns=True)
            .groupBy("doc").agg(F.first("id", ignorenulls=True).alias("id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in columns])
            .groupBy("id", "held_out").agg(*[F.sum(c).alias(c) for c in columns])
        )
        result = work.keep(summed.select(
            F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score"))
        for broadcast in (known, hot, places):
            broadcast.unpersist()
        return result
