"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the beginnings of words, hashed into a fixed
space. A score is a bias, a weight per term, and an inner product of learned factors for each two
terms of the text, so that terms which are harmless alone can count together. Labelled texts (a
bounded sample of them) decide which terms tell the classes apart; only these have weights, so the
length of a text does not move its score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.text import Texts, blocks, distinct_within, run_ids, slice_hashes

#: Hashed terms.
SPACE_BITS = 20
#: Beginnings of words that are terms too, in bytes.
PREFIXES = (4, 6, 8, 9)
FACTORS = 8
#: Labelled texts that are learnt from at most, drawn by a hash of id and text.
SAMPLE = 8000
#: Standard errors by which a term must differ between the classes.
CLEAR = 4.0
EPOCHS = 40
THRESHOLD = 0.7


def terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, and where each text's begin."""
    texts = texts.lowered()
    starts, ends, first = texts.words()
    # Punctuation at the end of a word is no part of it.
    mark = np.isin(texts.data, np.frombuffer(b".,;:!?\"'()[]{}|*%$#&", np.uint8))
    for _ in range(3):
        ends = np.where((ends - starts > 1) & mark[ends - 1], ends - 1, ends)
    doc = run_ids(first)
    run, key = [doc], [slice_hashes(texts.data, starts, ends)]
    for size in PREFIXES:
        at = np.flatnonzero(ends - starts > size)
        run.append(doc[at])
        key.append(slice_hashes(texts.data, starts[at], starts[at] + size) ^ np.uint64(size))
    run, key = np.concatenate(run), np.concatenate(key) >> np.uint64(64 - SPACE_BITS)
    chosen, _ = distinct_within(run, key)
    return key[chosen].astype(np.int64), np.searchsorted(run[chosen], np.arange(texts.count + 1))


class FactorizationMachine:
    """bias + sum of weights + sum over pairs of the inner products of their factors."""

    def __init__(self, kept: np.ndarray, size: int):
        self.place = np.full(size, -1, dtype=np.int32)
        self.place[kept] = np.arange(len(kept))
        self.bias, self.weight = 0.0, np.zeros(len(kept))
        self.factor = np.random.default_rng(7).normal(0, 0.02, (len(kept), FACTORS))

    def rows(self, keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms that have weights, and the text each is of."""
        at = self.place[keys]
        here = at >= 0
        return at[here], run_ids(offsets)[here]

    def raw(self, at: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        sums, squares = np.zeros((n, FACTORS)), np.zeros(n)
        np.add.at(sums, doc, self.factor[at])
        np.add.at(squares, doc, (self.factor[at] ** 2).sum(1))
        linear = np.bincount(doc, self.weight[at], minlength=n)
        return self.bias + linear + 0.5 * ((sums ** 2).sum(1) - squares), sums

    def score(self, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at, doc = self.rows(keys, offsets)
        return 1 / (1 + np.exp(-np.clip(self.raw(at, doc, len(offsets) - 1)[0], -40, 40)))

    def fit(self, keys: np.ndarray, offsets: np.ndarray, y: np.ndarray, rate: float = 0.1, decay: float = 1e-4) -> None:
        """Gradient steps on the logistic loss, each coordinate with its own shrinking rate."""
        at, doc = self.rows(keys, offsets)
        begin = np.searchsorted(doc, np.arange(len(y) + 1))
        rng = np.random.default_rng(11)
        seen_w, seen_f, seen_b = np.full(len(self.weight), 1e-8), np.full(self.factor.shape, 1e-8), 1e-8
        share = max(y.mean(), 1e-6)
        self.bias = float(np.log(share / max(1 - share, 1e-6)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for s in range(0, len(order), 256):
                batch = order[s:s + 256]
                sizes = begin[batch + 1] - begin[batch]
                pick = np.arange(sizes.sum()) + np.repeat(begin[batch] - np.cumsum(sizes) + sizes, sizes)
                a, d = at[pick], np.repeat(np.arange(len(batch)), sizes)
                raw, sums = self.raw(a, d, len(batch))
                error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[batch]) / len(batch)
                g = np.bincount(a, error[d], minlength=len(self.weight)) + decay * self.weight
                gf = np.zeros_like(self.factor)
                np.add.at(gf, a, error[d, None] * (sums[d] - self.factor[a]))
                gf += decay * self.factor
                seen_w += g ** 2
                seen_f += gf ** 2
                seen_b += error.sum() ** 2
                self.weight -= rate * g / np.sqrt(seen_w)
                self.factor -= rate * gf / np.sqrt(seen_f)
                self.bias -= rate * error.sum() / np.sqrt(seen_b)


def clear_terms(keys: np.ndarray, offsets: np.ndarray, y: np.ndarray, clear: float) -> np.ndarray:
    """Terms in at least three texts whose share of positive ones differs from the whole by
    `clear` standard errors."""
    size = 1 << SPACE_BITS
    n = np.bincount(keys, minlength=size)
    hit = np.bincount(keys, y[run_ids(offsets)], minlength=size)
    share = y.mean() if len(y) else 0.0
    spread = np.sqrt(np.maximum(n * share * (1 - share), 1e-12))
    return np.flatnonzero((n >= 3) & (np.abs(hit - n * share) > clear * spread))


def drawn_labels(labels: DataFrame, id: str, label: str, fold: int, held: int, sample: int) -> DataFrame:
    """(id, y) of at most `sample` labelled rows outside the held-out fold: those whose ids have
    the smallest hashes."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(label).cast("double").alias("y"))
    return known.filter(F.crc32(F.col("id").cast("string").cast("binary")) % fold != held).orderBy(F.xxhash64("id"), "id", "y").limit(sample)


def learn(docs: DataFrame, drawn: DataFrame, clear: float = CLEAR) -> FactorizationMachine:
    """Fit on the texts of the drawn labels, whose number is bounded. Terms are made by tasks;
    only hashed terms of the sample come to the driver."""

    def make(batches):
        for batch, texts in blocks(batches, "text"):
            keys, offsets = terms(texts)
            yield pa.record_batch({"y": batch.column(1), "terms": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.int32()))})

    got = docs.join(F.broadcast(drawn), "id").select("text", "y").mapInArrow(make, "y double, terms array<int>").toArrow()
    y = got.column("y").to_numpy()
    flat = got.column("terms").combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    keys = flat.flatten().to_numpy().astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    model = FactorizationMachine(clear_terms(keys, offsets, y, clear), 1 << SPACE_BITS)
    if len(y):
        model.fit(keys, offsets, y)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fold: int = 3, held: int = 1, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) per row: how likely label 1 is, from the whole text alone.

    Learns from labelled rows whose crc32(id as text) mod `fold` is not `held`; a null id counts
    as the text ''. A null text is empty; a text without telling terms has the score of the bias.
    Rows that share an id are scored each; a null or repeated label row teaches what it says.
    Without labels all scores are 0.5. Other columns are not read."""
    remainder = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % fold
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), (remainder == held).alias("held_out"))
    drawn = drawn_labels(labels, id, label, fold, held, sample)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.select("id", "text"), drawn))
    kind = docs.schema["id"].dataType.simpleString()

    def score(batches):
        for batch, texts in blocks(batches, "text"):
            s = model.value.score(*terms(texts))
            yield pa.record_batch({"id": batch.column(0), "held_out": batch.column(2), "score": pa.array(s), "predicted": pa.array(s >= threshold).cast(pa.int32())})

    return docs.mapInArrow(score, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id)
