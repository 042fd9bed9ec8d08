"""Text quality by a convolutional network over bytes, in numpy.

Filters of `WIDTH` bytes are slid over chunks of a text. Chunks overlap by a filter's width, so
every place of the whole text is seen once by every filter. Each chunk keeps a filter's largest
response; a text keeps the largest and the mean over its chunks, and a logistic unit joins them
into one probability. Trained on a bounded sample of labelled texts, whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.store import free_names
from veilframe.llm.text import Texts, blocks
from veilframe.llm.toxicity import drawn_labels

WIDTH = 6
FILTERS = 16
CHUNK = 256
#: Labelled texts that are learnt from at most.
SAMPLE = 3000
EPOCHS = 8
THRESHOLD = 0.5
_PART = 512  # chunks worked on at once


def chunked(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each filled up with zeros to whole chunks (by a filter's width at least),
    and the first chunk of each text."""
    sizes = np.diff(texts.offsets)
    count = -(-(sizes + WIDTH) // CHUNK)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] * CHUNK + WIDTH, dtype=np.uint8)
    out[np.arange(len(texts.data)) + np.repeat(first[:-1] * CHUNK - texts.offsets[:-1], sizes)] = texts.data
    return out, first


class ByteNetwork:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.bias = np.float32(0)

    def _pairs(self) -> list[np.ndarray]:
        """Responses of two neighbouring bytes at a time."""
        return [(self.table[k][:, None] + self.table[k + 1][None]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def responses(self, data: np.ndarray, chunk: int, count: int, last: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """Responses (chunk, place, filter) of some chunks; places that reach into another text are
        out of the game. last: whether a chunk is its text's last."""
        begin, n = chunk * CHUNK, count * CHUNK
        part = data[begin:begin + n + WIDTH].astype(np.int32)
        two = part[:-1] * 256 + part[1:]
        r = pairs[0][two[:n]]
        for k in range(1, len(pairs)):
            r += pairs[k][two[2 * k:2 * k + n]]
        r = r.reshape(count, CHUNK, FILTERS)
        r[last, CHUNK - WIDTH + 1:] = -1e9
        return r

    def pooled(self, data: np.ndarray, first: np.ndarray, places: bool = False):
        """Each chunk's largest response per filter, and its place."""
        pairs, total = self._pairs(), int(first[-1])
        last = np.zeros(total, dtype=bool)
        last[first[1:] - 1] = True
        most, where = np.empty((total, FILTERS), np.float32), np.empty((total, FILTERS), np.int64)
        for c in range(0, total, _PART):
            n = min(_PART, total - c)
            r = self.responses(data, c, n, last[c:c + n], pairs)
            if places:
                at = r.argmax(1)
                where[c:c + n] = at + np.arange(c, c + n)[:, None] * CHUNK
                most[c:c + n] = np.take_along_axis(r, at[:, None], 1)[:, 0]
            else:
                most[c:c + n] = r.max(1)
        return np.maximum(most + self.shift, 0), where

    def joined(self, most: np.ndarray, first: np.ndarray) -> np.ndarray:
        peak = np.maximum.reduceat(most, first[:-1], axis=0)
        mean = np.add.reduceat(most, first[:-1], axis=0) / np.diff(first)[:, None]
        return np.concatenate([peak, mean], 1)

    def score(self, texts: Texts) -> np.ndarray:
        if not texts.count:
            return np.zeros(0)
        data, first = chunked(texts)
        raw = self.joined(self.pooled(data, first)[0], first) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(raw.astype(float), -40, 40)))

    def fit(self, column: pa.Array, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, batch: int = 64) -> None:
        """Adam on the logistic loss; the gradient goes through the largest responses alone."""
        rng = np.random.default_rng(13)
        names = ("table", "shift", "out", "bias")
        m = {k: np.zeros_like(getattr(self, k), dtype=np.float64) for k in names}
        v = {k: np.zeros_like(getattr(self, k), dtype=np.float64) for k in names}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(order), batch):
                pick = np.sort(order[s:s + batch])
                data, first = chunked(Texts(column.take(pa.array(pick))))
                most, where = self.pooled(data, first, places=True)
                x = self.joined(most, first)
                error = (1 / (1 + np.exp(-np.clip(x @ self.out + self.bias, -40, 40))) - y[pick]) / len(pick)
                gx = error[:, None] * self.out
                n = np.diff(first)
                doc = np.repeat(np.arange(len(pick)), n)
                peak = most == x[doc, :FILTERS]
                share = np.add.reduceat(peak, first[:-1], axis=0, dtype=np.float64)
                gm = gx[doc, :FILTERS] * peak / share[doc] + (gx[:, FILTERS:] / n[:, None])[doc]
                gm[most <= 0] = 0
                c, f = np.nonzero(gm)
                g = {"table": np.zeros(self.table.shape), "shift": gm.sum(0), "out": x.T @ error + 1e-4 * self.out, "bias": error.sum()}
                for k in range(WIDTH):
                    np.add.at(g["table"][k], (data[where[c, f] + k], f), gm[c, f])
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    now = rate * (1 - epoch / epochs)
                    setattr(self, k, (getattr(self, k) - now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32))


def learn(docs: DataFrame, drawn: DataFrame) -> ByteNetwork:
    """Fit on the texts of the drawn labels (id, y), whose number is bounded."""
    got = docs.join(F.broadcast(drawn), "id").select("id", F.coalesce("text", F.lit("")).alias("text"), "y").orderBy(F.xxhash64("id", "text"), "y").select("text", "y").toArrow()
    network = ByteNetwork()
    if not got.num_rows:
        network.out[:] = 0
    else:
        network.fit(pa.concat_arrays(got.column("text").chunks).cast(pa.large_string()), got.column("y").to_numpy())
    return network


def with_score(docs: DataFrame, network: ByteNetwork, text: str, score: str) -> DataFrame:
    """The same rows and columns, and the network's score of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch, texts in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(texts), pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", fold: int = 3, held: int = 1, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) per row: how likely label 1 is, from the whole text alone.

    Learns from labelled rows whose crc32(id as text) mod `fold` is not `held`, at most `sample` of
    them; a null id counts as the text ''. A null text is empty and is scored as such. Rows that
    share an id are scored each. Null labels teach nothing; without any all scores are 0.5. Other columns are not read."""
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    remainder = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % fold
    scored = with_score(docs, learn(docs, drawn_labels(labels, id, label, fold, held, sample)), "text", "score")
    return scored.select(F.col("id").alias(id), (remainder == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_texts(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", fold: int = 3, held: int = 1, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Rows, with all their columns, whose quality reaches the threshold."""
    drawn = drawn_labels(labels, id, label, fold, held, sample)
    network = learn(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), drawn)
    (score,) = free_names(docs, "_quality")
    return with_score(docs, network, text, score).filter(F.col(score) >= threshold).drop(score)
