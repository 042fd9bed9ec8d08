"""Counts of all distinct pieces of a corpus, and their use for every document without moving
every document's pieces: frequent pieces are looked up in a bounded broadcast, rare ones joined."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.text import Texts, blocks, distinct_within, lists, slice_hashes, string_array

#: Pieces in the broadcast lookup: at most so many times 24 bytes, whatever the corpus.
HEAD = 1 << 18

Cutter = Callable[[pa.Array], tuple[Texts, np.ndarray, np.ndarray, np.ndarray]]


def piece_counts(docs: DataFrame, text: str, cutter: Cutter, counted: Column | None = None) -> DataFrame:
    """(piece, n): how often each distinct piece occurs in the texts, in those marked by
    `counted` if given. Blocks are summed before the shuffle, tasks again by Spark."""
    rows = docs.select(F.col(text).alias("text"))
    if counted is not None:
        rows = docs.filter(counted).select(F.col(text).alias("text"))

    def run(batches):
        for batch, _ in blocks(batches, "text"):
            texts, starts, ends, _ = cutter(batch.column(0))
            _, where, n = np.unique(slice_hashes(texts.data, starts, ends), return_index=True, return_counts=True)
            yield pa.record_batch({"piece": string_array(texts.data, starts[where], ends[where]), "n": pa.array(n, pa.int64())})

    return rows.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Head:
    """The most frequent pieces by hash, with a number each."""

    def __init__(self, table: DataFrame, value: str, size: int = HEAD):
        top = table.orderBy(F.desc("n"), "piece").limit(size).select("piece", value).toArrow()
        texts = Texts(top.column("piece"))
        hashes = slice_hashes(texts.data, texts.offsets[:-1], texts.offsets[1:])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = top.column(value).to_numpy()[order]
        self.ranks = order  # place by frequency

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these are here, and where (0 for the others)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        here = self.hashes[at] == hashes
        return here, np.where(here, at, 0)


def rare_pieces(texts: Texts, starts, ends, hashes, doc, rare) -> pa.ListArray:
    """For each text its rare pieces, once each, with their frequency there."""
    at = np.flatnonzero(rare)
    first, n = distinct_within(doc[at], hashes[at])
    chosen = at[first]
    pieces = string_array(texts.data, starts[chosen], ends[chosen])
    offsets = np.searchsorted(doc[chosen], np.arange(texts.count + 1))
    return lists(offsets, pa.StructArray.from_arrays([pieces, pa.array(n, pa.int64())], ["piece", "n"]))


