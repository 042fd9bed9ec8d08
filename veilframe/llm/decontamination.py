"""Benchmark items in training texts, also edited ones: n-gram seeds, then Smith-Waterman.

Seeds are the items' word n-grams, all of them, however common: a seed is common also where the
corpus holds many copies of an item. One pass looks them up in every text. Where seeds of an item
stand, the words around them that the item has too are counted: an alignment cannot match more. Only
if these could reach the threshold are the words aligned with the item's; the local alignment's score
over the item's best possible one is the match's score. Items come in blocks of bounded size, each
sent to all tasks, so texts are never shuffled and the benchmark may have any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.store import Workspace
from veilframe.llm.text import Texts, blocks, gram_hashes, mix, run_ids, slice_hashes

GRAM = 3
#: Share of an item's best score that makes a match.
THRESHOLD = 0.5
#: Bytes of item texts that are sent to tasks at once.
ITEM_BYTES = 8 << 20
#: Seeds, and words around them, that are looked at together (one text's seeds in any case).
TOGETHER = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words are runs of letters, digits and bytes beyond ASCII.
_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.lowered()
    starts, ends, first = texts.words(_BREAKS)
    return slice_hashes(texts.data, starts, ends), first


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment, and the first and last word it covers."""
    n = len(words)
    if not n or not len(item):
        return 0, 0, -1
    slope = -GAP * np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, first, last = 0, 0, -1
    for word in item:
        diagonal = row[:-1] + np.where(words == word, MATCH, MISMATCH)
        up = row[1:] + GAP
        new, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diagonal > 0
        new[1:][take], origin[1:][take] = diagonal[take], begin[:-1][take]
        take = up > new[1:]
        new[1:][take], origin[1:][take] = up[take], begin[1:][take]
        # From the left: the best start of a gap so far, less the gap.
        raised = new + slope
        peak = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == peak, np.arange(n + 1), 0))
        row, begin = peak - slope, origin[source]
        j = int(row.argmax())
        if row[j] > best:
            best, first, last = int(row[j]), int(begin[j]), j - 1
    return best, first, last


class Items:
    """Some items: their words, and their seeds sorted by hash."""

    def __init__(self, ids: list[int], texts: pa.Array, gram: int):
        words, first = _words(Texts(texts))
        self.ids = np.array(ids, dtype=np.int64)
        self.words = [words[a:b] for a, b in zip(first, first[1:])]
        seed, item, place = [], [], []
        for k, own in enumerate(self.words):
            grams = gram_hashes(own, gram) if len(own) >= gram else np.zeros(0, np.uint64)
            seed.append(grams)
            item.append(np.full(len(grams), k))
            place.append(np.arange(len(grams)))
        self.sizes = np.array([len(own) for own in self.words], dtype=np.int64)
        seeds = np.concatenate(seed or [np.zeros(0, np.uint64)])
        order = np.argsort(seeds, kind="stable")
        self.seed, self.item, self.place = seeds[order], np.concatenate(item or [np.zeros(0, int)])[order], np.concatenate(place or [np.zeros(0, int)])[order]
        every = np.concatenate(self.words or [np.zeros(0, np.uint64)])
        self.pairs, self.times = np.unique(_in_item(np.repeat(np.arange(len(ids)), self.sizes), every), return_counts=True)
        self.marks = np.zeros(1 << 20, dtype=bool)  # by low bits, so most grams need no search
        self.marks[self.seed & np.uint64(0xFFFFF)] = True

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Places of grams that are seeds."""
        at = np.flatnonzero(self.marks[grams & np.uint64(0xFFFFF)])
        if not len(at) or not len(self.seed):
            return at[:0]
        low = np.minimum(np.searchsorted(self.seed, grams[at]), len(self.seed) - 1)
        return at[self.seed[low] == grams[at]]

    def regions(self, at: np.ndarray, grams: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, first word, word behind the last) of stretches that may hold an item."""
        low, high = np.searchsorted(self.seed, grams[at]), np.searchsorted(self.seed, grams[at], side="right")
        which, seed = _spread(low, high)
        text, item, begin = doc[at[which]], self.item[seed], at[which] - self.place[seed]
        order = np.lexsort((begin, item, text))
        text, item, begin = text[order], item[order], begin[order]
        new = np.ones(len(begin), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(begin) > self.sizes[item[1:]])
        one = np.flatnonzero(new)
        last = np.append(one[1:], len(begin))[:len(one)] - 1
        text, item, size = text[one], item[one], self.sizes[item[one]]
        return text, item, np.maximum(begin[one] - size // 2, first[text]), np.minimum(begin[last] + size + size // 2, first[text + 1])

    def common_words(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray) -> np.ndarray:
        """How many words each stretch has in common with its item; no alignment matches more."""
        region, at = _spread(low, high)
        pair = _in_item(item[region], words[at])
        known = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        here = self.pairs[known] == pair
        both, n = np.unique(region[here] * len(self.pairs) + known[here], return_counts=True)
        return np.bincount(both // len(self.pairs), np.minimum(n, self.times[both % len(self.pairs)]), minlength=len(item))

    def candidates(self, at: np.ndarray, words: np.ndarray, grams: np.ndarray, doc: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, word behind the last) of all stretches whose alignment could
        reach the threshold; at: the places of all grams that are seeds."""
        uses = np.searchsorted(self.seed, grams[at], side="right") - np.searchsorted(self.seed, grams[at])
        for a, z in _parts(uses, doc[at]):
            text, item, low, high = self.regions(at[a:z], grams, doc, first)
            for b, y in _parts(high - low, np.arange(len(low))):
                enough = self.common_words(item[b:y], low[b:y], high[b:y], words) / self.sizes[item[b:y]] >= threshold
                for r in (b + np.flatnonzero(enough)).tolist():
                    yield int(text[r]), int(item[r]), int(low[r]), int(high[r])


def _in_item(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash for each word of an item."""
    return mix(words ^ (item + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each low to before its high, behind the index of that range."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]


def _parts(size: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about TOGETHER by size that cut no group; groups are in order."""
    if not len(size):
        return
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    before = np.append(0, np.cumsum(size))[begins] // TOGETHER
    cuts = [*begins[np.flatnonzero(np.append(True, before[1:] != before[:-1]))].tolist(), len(size)]
    yield from zip(cuts, cuts[1:])


def _texts_and_grams(batches, gram: int):
    for batch, texts in blocks(batches, "text"):
        words, first = _words(texts)
        grams = gram_hashes(words, gram)
        doc = run_ids(first)[:len(grams)]
        inside = np.arange(len(grams)) + gram <= first[doc + 1] if len(grams) else np.zeros(0, bool)
        yield batch, words, first, grams, doc, inside


def _blocks_of(items: DataFrame) -> int:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return -(-total // ITEM_BYTES) or 1


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(id, item, score, first_word, last_word): every item that a text holds, its best place
    there (word numbers; words are runs of letters and digits), and the alignment's score from
    `threshold` to 1.

    Texts and items that are null, empty or shorter than `gram` words match nothing. Items with a
    null id, and texts with one, match like others. Of rows alike in id the best match counts.
    An empty table matches nothing. Other columns are not read."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item long, score double, first_word long, last_word long"
    parts = _blocks_of(items)
    with Workspace(spark, "decontamination") as work:
        found = []
        for part in range(parts):
            own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).orderBy("item", "text").toArrow()
            if not own.num_rows:
                continue
            block = Items([i if i is not None else -1 for i in own.column("item").to_pylist()], own.column("text").combine_chunks(), gram)
            known = own.column("item").is_valid().to_pylist()
            look = spark.sparkContext.broadcast((block, known))

            def match(batches, seeds=look):
                some, known = seeds.value
                for batch, words, first, grams, doc, inside in _texts_and_grams(batches, gram):
                    at = some.find(grams)
                    at = at[inside[at]]
                    rows: list[list] = [[], [], [], [], []]
                    best: dict[tuple[int, int], tuple[float, int, int]] = {}
                    for d, k, low, high in some.candidates(at, words, grams, doc, first, threshold):
                        score, begin, end = align(some.words[k], words[low:high])
                        share, a = score / (MATCH * len(some.words[k])), int(first[d])
                        if share >= threshold and share > best.get((d, k), (0.0,))[0]:
                            best[d, k] = (share, low - a + begin, low - a + end)
                    for (d, k), (share, begin, end) in best.items():
                        for column, value in zip(rows, (d, int(some.ids[k]) if known[k] else None, share, begin, end)):
                            column.append(value)
                    yield pa.record_batch({"id": batch.column(0).take(pa.array(rows[0], pa.int64())), "item": pa.array(rows[1], pa.int64()), "score": pa.array(rows[2], pa.float64()),
                                           "first_word": pa.array(rows[3], pa.int64()), "last_word": pa.array(rows[4], pa.int64())})

            found.append(work.table(docs.mapInArrow(match, schema), f"part-{part}"))
            look.unpersist()
        every = spark.createDataFrame([], schema)
        for one in found:
            every = every.unionByName(one)
        best = F.row_number().over(Window.partitionBy("id", "item").orderBy(F.desc("score"), "first_word"))
        return work.keep(every.withColumn("r", best).filter("r = 1").drop("r").withColumnsRenamed({"id": id, "item": item}))
