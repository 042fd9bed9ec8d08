"""Packing of whole documents into as few sequences as possible, by lengths alone.

Which documents share a sequence is a question of lengths only, so the plan is made from the number
of pieces of each length: at most `capacity` numbers, whatever the corpus. Pieces above a third of a
sequence meet at most in twos; the longest is matched with the longest that fits beside it, for all
pieces of both lengths at once, which gives the most pairs. Shorter lengths follow in falling
order, each into the smallest gap that holds it. The result is a list of runs: pieces number r to
s of a length go to sequences from q on, k each, from some offset. A length splits at most one
gap's sequences that it does not fill up, so runs are bounded by the capacity, not by the data.

Pieces get their number within their length from counts by task and length, and look their run up.
No piece is compared with another."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.store import Workspace
from veilframe.llm.text import blocks
from veilframe.llm.vocabulary import append_id, vocabulary

CAPACITY = 2048
#: Rows (task, length) up to which the numbers where they begin are broadcast: some 30 MB as a hash table.
_BROADCAST_ROWS = 200_000


class Plan:
    """Runs (length, first, sequence, each, offset): pieces from number `first` of that length go to
    sequences from `sequence` on, `each` to one, the first of them at `offset`."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.left = {length: n for length, n in counts.items() if n}
        self.used = dict.fromkeys(self.left, 0)
        self.gaps: list[int] = []  # ascending
        self.at: dict[int, list[tuple[int, int]]] = {}  # by gap: first sequence and how many
        self.runs: list[tuple[int, int, int, int, int]] = []
        self._match()
        self._fill()
        self.runs.sort()
        table = np.array(self.runs, dtype=np.int64).reshape(-1, 5)
        self.length, self.first, self.sequence, self.each, self.offset = table.T
        self.begin = np.searchsorted(self.length, np.arange(capacity + 2))

    def _open(self, gap: int, sequence: int, n: int) -> None:
        if not gap or not n:
            return
        if gap not in self.at:
            insort(self.gaps, gap)
        self.at.setdefault(gap, []).append((sequence, n))

    def _take(self, gap: int) -> tuple[int, int]:
        some = self.at[gap].pop()
        if not self.at[gap]:
            del self.at[gap]
            del self.gaps[bisect_left(self.gaps, gap)]
        return some

    def _put(self, length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, self.used[length], sequence, each, offset))
        self.used[length] += pieces
        self.left[length] -= pieces

    def _match(self) -> None:
        """Pieces longer than a third, longest first, each with the longest that fits beside it."""
        large = sorted((x for x in self.left if 3 * x > self.capacity), reverse=True)
        for i, x in enumerate(large):
            for y in large[i:]:
                if not self.left[x]:
                    break
                if x + y > self.capacity:
                    continue
                pairs = self.left[x] // 2 if x == y else min(self.left[x], self.left[y])
                if pairs and x == y:  # one of each pair in front
                    self._put(x, pairs, self.sequences, 1, 0)
                    self._put(x, pairs, self.sequences, 1, x)
                elif pairs:
                    self._put(x, pairs, self.sequences, 1, 0)
                    self._put(y, pairs, self.sequences, 1, x)
                self._open(self.capacity - x - y, self.sequences, pairs)
                self.sequences += pairs
            alone = self.left[x]
            if alone:
                self._put(x, alone, self.sequences, 1, 0)
                self._open(self.capacity - x, self.sequences, alone)
                self.sequences += alone

    def _fill(self) -> None:
        """Shorter pieces, longest first, each into the smallest gap that holds it."""
        for x in sorted((x for x in self.left if 3 * x <= self.capacity), reverse=True):
            while self.left[x]:
                at = bisect_left(self.gaps, x)
                if at == len(self.gaps):
                    fresh = -(-self.left[x] // (self.capacity // x))
                    self._open(self.capacity, self.sequences, fresh)
                    self.sequences += fresh
                    continue
                gap = self.gaps[at]
                sequence, n = self._take(gap)
                each = min(gap // x, self.left[x])
                filled = min(n, self.left[x] // each)
                self._put(x, filled * each, sequence, each, self.capacity - gap)
                self._open(gap - each * x, sequence, filled)
                self._open(gap, sequence + filled, n - filled)

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and numbers within them."""
        # Runs are sorted by length and first number; numbers are below 2 ** 50.
        key = (self.length << 50) + self.first
        run = np.searchsorted(key, (length.astype(np.int64) << 50) + number, side="right") - 1
        step = number - self.first[run]
        return self.sequence[run] + step // self.each[run], self.offset[run] + step % self.each[run] * length


def _cuts(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of n ids each: text, number within it, and start of each piece. All pieces but a
    text's first are full."""
    pieces = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = (n - 1) % capacity + 1
    return row, piece, np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)


def best_fit(docs: DataFrame, tokenizer: str, end: int = 0, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces (id, piece, start, length, ids, sequence_id, offset): these ids (binary, 32-bit
    little-endian) of the document, from its id number `start` on, stand in that sequence from that
    offset. The ids are the tokenizer's for the whole text, then `end`. Only documents of more than
    `capacity` ids are cut: their first piece is what is left over by full ones.

    A null text is empty and so has one id. Rows with a null id or one that others have stay
    documents of their own. A very long text is many full pieces. An empty table packs into nothing.
    Ties among pieces of one length are settled by the order in which tasks read them. Other columns
    are not read."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def encode(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch, _ in blocks(batches, "text"):
            ids, bounds = append_id(*vocabulary(tokenizer).encode(batch.column(1)), end)
            row, piece, start = _cuts(np.diff(bounds), capacity)
            edges = np.append(bounds[row] + start, bounds[-1])
            length = np.diff(edges)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(length), dtype=np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered)
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(edges * 4), pa.py_buffer(ids.astype("<u4"))])
            yield pa.record_batch({
                "id": batch.column(0).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length),
                "part": pa.array([part] * len(row), pa.int32()), "rank": pa.array(rank), "ids": raw.cast(pa.binary())})

    work = Workspace(spark, "best-fit")
    pieces = work.keep(docs.mapInArrow(encode, f"id {kind}, piece int, start long, length long, part int, rank long, ids binary"), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # One row a task in each length: numbers, not pieces.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = work.keep(per_part.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "bases")
    counts = bases.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(Plan({r.length: r.n for r in counts}, capacity))
    begin = bases.drop("n")
    numbered = pieces.join(F.broadcast(begin) if bases.count() <= _BROADCAST_ROWS else begin, ["length", "part"])

    def place(batches):
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            sequence, offset = plan.value.places(length, batch.column(names.index("number")).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names[:-1], "sequence_id", "offset"])

    columns = ["id", "piece", "start", "length", "ids"]
    placed = numbered.select(*columns, (F.col("base") + F.col("rank")).alias("number")).mapInArrow(
        place, f"id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of each sequence in a row, as 32-bit little-endian
    numbers. A sequence is never longer than its capacity, so its pieces fit one row."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda before, p: F.concat(before, p["ids"]))
    return parts.select("sequence_id", "n_tokens", joined.alias("ids"))
