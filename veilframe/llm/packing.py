"""Packing of token ids into sequences of fixed length, with the mixture of sources held in every
stretch of them.

Each source is a queue. A queue's deficit grows with its target share of all that has been packed;
when it has grown to half a quantum, one quantum of the queue's tokens is packed and the deficit
falls by a quantum. Queue s with weight w(s) thus packs its quantum k when the common clock shows
(2k + 1) / w(s), and what any queue has packed by then follows in closed form: deficits carry over
every window and partition boundary without a pass over what went before. A queue that has ended
takes no more turns. Every source is a queue of its own. Up to QUEUES of them are a table that every task
holds; with more, the turns of all queues are sorted by the clock and summed up across ranges of it,
and documents get the places of their turns by a join. Sequences are the packed stream cut at every `length` ids: each but the last
is full."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.store import Workspace
from veilframe.llm.text import blocks
from veilframe.llm.vocabulary import append_id, vocabulary

LENGTH = 1024
QUANTUM = 128
#: Sources up to which every task holds the table of all queues.
QUEUES = 256
#: Weights are whole numbers up to this, so the clock is exact in 64 bits for 2 ** 40 quanta a queue.
WEIGHT = 1 << 20


class Mixture:
    """Totals and weights of all queues, ordered by number."""

    def __init__(self, totals: list[int], weights: list[float], quantum: int):
        self.totals = np.array(totals, dtype=np.int64)
        largest = max(weights, default=1) or 1
        self.weights = np.maximum(1, np.round(np.array(weights, dtype=float) / largest * WEIGHT)).astype(np.int64)
        self.quantum = quantum

    def places(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Ids packed before quantum k of the queue."""
        out = np.zeros(len(k), dtype=np.int64)
        own = self.weights[queue]
        for t, (total, weight) in enumerate(zip(self.totals, self.weights)):
            clock = (2 * k + 1) * weight
            whole, rest = clock // own, clock % own
            earlier = np.where(t < queue, (whole + 1) // 2, (whole + (rest > 0)) // 2)
            out += np.minimum(np.where(t == queue, k, earlier) * self.quantum, total)
        return out


#: Turns that one row is expanded into at once.
_RUN = 4096


def _queues(encoded: DataFrame) -> DataFrame:
    """(source, part, base): where the tokens of each source in each part begin in their queue."""
    per_part = encoded.groupBy("source", "part").agg(F.sum("n").alias("n"))
    # A queue's parts: sums per source and part only, a few numbers a task.
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _places(sizes: DataFrame, quantum: int, work: Workspace) -> DataFrame:
    """(source, k, place): ids packed before quantum k of each source, from (source, total, weight)."""
    turns = F.ceil(F.col("total") / quantum).cast("long")
    runs = sizes.select("source", "total", "weight", F.explode(F.sequence(F.lit(0).cast("long"), (turns - 1).cast("long"), F.lit(_RUN).cast("long"))).alias("low"))
    last = F.least(F.col("low") + _RUN, turns) - 1
    # Runs are dealt anew, so that a large source is not expanded in one task.
    quanta = runs.repartition(F.xxhash64("source", "low")).select("source", "total", "weight", F.explode(F.sequence("low", last)).alias("k"))
    quanta = quanta.select("source", "k", ((2 * F.col("k") + 1) / F.col("weight")).alias("clock"), F.least(F.lit(quantum).cast("long"), F.col("total") - F.col("k") * quantum).alias("size"))

    def add_up(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column(2).to_numpy()
            sums = before + np.cumsum(size)
            yield pa.record_batch({"source": batch.column(0), "k": batch.column(1), "range": pa.array([part] * len(size), pa.int32()), "before": pa.array(sums - size), "size": batch.column(2)})
            before = int(sums[-1]) if len(sums) else before

    ordered = quanta.repartitionByRange("clock", "source").sortWithinPartitions("clock", "source").select("source", "k", "size")
    summed = work.table(ordered.mapInArrow(add_up, "source string, k long, range int, before long, size long"), "turns")
    ranges = summed.groupBy("range").agg(F.sum("size").alias("n")).orderBy("range").collect()  # one row a task
    begins = np.cumsum([0, *(r.n for r in ranges)]).tolist()
    offsets = summed.sparkSession.createDataFrame([(r.range, b) for r, b in zip(ranges, begins)], "range int, offset long")
    return summed.join(F.broadcast(offsets), "range").select("source", "k", (F.col("before") + F.col("offset")).alias("place"))


def pack(docs: DataFrame, tokenizer: str, end: int = 0, id: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None, length: int = LENGTH, quantum: int = QUANTUM, queues: int = QUEUES) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset): ids start to
    start + length of a document stand in that sequence from that offset. The ids are the
    tokenizer's for the whole text, then `end`; the crc is of them as little-endian 32-bit numbers.

    targets: shares by source, in any unit; without them, each source's share of the tokens. A
    source that they do not name keeps its share. A null text is empty, a null source the source
    ''. Null ids and rows that share an id stay documents of their own. An empty table packs into
    nothing. Other columns are not read."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def encode(batches):
        part, before = TaskContext.get().partitionId(), {}
        for batch, _ in blocks(batches, "text"):
            ids, bounds = append_id(*vocabulary(tokenizer).encode(batch.column(2)), end)
            n, first = np.diff(bounds), []
            for name, size in zip(batch.column(1).to_pylist(), n.tolist()):
                first.append(before.get(name, 0))
                before[name] = first[-1] + size
            data = ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")
            width = data.itemsize
            yield pa.record_batch({
                "id": batch.column(0), "source": batch.column(1), "part": pa.array([part] * len(n), pa.int32()), "n": pa.array(n, pa.int64()),
                "first": pa.array(first, pa.int64()), "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds * width), pa.py_buffer(data)]).cast(pa.binary()),
            })

    with Workspace(spark, "packing") as work:
        encoded = work.table(docs.mapInArrow(encode, f"id {kind}, source string, part int, n long, first long, ids binary"), "ids")
        bases = work.table(_queues(encoded), "queues")
        sizes = work.table(bases.groupBy("source").agg(F.sum("n").alias("total")), "sizes")
        sources, everything = sizes.agg(F.count("*"), F.sum("total")).first()
        everything, goal = everything or 1, sum((targets or {}).values()) or 1
        mixture, columns = None, ["id", "n", "begin", "ids"]
        placed = encoded.join(F.broadcast(bases.drop("n")) if bases.count() <= 200_000 else bases.drop("n"), ["source", "part"]).withColumn("begin", F.col("base") + F.col("first"))
        if sources <= queues:
            totals = sizes.orderBy("source").collect()  # at most `queues` rows
            weights = [(targets or {}).get(r.source, r.total / everything * goal) for r in totals]
            mixture = spark.sparkContext.broadcast(Mixture([r.total for r in totals], weights, quantum))
            number = F.lit(-1)
            for i, r in enumerate(totals):
                number = F.when(F.col("source") == r.source, i).otherwise(number)
            placed = placed.withColumn("queue", number)
            columns.append("queue")
        else:
            named = spark.createDataFrame(list((targets or {}).items()), "source string, target double")
            share = F.coalesce("target", F.col("total") / everything * goal)
            # A target of nothing comes last, as the least weight does.
            weighted = sizes.join(F.broadcast(named), "source", "left").select("source", "total", F.greatest(share, F.lit(goal * 1e-12)).alias("weight"))
            places = _places(weighted, quantum, work)
            turns = placed.select("source", "begin", F.explode(F.sequence(F.floor(F.col("begin") / quantum), F.floor((F.col("begin") + F.col("n") - 1) / quantum))).alias("k"))
            own = turns.join(places, ["source", "k"]).groupBy("source", "begin").agg(F.sort_array(F.collect_list(F.struct("k", "place"))).alias("places"))
            placed = placed.join(own.select("source", "begin", F.col("places.place").alias("places")), ["source", "begin"])
            columns.append("places")

        def cut(batches):
            for batch in batches:
                names = batch.schema.names
                column = {c: batch.column(i) for i, c in enumerate(names)}
                n = column["n"].to_numpy()
                begin = column["begin"].to_numpy()
                k = begin // quantum
                turns = (begin + n - 1) // quantum - k + 1
                row = np.repeat(np.arange(len(n)), turns)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(turns) - turns, turns) + k[row]
                if mixture is None:
                    place = column["places"].flatten().to_numpy()
                else:
                    place = mixture.value.places(column["queue"].to_numpy().astype(np.int64)[row], turn)
                a = np.maximum(turn * quantum, begin[row])
                z = np.minimum((turn + 1) * quantum, (begin + n)[row])
                place = place + a - turn * quantum
                # Cut again where a sequence ends.
                splits = (place + z - a - 1) // length - place // length + 1
                again = np.repeat(np.arange(len(row)), splits)
                step = np.arange(len(again)) - np.repeat(np.cumsum(splits) - splits, splits)
                sequence = place[again] // length + step
                low = np.maximum(place[again], sequence * length)
                high = np.minimum((place + z - a)[again], (sequence + 1) * length)
                start = a[again] - begin[row[again]] + low - place[again]
                doc = row[again]
                width = 2
                crc = np.zeros(len(doc), dtype=np.int64)
                offsets = np.searchsorted(doc, np.arange(len(n) + 1))
                for d in range(len(n)):
                    raw = column["ids"][d].as_buffer()
                    width = raw.size // int(n[d])
                    data = memoryview(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                    for p in range(offsets[d], offsets[d + 1]):
                        s = 4 * int(start[p])
                        crc[p] = zlib.crc32(data[s:s + 4 * int(high[p] - low[p])])
                yield pa.record_batch({
                    "id": column["id"].take(pa.array(doc)), "start": pa.array(start), "length": pa.array(high - low), "ids_crc32": pa.array(crc),
                    "doc_tokens": pa.array(n[doc]), "sequence_id": pa.array(sequence), "offset": pa.array(low - sequence * length)})

        pieces = placed.select(*columns).mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
        result = work.keep(pieces.withColumnRenamed("id", id))
        if mixture is not None:
            mixture.unpersist()
        return result
