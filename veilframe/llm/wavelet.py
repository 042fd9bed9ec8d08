"""Token ids in wavelet-matrix files: one compressed file per shard that answers access, count and
occurrence lookup in place.

File: a header (JSON, length first) and zstd-compressed sections: document ids and token counts,
then one bit plane per bit of the largest id, from the highest. In plane b the ids stand in the
order that a stable sort by the planes above has left; `zeros` says how many have a 0 there.
rank() uses counts per 512 bits, which are rebuilt from a plane when it is first opened."""

from __future__ import annotations

import functools
import json
import struct
import uuid
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

MAGIC = b"WVMX1\n"
#: A shard is closed by the document that brings it to so many ids.
SHARD_TOKENS = 1 << 20
_STEP = 512


def build(ids: np.ndarray, documents: list, lengths: np.ndarray) -> bytes:
    """The file of these ids, whose documents (None or integers) have these lengths."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    x = ids.astype(np.uint16 if width <= 16 else np.uint32)
    planes, zeros = [], []
    for b in range(width - 1, -1, -1):
        bit = (x >> b) & 1 == 1
        planes.append(pack(np.packbits(bit, bitorder="little").tobytes()))
        low, high = x[~bit], x[bit]
        zeros.append(len(low))
        x = np.concatenate([low, high])
    known = np.array([d is not None for d in documents], dtype=bool)
    table = [pack(np.array([0 if d is None else d for d in documents], dtype="<i8").tobytes()),
             pack(np.packbits(known).tobytes()), pack(lengths.astype("<u8").tobytes())]
    sections = [*table, *planes]
    head = json.dumps({"n": len(ids), "documents": len(documents), "width": width, "zeros": zeros, "sizes": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


class Shard:
    """One file, opened. Sections are decompressed when first asked for."""

    def __init__(self, content: bytes):
        if content[:len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack_from("<I", content, len(MAGIC))
        at = len(MAGIC) + 4
        head = json.loads(content[at:at + size])
        self.n, self.width, self.zeros, self._documents = head["n"], head["width"], head["zeros"], head["documents"]
        ends = at + size + np.cumsum([0, *head["sizes"]])
        self._parts = [content[a:b] for a, b in zip(ends, ends[1:])]

    def _open(self, k: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self._parts[k])

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, which of them are not null, and numbers of tokens."""
        known = np.unpackbits(np.frombuffer(self._open(1), np.uint8), count=self._documents) == 1
        return np.frombuffer(self._open(0), "<i8"), known, np.frombuffer(self._open(2), "<u8").astype(np.int64)

    @functools.lru_cache(maxsize=None)
    def _plane(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        plane = np.frombuffer(self._open(3 + b), np.uint8)
        ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (_STEP // 8)))).reshape(-1, _STEP // 8).sum(1, dtype=np.int64)
        return plane, np.concatenate([[0], np.cumsum(ones)])

    def _ones(self, b: int, i: int) -> int:
        """1-bits of plane b before place i."""
        plane, sums = self._plane(b)
        block = i // _STEP
        tail = plane[block * (_STEP // 8):(i + 7) // 8]
        inside = i - block * _STEP
        bits = np.unpackbits(tail, bitorder="little")[:inside]
        return int(sums[block] + bits.sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for b in range(self.width):
            ones = self._ones(b, i)
            bit = int(self._plane(b)[0][i // 8] >> (i % 8) & 1)
            value = value << 1 | bit
            i = self.zeros[b] + ones if bit else i - ones
        return value

    def _narrow(self, token: int, a: int, z: int) -> tuple[int, int]:
        if token >> self.width:
            return 0, 0
        for b in range(self.width):
            x, y = self._ones(b, a), self._ones(b, z)
            a, z = (self.zeros[b] + x, self.zeros[b] + y) if token >> (self.width - 1 - b) & 1 else (a - x, z - y)
        return a, z

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the id occurs in places start to end."""
        a, z = self._narrow(token, start, self.n if end is None else end)
        return z - a

    def _find(self, b: int, rank: int, bit: int) -> int:
        """Place of the rank-th bit of this kind in plane b."""
        _, sums = self._plane(b)
        marks = sums if bit else np.arange(len(sums)) * _STEP - sums
        block = int(np.searchsorted(marks, rank, side="right")) - 1
        bits = np.unpackbits(self._plane(b)[0][block * (_STEP // 8):(block + 1) * (_STEP // 8)], bitorder="little")
        return block * _STEP + int(np.flatnonzero(bits == bit)[rank - marks[block]])

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of the id."""
        a, z = self._narrow(token, 0, self.n)
        if not 0 <= k < z - a:
            raise IndexError(k)
        at = a + k
        for b in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - b) & 1
            at = self._find(b, at - self.zeros[b] if bit else at, bit)
        return at

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        x = np.zeros(self.n, dtype=kind)
        for b in range(self.width - 1, -1, -1):
            bit = np.unpackbits(np.frombuffer(self._open(3 + b), np.uint8), count=self.n, bitorder="little") == 1
            up = np.empty_like(x)
            up[~bit] = x[:self.zeros[b]]
            up[bit] = x[self.zeros[b]:] | kind(1 << (self.width - 1 - b))
            x = up
        return x


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int, id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode texts in ascending id order and write shard files; the manifest, one row a file:
    (part, seq, file, tokens). Names are new for each attempt of a task, and only files that the
    manifest names belong to the result, so a repeated task does no harm."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
               .repartitionByRange(parts, "id").sortWithinPartitions("id", F.xxhash64("text")))

    def write(batches):
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        held, documents, lengths, tokens = [], [], [], 0

        def close():
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wvmx"
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            with target.open_output_stream(f"{root}/{name}") as out:
                out.write(build(ids, documents, np.array(lengths, np.int64)))
            return pa.record_batch({"part": [part], "seq": [seq], "file": [name], "tokens": pa.array([tokens], pa.int64())},
                                   schema=pa.schema({"part": pa.int32(), "seq": pa.int32(), "file": pa.string(), "tokens": pa.int64()}))

        for batch, _ in blocks(batches, "text"):
            ids, bounds = append_id(*vocabulary(tokenizer).encode(batch.column(1)), end)
            for k, name in enumerate(batch.column(0).to_pylist()):
                held.append(ids[bounds[k]:bounds[k + 1]])
                documents.append(name)
                lengths.append(len(held[-1]))
                tokens += lengths[-1]
                if tokens >= shard_tokens:
                    yield close()
                    held, documents, lengths, tokens, seq = [], [], [], 0, seq + 1
        if documents:
            yield close()

    return ordered.mapInArrow(write, "part int, seq int, file string, tokens long")


def read_shards(manifest: DataFrame, folder: str, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files that the manifest names."""
    spark = manifest.sparkSession
    # One number for each task that wrote; places inside a task's files are summed on executors.
    per_part = manifest.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r.n for r in per_part])]).tolist()
    bases = spark.createDataFrame([(r.part, int(b)) for r, b in zip(per_part, before)], "part int, base long")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (manifest.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
              .join(bases, "part").select("file", (F.col("base") + F.col("inside")).alias("start")))
    if not per_part:
        return spark.createDataFrame([], f"{id} long, start long, n_tokens long, ids_crc32 long")
    files = (spark.read.format("binaryFile").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))

    def read(batches):
        for batch in batches:
            for content, start in zip(batch.column(0), batch.column(1).to_pylist()):
                shard = Shard(content.as_buffer().to_pybytes())
                names, known, lengths = shard.documents()
                ends = np.cumsum(lengths)
                data = memoryview(shard.ids().astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.record_batch({"id": pa.array(names, mask=~known), "start": pa.array(start + ends - lengths),
                                       "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    return (files.join(starts, "file").select("content", "start")
            .mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id))


def store_and_read(docs: DataFrame, tokenizer: str, end: int = 2, id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write all texts' ids (id `end` behind each) to shard files in ascending id order, read the
    files, and return (id, start, n_tokens, ids_crc32) per row as read.

    A null text is empty: only the end id. Null ids come first. Rows that share an id stay rows
    of their own, ordered by a hash of their text; equal rows are alike. An empty table gives no
    file and no row. Other columns are not read."""
    with Workspace(docs.sparkSession, "wavelet") as work:
        folder = work.path("shards")
        manifest = work.table(write_shards(docs, folder, tokenizer, end, id, text, shard_tokens), "manifest")
        return work.keep(read_shards(manifest, folder, id))
