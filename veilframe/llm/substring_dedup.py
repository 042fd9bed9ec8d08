"""Repeated passages of a corpus, found exactly by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the smallest hash among its `gram`-word
grams; equal windows have equal minimisers, and most neighbours share theirs. Consecutive windows
with one minimiser therefore form one super-window. First only minimisers are counted: windows
whose minimiser occurs once are unique. The other super-windows travel, each as one packed string,
to the bucket of their minimiser, where their windows are sorted and equal ones stand together.
Comparison is of bytes; hashes only choose buckets. A minimiser with more than `hot` super-windows
(a passage in a great part of all documents) has no bucket: its windows are counted by 128-bit
digests with sums taken before the shuffle."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.store import Workspace, free_names
from veilframe.llm.text import Texts, blocks, gram_hashes, lists, run_ids, slice_hashes, take_slices

WINDOW = 35
GRAM = 5
#: Super-windows of one minimiser that are sorted in one bucket.
HOT = 4096
#: Windows in one super-window at most; a longer run goes as several.
RUN = 512
#: Repeated digests of hot minimisers that are broadcast (16 bytes each); more are joined.
DIGESTS = 1 << 19


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of values[i:i + size] for each i, by doubling."""
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def super_windows(texts: Texts, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first word, number of words, minimiser, and how often the minimiser's gram stands in
    it, for each super-window."""
    starts, ends, first = texts.words()
    empty = np.zeros(0, np.int64)
    if len(starts) < window:
        return empty, empty, empty, empty.astype(np.uint64), empty
    grams = gram_hashes(slice_hashes(texts.data, starts, ends), gram)
    least = _smallest(grams, window - gram + 1)
    doc = run_ids(first)[:len(least)]
    inside = np.arange(len(least)) + window <= first[doc + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty, empty.astype(np.uint64), empty
    value, doc = least[at], doc[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    run = np.cumsum(new) - 1
    place = np.arange(len(at)) - np.flatnonzero(new)[run]
    begin = np.flatnonzero(new | (place % RUN == 0))
    windows = np.diff(np.append(begin, len(at)))
    words = windows + window - 1
    spans, offsets = take_slices(grams, at[begin], at[begin] + words - gram + 1)
    often = np.add.reduceat(spans == np.repeat(value[begin], np.diff(offsets)), offsets[:-1])
    return doc[begin], at[begin] - first[doc[begin]], words, value[begin], often


def _packed(texts: Texts, text: np.ndarray, start: np.ndarray, words: np.ndarray) -> pa.LargeStringArray:
    """Words start to start + words of these texts, joined by one blank."""
    a, z, first = texts.words()
    low = first[text] + start
    at, offsets = take_slices(np.arange(len(a)), low, low + words)
    data, places = take_slices(texts.data, a[at], z[at], gap=0x20)
    begin, end = places[offsets[:-1]], places[offsets[1:]] - 1
    out, bounds = take_slices(data, begin, end)
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(bounds), pa.py_buffer(out))


def _windows(packed: list[bytes], window: int) -> tuple[list[bytes], list[int]]:
    """All windows of these super-windows, and how many each has."""
    out, sizes = [], []
    for text in packed:
        blank = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
        starts, ends = [0, *(blank + 1).tolist()], [*blank.tolist(), len(text)]
        n = len(starts) - window + 1
        out += [text[a:z] for a, z in zip(starts[:n], ends[window - 1:])]
        sizes.append(n)
    return out, sizes


def _runs(repeated: np.ndarray, sizes: list[int], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last window (as word numbers) of each run of repeated windows."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    word = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[row] if len(row) else row
    at = np.flatnonzero(repeated)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (row[at[1:]] != row[at[:-1]]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1
    return row[at[begin]], word[at[begin]], word[at[last]]


def _spans_of(batch: pa.RecordBatch, repeated: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
    row, low, high = _runs(repeated, sizes, batch.column("start").to_numpy())
    return pa.record_batch({"id": batch.column("id").take(pa.array(row)), "h": batch.column("h").take(pa.array(row)),
                            "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})


def _bucket_sorter(window: int):
    """Rows sorted by minimiser in; runs of repeated windows out."""

    def equal_windows(packed: list[bytes]) -> tuple[np.ndarray, list[int]]:
        windows, sizes = _windows(packed, window)
        order = sorted(range(len(windows)), key=windows.__getitem__)
        repeated = np.zeros(len(windows), dtype=bool)
        for a, b in zip(order, order[1:]):
            if windows[a] == windows[b]:
                repeated[a] = repeated[b] = True
        return repeated, sizes

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column("key").to_numpy()
        packed = [x.as_buffer().to_pybytes() for x in batch.column("packed")]
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        marks, sizes = [], []
        for a, b in zip(cuts, cuts[1:]):
            repeated, n = equal_windows(packed[a:b])
            marks.append(repeated)
            sizes += n
        return _spans_of(batch, np.concatenate(marks), sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the rows of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            last = table.column("key")[-1]
            whole = pc.sum(pc.not_equal(table.column("key"), last)).as_py() or 0
            held = table.slice(whole)
            if whole:
                for ready in table.slice(0, whole).combine_chunks().to_batches():
                    yield settle(ready)
        if held is not None:
            for ready in held.combine_chunks().to_batches():
                yield settle(ready)

    return run


def _digests(packed: list[bytes], window: int) -> tuple[list[bytes], list[int]]:
    windows, sizes = _windows(packed, window)
    return [hashlib.blake2b(w, digest_size=16).digest() for w in windows], sizes


def _hot_spans(hot: DataFrame, window: int, kind: str, digests: int) -> DataFrame:
    """Runs of repeated windows among super-windows of hot minimisers."""

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                found, _ = _digests([x.as_buffer().to_pybytes() for x in batch.column("packed")], window)
                counts = Counter(found)
                yield pa.record_batch({"digest": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    repeated = (hot.select("packed").mapInArrow(count, "digest binary, n long")
                .groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select("digest"))
    spark = hot.sparkSession
    schema = f"id {kind}, h long, low long, high long"
    if repeated.count() <= digests:
        known = spark.sparkContext.broadcast(set(repeated.toArrow().column(0).to_pylist()))

        def mark(batches):
            for batch in batches:
                if batch.num_rows:
                    found, sizes = _digests([x.as_buffer().to_pybytes() for x in batch.column("packed")], window)
                    yield _spans_of(batch, np.fromiter((d in known.value for d in found), bool, len(found)), sizes)

        return hot.mapInArrow(mark, schema)

    def spread(batches):
        for batch in batches:
            if batch.num_rows:
                found, sizes = _digests([x.as_buffer().to_pybytes() for x in batch.column("packed")], window)
                row = np.repeat(np.arange(len(sizes)), sizes)
                word = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + batch.column("start").to_numpy()[row]
                yield pa.record_batch({"digest": pa.array(found, pa.binary()), "id": batch.column("id").take(pa.array(row)),
                                       "h": batch.column("h").take(pa.array(row)), "low": pa.array(word, pa.int64()), "high": pa.array(word, pa.int64())})

    return hot.mapInArrow(spread, "digest binary, " + schema).join(repeated, "digest", "left_semi").drop("digest")


def _covered(n: int, low: list[int], high: list[int], window: int) -> np.ndarray:
    """Which of n words a repeated window covers, from runs of windows."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, np.array(low, np.int64), 1)
    np.add.at(step, np.minimum(np.array(high, np.int64) + window, n), -1)
    return np.cumsum(step[:n]) > 0


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, digests: int = DIGESTS) -> DataFrame:
    """(id, text_hash, n_words, n_removed, spans, kept_sha256) per row: words that stand in a
    window whose word sequence also starts anywhere else, the same text included.

    Words are runs without blanks (space, tab, line feed, vertical tab, form feed, carriage
    return). spans: (first, last) word numbers of removed stretches, in order. kept_sha256: of the
    other words joined by one blank. A null text has no words, as an empty one. Each row is a text
    of its own, so rows repeated whole (alike in id, which may be null, and text) remove each
    other's windows. Other columns are not read."""
    if not 1 <= gram <= window:
        raise ValueError("a gram must fit into a window")
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    kind = docs.schema["id"].dataType.simpleString()

    def find(batches):
        for batch, texts in blocks(batches, "text"):
            row, start, words, key, often = super_windows(texts, window, gram)
            row = pa.array(row, pa.int64())
            yield pa.record_batch({"key": pa.array(key.view(np.int64)), "often": pa.array(often, pa.int64()), "id": batch.column(0).take(row),
                                   "h": batch.column(2).take(row), "start": pa.array(start, pa.int32()), "words": pa.array(words, pa.int32())})

    def first_pass(batches):
        for batch, texts in blocks(batches, "text"):
            starts, ends, first = texts.words()
            found = batch.column("found")
            data, places = take_slices(texts.data, starts, ends, gap=0x20)
            raw, clean = data.tobytes(), found.is_null().to_pylist()
            bounds = places[first].tolist()
            sha = [hashlib.sha256(raw[a:max(a, z - 1)]).hexdigest() if alone else None for a, z, alone in zip(bounds, bounds[1:], clean)]
            yield pa.record_batch({"id": batch.column("id"), "h": batch.column("h"), "n_words": pa.array(np.diff(first), pa.int64()), "kept_sha256": pa.array(sha, pa.string()),
                                   "text": batch.column("text").take(pa.array(np.arange(len(clean)), mask=np.array(clean, dtype=bool))), "found": found})

    def send(batches):
        for batch, texts in blocks(batches, "text"):
            found = batch.column("found")
            row = pc.list_parent_indices(found)
            flat = found.flatten()
            start, words = flat.field("start"), flat.field("words")
            yield pa.record_batch({"key": flat.field("key"), "n": flat.field("n"), "id": batch.column("id").take(row), "h": batch.column("h").take(row), "start": start,
                                   "packed": _packed(texts, row.to_numpy(), start.to_numpy(), words.to_numpy()).cast(pa.string())})

    def remove(batches):
        for batch, texts in blocks(batches, "text"):
            starts, ends, first = texts.words()
            removed, sha, spans, offsets = [], [], [], [0]
            for k, (low, high) in enumerate(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())):
                a, z = first[k], first[k + 1]
                gone = _covered(z - a, low or [], high or [], window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans += zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())
                offsets.append(len(spans))
                keep = np.flatnonzero(~gone) + a
                data, _ = take_slices(texts.data, starts[keep], ends[keep], gap=0x20)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(data.tobytes()[:-1]).hexdigest())
            pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())], ["first", "last"])
            yield pa.record_batch({"id": batch.column("id"), "h": batch.column("h"), "n_words": batch.column("n_words"), "n_removed": pa.array(removed, pa.int64()),
                                   "spans": lists(np.array(offsets), pairs), "kept_sha256": pa.array(sha, pa.string())})

    def same(a: DataFrame, b: DataFrame):
        return a["id"].eqNullSafe(b["id"]) & a["h"].eqNullSafe(b["h"])

    with Workspace(spark, "substrings") as work:
        windows = work.table(docs.mapInArrow(find, f"key long, often long, id {kind}, h long, start int, words int"), "super-windows")
        shared = windows.groupBy("key").agg(F.sum("often").alias("n")).filter(F.col("n") > 1)
        hits = (windows.join(shared, "key").groupBy("id", "h")
                .agg(F.collect_set(F.struct("key", "n", "start", "words")).alias("found")))
        one = docs.join(hits, same(docs, hits), "left").select(docs["id"], docs["h"], "text", "found")
        found = "array<struct<key: long, n: long, start: int, words: int>>"
        first = work.table(one.mapInArrow(first_pass, f"id {kind}, h long, n_words long, kept_sha256 string, text string, found {found}"), "texts")
        some = first.filter(F.col("found").isNotNull())
        rows = some.select("id", "h", "text", "found").mapInArrow(send, f"key long, n long, id {kind}, h long, start int, packed string")
        schema = f"id {kind}, h long, low long, high long"
        sent = work.table(rows, "sent")
        spans = sent.filter(F.col("n") <= hot).repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_sorter(window), schema)
        often = sent.filter(F.col("n") > hot)
        if not often.isEmpty():
            spans = spans.unionByName(_hot_spans(often, window, kind, digests))
        spans = spans.groupBy("id", "h").agg(F.collect_set(F.struct("low", "high")).alias("s")).select("id", "h", "s.low", "s.high")
        output = f"id {kind}, h long, n_words long, n_removed long, spans array<struct<first: long, last: long>>, kept_sha256 string"
        changed = some.join(spans, same(some, spans), "left").select(some["id"], some["h"], "n_words", "text", "low", "high").mapInArrow(remove, output)
        clean = first.filter(F.col("found").isNull()).select(
            "id", "h", "n_words", F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<first: long, last: long>>").alias("spans"), "kept_sha256")
        return work.keep(clean.unionByName(changed).withColumnsRenamed({"id": id, "h": "text_hash"}))


def without_passages(docs: DataFrame, passages: DataFrame, id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The same rows and columns, texts without the removed words. Texts that lose nothing stay
    as they are, blanks included; from the others all that is left is joined by one blank, and
    the column `length`, where there is one, is the new text's number of characters."""
    own, h, found = free_names(docs, "_id", "_h", "_spans")
    cuts = passages.filter(F.col("n_removed") > 0).select(F.col(id).alias(own), F.col("text_hash").alias(h), F.col("spans").alias(found)).dropDuplicates([own, h])
    names = docs.columns

    def cut(batches):
        for batch, texts in blocks(batches, text):
            starts, ends, first = texts.words()
            old, new = batch.column(batch.schema.get_field_index(text)).to_pylist(), []
            for k, spans in enumerate(batch.column(batch.schema.get_field_index(found)).to_pylist()):
                if not spans:
                    new.append(old[k])
                    continue
                keep = np.ones(first[k + 1] - first[k], dtype=bool)
                for s in spans:
                    keep[s["first"]:s["last"] + 1] = False
                at = np.flatnonzero(keep) + first[k]
                data, _ = take_slices(texts.data, starts[at], ends[at], gap=0x20)
                new.append(data.tobytes()[:-1].decode("utf-8"))
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {text: pa.array(new, pa.string())}
            if length in names:
                cut_here = pc.not_equal(pc.fill_null(column[text], ""), pc.fill_null(pa.array(old, pa.string()), ""))
                column[length] = pc.if_else(cut_here, pc.utf8_length(column[text]).cast(column[length].type), column[length])
            yield pa.record_batch({n: column[n] for n in names})

    joined = docs.join(cuts, docs[id].eqNullSafe(cuts[own]) & F.xxhash64(docs[text]).eqNullSafe(cuts[h]), "left").drop(own, h)
    return joined.mapInArrow(cut, docs.schema)
