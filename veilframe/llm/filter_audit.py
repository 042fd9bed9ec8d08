"""What each filter of a cleaning step removes, alone and after others, in every order.

The filters that look at one text are columns. The filter for repeated texts is a set of radix tries:
distinct texts of a task are put together first, then dealt by ranges of text. A range is told by
prefixes that are as long as the texts demand: short ones where texts differ early, longer ones
below a head that many texts share. Inside a range texts come in byte order and whole texts are
inserted into a compressed trie whose terminals hold the smallest id. A trie that has grown to
`TRIE_BYTES` is traversed and begun anew with its last text; what comes later is larger, so no text
is cut off from its equals. The rows at terminals are the first of their text, all others repeat one.

Documents are then masks of failed filters, and everything that is asked for any order follows
from the number of documents of each mask."""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.store import Workspace

#: Bytes of distinct texts that a task puts together before it sends them on.
HELD_BYTES = 32 << 20
#: Bytes of labels and nodes of one trie.
TRIE_BYTES = 64 << 20
#: Texts of a sample for each range, and the prefix lengths that ranges may be told by.
_SAMPLE = 16
_DEPTHS = (32, 256, 2048, 16384)
_SAMPLE_BYTES = 32 << 20
_NODE_BYTES = 200
_WORD = r"[^\x20\x09-\x0D]+"


def failing(text: Column) -> dict[str, Column]:
    """The filters of one text: whether it fails each."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


class _Node:
    __slots__ = ("label", "children", "least")

    def __init__(self, label: bytes, least=None):
        self.label, self.children, self.least = label, {}, least


def _common(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of label stand in text from there."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        half = (low + high + 1) // 2
        if label[low:half] == text[at + low:at + half]:
            low = half
        else:
            high = half - 1
    return low


class Trie:
    """A compressed trie of byte strings; a terminal holds the least value inserted with its string."""

    def __init__(self):
        self.root, self.bytes = _Node(b""), 0

    def insert(self, text: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = child = _Node(text[at:])
                self.bytes += len(child.label) + _NODE_BYTES
                node, at = child, len(text)
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                shared = _common(child.label, text, at)
                upper = _Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = upper
                self.bytes += _NODE_BYTES
                node, at = upper, at + shared
        if node.least is None or value < node.least:
            node.least = value

    def terminals(self) -> Iterator:
        """The least value of each string."""
        below = [self.root]
        while below:
            node = below.pop()
            if node.least is not None:
                yield node.least
            below.extend(node.children.values())


def _separator(left: bytes, right: bytes) -> bytes:
    """The shortest prefix of right that is larger than left."""
    return right[:_common(left, right, 0) + 1]


def prefix_cuts(sample: DataFrame, ranges: int) -> list[bytes]:
    """Ascending prefixes between ranges of about equal weight, from (text, a row per unit of
    weight). A prefix with more than a range's share is looked into with a longer one."""
    spark = sample.sparkSession
    size = sample.count()
    share = max(1.0, size / ranges)
    cuts: list[bytes] = []
    open_: list[bytes] = [b""]
    raw, part = F.encode("text", "utf-8"), sample
    begin = 0
    for depth in _DEPTHS:
        if begin:
            heads = spark.createDataFrame([(bytearray(p),) for p in open_], "head binary")
            part = sample.withColumn("head", F.substring(raw, 1, begin)).join(F.broadcast(heads), "head", "left_semi")
        # What the driver sees is bounded; thinner samples only make ranges less even.
        rows = part.count() if begin else size
        stay = min(1.0, _SAMPLE_BYTES / max(1, rows * depth))
        thin = part.filter(F.pmod(F.xxhash64("text", F.lit(depth)), F.lit(1 << 20)) < int(stay * (1 << 20))) if stay < 1 else part
        counted = thin.groupBy(F.substring(raw, 1, depth).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        open_ = []
        weight, last, inside = 0.0, None, None
        for row in counted:
            prefix, n = bytes(row.p), row.n / stay
            head = prefix[:begin]
            if head != inside:
                weight, last, inside = 0.0, None, head
            if last is not None and weight + n > share:
                cuts.append(_separator(last, prefix))
                weight = 0.0
            weight, last = weight + n, prefix
            if n > share and len(prefix) == depth:
                open_.append(prefix)
        if not open_:
            break
        begin = depth
    return sorted(set(cuts))


def first_of_each(docs: DataFrame, work: Workspace, kind: str, held_bytes: int = HELD_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id, h) of rows (id, h, text) that have the smallest id of their text; h goes along. Rows
    without an id are left out."""
    def combine(batches: Iterable[pa.RecordBatch]):
        held: dict[str, tuple] = {}
        size = 0

        def flush():
            texts = list(held)
            return pa.record_batch({
                "text": pa.array(texts, pa.string()), "size": pa.array([len(t) for t in texts], pa.int64()),
                "id": pa.array([v[0] for v in held.values()], like[0]), "h": pa.array([v[1] for v in held.values()], pa.int64())})

        like = []
        for batch in batches:
            like = [batch.column(0).type]
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                old = held.get(text)
                if old is None:
                    size += len(text)
                if old is None or i < old[0]:
                    held[text] = (i, h)
                if size > held_bytes:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    spark = docs.sparkSession
    texts = work.table(docs.filter("id is not null").select("id", "h", "text").mapInArrow(combine, f"text string, size long, id {kind}, h long"), "texts")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = texts.agg(F.sum("size")).first()[0] or 0
    # A row for every so many bytes, chosen by hash; long texts always.
    unit = max(1, total // (ranges * _SAMPLE))
    chance = F.pmod(F.xxhash64("h", "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = work.table(texts.filter(chance * unit <= F.col("size")).select("text", F.greatest(F.lit(1), F.floor(F.col("size") / unit)).alias("w"))
                        .select("text", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("w"), F.lit(64)).cast("long"))).alias("w")).select("text"), "sample")
    cuts = spark.sparkContext.broadcast(prefix_cuts(sample, ranges))

    def place(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            # As many partitions as asked for, each a range; more cuts than that are put together.
            share = max(1.0, (len(cuts.value) + 1) / ranges)
            where = [int(bisect_right(cuts.value, t) / share) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *batch.columns], ["cell", *batch.schema.names])

    def traverse(batches: Iterable[pa.RecordBatch]):
        trie, names = Trie(), None

        def done():
            found = list(trie.terminals())
            return pa.record_batch({"id": pa.array([f[0] for f in found], names), "h": pa.array([f[1] for f in found], pa.int64())})

        for batch in batches:
            names = batch.column(1).type
            for text, i, h in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text.as_py()
                if trie.bytes > trie_bytes and text != last:
                    yield done()
                    trie = Trie()
                trie.insert(text, (i, h))
                last = text
        if names is not None:
            yield done()

    placed = texts.select("text", "id", "h").mapInArrow(place, f"cell int, text string, id {kind}, h long")
    dealt = placed.repartitionById(ranges, "cell").sortWithinPartitions("text")
    found = work.table(dealt.select("text", "id", "h").mapInArrow(traverse, f"id {kind}, h long"), "first")
    cuts.unpersist()
    return found


def order_table(letters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) for all orders, and which masks count for each figure there."""
    masks = np.arange(1 << len(letters))
    bit = {c: 1 << k for k, c in enumerate(letters)}
    rows, parts = [], {"kept": [], "removed": [], "redundant": [], "unique_fails": []}
    for order in itertools.permutations(letters):
        before = 0
        for step, c in enumerate(order, 1):
            own, earlier = masks & bit[c] > 0, masks & before > 0
            rows.append(("".join(order), step))
            parts["kept"].append(~own & ~earlier)
            parts["removed"].append(own & ~earlier)
            parts["redundant"].append(own & earlier)
            parts["unique_fails"].append(masks == bit[c])
            before |= bit[c]
    return rows, {k: np.array(v, dtype=np.int64) for k, v in parts.items()}


def filter_audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", filters: Mapping[str, Column] | None = None, repeated: str = "E") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for each source, each order of the filters and each step of it.

    filters: by letter, the condition under which a text (column `text`, null as empty) fails; the
    default are those of failing(). The last filter, `repeated`, fails a row whose text any row
    with a smaller id has. A null id is neither smaller nor larger than any: such a row neither
    fails that filter nor makes others fail, and has no label. Rows that share an id and a text
    are both the first or both not; they are counted each. A null source is ''. An id with several
    rows of labels is good (toxic) if any of them says so. An empty table gives no rows. Other
    columns are not read. Texts are compared whole; 64-bit hashes only tell rows of one id apart."""
    spark = docs.sparkSession
    filters = dict(failing(F.col("text")) if filters is None else filters)
    letters = "".join(filters) + repeated
    docs = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    with Workspace(spark, "audit") as work:
        mask = F.lit(0)
        for k, condition in enumerate(filters.values()):
            mask = mask + F.when(condition, 1 << k).otherwise(0)
        marks = work.table(docs.select("id", "h", "part", mask.alias("mask")), "marks")
        first = first_of_each(docs, work, kind).withColumn("first", F.lit(True))
        marked = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).cast(kind).alias("id")).agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
        # Repeated rows are added up first, rows without an id don't take part in joins.
        named = marks.filter("id is not null").groupBy("id", "h", "part", "mask").agg(F.count("*").alias("n"))
        later = F.when(F.col("first").isNull(), 1 << len(filters)).otherwise(0)
        told = (named.join(first, ["id", "h"], "left").join(marked, "id", "left")
                .select("part", (F.col("mask") + later).alias("mask"), "n", *[F.when(F.col(c), F.col("n")).otherwise(0).alias(c) for c in ("good", "toxic")]))
        nameless = marks.filter("id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("good", "toxic")])
        figures = ("n", "good", "toxic")
        summed = told.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in figures])
        # At most one entry for each mask.
        by_part = summed.groupBy("part").agg(F.collect_list(F.struct("mask", *figures)).alias("cells"))

        def expand(batches: Iterable[pa.RecordBatch]):
            rows, parts = order_table(letters)
            of = np.array([letters.index(order[step - 1]) for order, step in rows])
            for batch in batches:
                for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    table = np.zeros((3, 1 << len(letters)), dtype=np.int64)
                    for c in cells:
                        table[:, c["mask"]] = [c[f] for f in figures]
                    n, good, toxic = table
                    removed = parts["removed"] @ n
                    shapley = np.zeros(len(letters), dtype=np.int64)
                    np.add.at(shapley, of, removed)
                    yield pa.record_batch({
                        "part": pa.array([part] * len(rows), pa.string()), "filter_order": pa.array([r[0] for r in rows]), "step": pa.array([r[1] for r in rows], pa.int32()),
                        "kept": pa.array(parts["kept"] @ n), "removed": pa.array(removed), "redundant": pa.array(parts["redundant"] @ n),
                        "unique_fails": pa.array(parts["unique_fails"] @ n), "good_lost": pa.array(parts["removed"] @ good), "toxic_lost": pa.array(parts["removed"] @ toxic),
                        "shapley": pa.array(shapley[of])})

        counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
        return work.keep(by_part.mapInArrow(expand, f"part string, filter_order string, step int, {counts}"))
