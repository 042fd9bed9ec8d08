"""Exact similarity join of documents' shingle sets, by relations between the sets.

Between indexes and sets: shingles have one fixed order, rare ones first; two sets that reach
the threshold share one of their first few (the prefix). An index list of a shingle holds sets
sorted by size and position in blocks. From the smallest and largest size and position in two
blocks follows how much any of their sets can share, so whole blocks are skipped; what is read is
tested pair by pair in the same way, and pairs are dropped whose prefixes share too few shingles
for what is left behind the prefix that ends first.

Between sets: equal sets are one class with one answer. Sets that share a few smallest hashes are
compared with the smallest member of that bucket, in a second round only the first ones of what
has come together so far, by other hashes; all that resemble each other loosely are a family. A
family's first set is compared with every other once, and the shingles in which they differ are
kept. Answers between two members are derived from those: the intersection of x and y is that of
both with the first set, but for the differences which they have or lack together. Members that
reach the threshold with the first set are connected by it; the others meet all members in
tiles of differences, where a connected set is told by one edge. Index lists leave out pairs of one
family, since these are answered, so a family of near copies neither fills the lists nor gives
out its pairs. No pair is left out otherwise, so components are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.components import components
from veilframe.llm.store import Workspace, free_names
from veilframe.llm.text import Texts, blocks, distinct_within, gram_hashes, lists, mix, run_ids, slice_hashes

SHINGLE = 5
PERCENT = 80
#: Bucket keys of a set in each round: each joins the smallest of two hash permutations.
KEYS = 5
ROUNDS = 2
#: Percent of similarity to the first set of a bucket from which sets are of one family.
LOOSE = 50
#: Sets that are compared with one first set in one place.
MEMBERS = 256
#: Members of a family, and shingles of their differences, on each side of a tile.
TILE = 1024
TILE_SHINGLES = 1 << 20
#: Shingles that stand in many documents are moved to the end of the order; at most so many.
COMMON = 1 << 18
#: So many copies, counted in blocks that hold more than one, make a shingle common.
OFTEN = 64
#: Rows of one index list that are paired in one place.
LIST_ROWS = 4096
#: Rows of an index list that one block holds.
BLOCK = 256


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin."""
    texts = texts.lowered()
    starts, ends, first = texts.words()
    words = slice_hashes(texts.data, starts, ends)
    n = np.diff(first)
    grams = gram_hashes(words, size)
    doc = run_ids(first)
    full = np.arange(len(grams)) + size <= first[doc[:len(grams)] + 1]
    short = np.flatnonzero((n > 0) & (n < size))
    value = np.zeros(len(short), np.uint64)
    for k in range(size - 1):  # a shorter text is one shingle: all its words, and how many
        has = n[short] > k
        value[has] = mix(value[has] * np.uint64(0x2545F4914F6CDD1D) + words[first[short[has]] + k])
    value = mix(value ^ n[short].astype(np.uint64))
    run = np.concatenate([doc[:len(grams)][full], short])
    key = np.concatenate([grams[full], value])
    chosen, _ = distinct_within(run, key)
    return key[chosen], np.searchsorted(run[chosen], np.arange(texts.count + 1))


def _segments(values: np.ndarray, offsets: np.ndarray, fold) -> np.ndarray:
    """fold.reduceat over runs, empty ones giving 0."""
    out = np.zeros(len(offsets) - 1, dtype=values.dtype)
    filled = np.diff(offsets) > 0
    if filled.any():
        out[filled] = fold.reduceat(values, offsets[:-1][filled])
    return out


def _summary(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Two 64-bit sums that name each set, and its bucket keys."""
    name = [_segments(mix(values + np.uint64(s)), offsets, np.add) for s in (0x9E37, 0x79B9)]
    keys = []
    for k in range(ROUNDS * KEYS):
        # Values are hashes, so an odd factor is permutation enough.
        least = [_segments(values * np.uint64((0xA0761D6478BD642F * (4 * k + 2 * j + 1) | 1) % (1 << 64)), offsets, np.minimum) for j in range(2)]
        keys.append(mix(least[0] * np.uint64(3) + least[1] + np.uint64(k)))
    return name[0], name[1], keys


def _ceil(x, y):
    return -(-x // y)


def _needed(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection at which sets of x and y shingles reach the threshold."""
    return _ceil(percent * (x + y), 100 + percent)


def _reaches(shared, x, y, percent: int):
    return 100 * shared >= percent * (x + y - shared)


def _beside_first(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, h, part, member, c, text) of pairs (a, b): texts of all b, dealt to parts, each part led by
    the text of its a. A set that is first for very many is copied once a part, not once a pair.
    h tells the texts of one number apart, which are several where rows share an id."""
    # The texts lie in buckets of their number: joins by it alone don't move them.
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    named = texts.withColumnRenamed("c", "a")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    first = sizes.join(named, "a").select("a", "h", every.alias("part"), F.lit(False).alias("member"), F.col("a").alias("c"), "text")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    members = pairs.join(sizes.join(named.select("a", "h"), "a"), "a").select("a", "h", part.alias("part"), F.lit(True).alias("member"), F.col("b").alias("c"))
    rows = first.unionByName(members.join(texts.select("c", "text"), "c"))
    return rows.repartition("a", "h", "part").sortWithinPartitions("a", "h", "part", "member", "c")


def _runs(batches, size: int):
    """For each stretch of members that follow their first set: its number, text and shingles, the
    members' numbers, and their shingles with where each one's begin."""
    first, variant, leader = None, None, None
    for batch in batches:
        for piece, texts in blocks([batch], "text"):
            values, offsets = shingle_sets(texts, size)
            h, member, c = (piece.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4))
            heads = np.flatnonzero(~member)
            for low, high in zip([-1, *heads.tolist()], [*heads.tolist(), len(c)]):
                if low >= 0:
                    first, variant, leader = c[low], h[low], values[offsets[low]:offsets[low + 1]].copy()
                if low + 1 < high:
                    begin = offsets[low + 1:high + 1]
                    yield first, variant, leader, c[low + 1:high], values[begin[0]:begin[-1]], begin - begin[0]


def _inside(leader: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values stand in the ascending leader, and where (0 for others)."""
    at = np.minimum(np.searchsorted(leader, values), len(leader) - 1)
    here = leader[at] == values
    return here, np.where(here, at, 0)


def _compared(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of class numbers whose texts reach the threshold."""
    def run(batches):
        for first, variant, leader, c, values, begin in _runs(batches, size):
            here, _ = _inside(leader, values)
            shared = _segments(here.astype(np.int64), begin, np.add)
            good = c[_reaches(shared, len(leader), np.diff(begin), percent)]
            if len(good):
                yield pa.record_batch({"a": pa.array(np.full(len(good), first)), "b": pa.array(good)})

    return _beside_first(pairs, texts).mapInArrow(run, "a long, b long")


_MEMBER = "family long, h long, c long, n long, of long, lacks long, d array<long>, core boolean"


def _differences(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """For pairs (a, b) of a family's first set and another: how many shingles b has and a has, how
    many of a's it lacks, those that only one of the two has, and whether they reach the threshold."""
    def run(batches):
        for first, variant, leader, c, values, begin in _runs(batches, size):
            here, at = _inside(leader, values)
            doc = run_ids(begin)
            lacks = np.ones((len(c), len(leader)), dtype=bool)
            lacks[doc[here], at[here]] = False
            row, place = np.nonzero(lacks)
            missing = lacks.sum(1)
            owner = np.concatenate([row, doc[~here]])
            d = np.concatenate([leader[place], values[~here]])[np.argsort(owner, kind="stable")]
            n = np.diff(begin)
            yield pa.record_batch({
                "family": pa.array(np.full(len(c), first)), "h": pa.array(np.full(len(c), variant)), "c": pa.array(c), "n": pa.array(n), "of": pa.array(np.full(len(c), len(leader))), "lacks": pa.array(missing),
                "d": lists(np.append(0, np.cumsum(np.bincount(owner, minlength=len(c)))), pa.array(d.view(np.int64))),
                "core": pa.array(_reaches(len(leader) - missing, len(leader), n, percent))})

    return _beside_first(pairs, texts).mapInArrow(run, _MEMBER)


def _tile_edges(percent: int):
    """One tile in: members of a family on two sides. Out: edges that connect what is linked."""
    def flat(column) -> tuple[np.ndarray, np.ndarray]:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False), run_ids(np.append(0, np.cumsum(pc.list_value_length(column).to_numpy())))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("right").to_numpy(zero_copy_only=False)
        halves = [table.filter(pa.array(side == s)) for s in (False, True)]
        c, n, lacks = ([h.column(name).to_numpy() for h in halves] for name in ("c", "n", "lacks"))
        if not all(map(len, c)):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        of = halves[0].column("of")[0].as_py()
        both = np.zeros((len(c[0]), len(c[1])), dtype=np.int32)
        tokens = []
        for half in halves:
            d, row = flat(half.column("d"))
            order = np.argsort(d, kind="stable")
            d, row = d[order], row[order]
            begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
            tokens.append((d[begin], begin, np.append(begin[1:], len(d)), row))
        _, i, j = np.intersect1d(tokens[0][0], tokens[1][0], assume_unique=True, return_indices=True)
        (_, xb, xe, xr), (_, yb, ye, yr) = tokens
        for k, m in zip(i.tolist(), j.tolist()):
            both[np.ix_(xr[xb[k]:xe[k]], yr[yb[m]:ye[m]])] += 1
        shared = of - lacks[0][:, None] - lacks[1][None, :] + both
        x, y = np.nonzero(_reaches(shared, n[0][:, None], n[1][None, :], percent) & (c[0][:, None] != c[1][None, :]))
        numbers, place = np.unique(np.concatenate([c[0][x], c[1][y]]), return_inverse=True)
        left, right = place[:len(x)], place[len(x):]
        root = np.arange(len(numbers))
        while True:  # the smallest that links lead to inside the tile
            best = root.copy()
            np.minimum.at(best, left, root[right])
            np.minimum.at(best, right, root[left])
            best = best[best]
            if (best == root).all():
                break
            root = best
        other = root != np.arange(len(root))
        return pa.table({"a": pa.array(numbers[root[other]]), "b": pa.array(numbers[other])})

    return run


def _inner_links(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """Edges (a, b) between members of one family, other than by its first set: those that do not
    reach the threshold with it meet all."""
    weight = F.size("d")
    sizes = members.groupBy("family", "h").agg(
        F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(weight) / TILE_SHINGLES)).cast("int").alias("rights"),
        F.greatest(F.ceil(F.count(F.when(~F.col("core"), 1)) / tile), F.ceil(F.sum(F.when(~F.col("core"), weight)) / TILE_SHINGLES)).cast("int").alias("lefts"),
    ).filter("lefts > 0")
    rows = members.join(sizes, ["family", "h"])
    of = lambda parts: F.pmod(F.xxhash64("c"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    columns = ["family", "h", "p", "q", "right", "c", "n", "of", "lacks", "d"]
    left = rows.filter(~F.col("core")).withColumn("p", of("lefts")).withColumn("q", every("rights")).withColumn("right", F.lit(False)).select(columns)
    right = rows.withColumn("q", of("rights")).withColumn("p", every("lefts")).withColumn("right", F.lit(True)).select(columns)
    return left.unionByName(right).groupBy("family", "h", "p", "q").applyInArrow(_tile_edges(percent), "a long, b long")


def _block_pairs(size: np.ndarray, pos: np.ndarray, label: np.ndarray, percent: int):
    """Pairs (i, j), i < j, of one index list that this shingle leaves open; sizes ascend. Before
    it they share at most as many shingles as the earlier position, after it as many as the
    shorter rest."""
    n = len(size)
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        # Blocks whose smallest set is too large for this block's largest are skipped.
        reach = int(np.searchsorted(size, size[end - 1] * 100 // percent, side="right"))
        low, high = label[at:end].min(), label[at:end].max()
        first, behind = pos[at:end].max(), (size[at:end] - pos[at:end]).max()
        for to in range(at, reach, BLOCK):
            stop = min(reach, to + BLOCK)
            if low == high and low == label[to:stop].min() == label[to:stop].max():
                continue  # one family on both sides: their answers are known
            most = min(first, pos[to:stop].max()) + min(behind, (size[to:stop] - pos[to:stop]).max())
            if most < _needed(size[at], size[to], percent):
                continue  # by position no two sets of these blocks share enough
            x, y = size[at:end, None], size[None, to:stop]
            i, j = pos[at:end, None], pos[None, to:stop]
            most = np.minimum(i, j) + np.minimum(x - i, y - j)
            good = (most >= _needed(x, y, percent)) & (y * percent <= x * 100) & (label[at:end, None] != label[None, to:stop])
            i, j = np.nonzero(good)
            i, j = i + at, j + to
            yield i[i < j], j[i < j]


_MATCHES = "a long, b long, n long, pos_a int, pos_b int, size_a int, size_b int, end_a int, end_b int"


def _list_pairs(percent: int):
    """Rows sorted by (token, part, size, pos) in; for pairs of different labels how many shingles
    of their prefixes they share, and the last positions of these, out."""

    def settle(table: pa.Table) -> pa.RecordBatch | None:
        column = {c: table.column(c).to_numpy() for c in table.column_names}
        change = (np.diff(column["token"]) != 0) | (np.diff(column["part"]) != 0)
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(change) + 1]])
        label = column["label"]
        low, high = np.minimum.reduceat(label, cuts[:-1]), np.maximum.reduceat(label, cuts[:-1])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(low != high).tolist():
            s = slice(cuts[k], cuts[k + 1])
            for i, j in _block_pairs(column["size"][s].astype(np.int64), column["pos"][s].astype(np.int64), label[s], percent):
                left.append(i + cuts[k])
                right.append(j + cuts[k])
        left, right = np.concatenate(left), np.concatenate(right)
        if not len(left):
            return None
        c = column["c"]
        left, right = np.where(c[left] < c[right], left, right), np.where(c[left] < c[right], right, left)
        order = np.lexsort((c[right], c[left]))
        left, right = left[order], right[order]
        a, b = c[left], c[right]
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return pa.record_batch({
            "a": a[begin], "b": b[begin], "n": np.diff(np.append(begin, len(a))),
            "pos_a": np.maximum.reduceat(column["pos"][left], begin), "pos_b": np.maximum.reduceat(column["pos"][right], begin),
            "size_a": column["size"][left][begin], "size_b": column["size"][right][begin],
            "end_a": column["end"][left][begin], "end_b": column["end"][right][begin]})

    def run(batches):
        held = None  # the rows of the last list so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            token, part = table.column("token").to_numpy(), table.column("part").to_numpy()
            whole = int(np.count_nonzero((token != token[-1]) | (part != part[-1])))
            held = table.slice(whole)
            if whole and (done := settle(table.slice(0, whole))) is not None:
                yield done
        if held is not None and (done := settle(held)) is not None:
            yield done

    return run


def similar_sets(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, common: int = COMMON, list_rows: int = LIST_ROWS, tile: int = TILE) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept) per row: distinct shingles of `size` words, and
    the smallest id that links lead to. Sets link when 100 * intersection >= percent * union. kept:
    whether the row has the smallest (id, text_hash) of its component; rows without words are kept.

    Words are lower-cased (A-Z) runs without blanks; a text of fewer than `size` words is one
    shingle; a null or empty one has none, links with nothing and is a component of its own. Rows
    with equal sets are linked. A row with a null id takes the component of the others with its
    set, null without any. Rows that share an id are linked where that id is the smallest of
    their equal sets. Other columns are not read. Shingles are compared by 64-bit hashes."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def summarise(batches):
        for batch, texts in blocks(batches, "text"):
            values, offsets = shingle_sets(texts, size)
            one, two, keys = _summary(values, offsets)
            flat = np.stack([k.view(np.int64) for k in keys], 1).ravel()  # of all rounds
            yield pa.record_batch({"id": batch.column(0), "h": batch.column(2), "n": pa.array(np.diff(offsets), pa.int64()), "s1": pa.array(one.view(np.int64)), "s2": pa.array(two.view(np.int64)),
                                   "keys": lists(np.arange(0, len(flat) + 1, ROUNDS * KEYS), pa.array(flat))})

    def count_common(batches):
        for batch, texts in blocks(batches, "text"):
            values, _ = shingle_sets(texts, size)
            token, n = np.unique(values, return_counts=True)
            yield pa.record_batch({"token": pa.array(token[n > 1].view(np.int64)), "n": pa.array(n[n > 1], pa.int64())})

    with Workspace(spark, "jaccard") as work:
        rows = work.table(docs.withColumn("h", F.xxhash64("text")).mapInArrow(summarise, "id long, h long, n long, s1 long, s2 long, keys array<long>"), "sets")
        classes = work.table(rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("c"), F.first("keys").alias("keys")).filter("c is not null"), "classes")
        # One text for each class, kept in buckets of its number: the joins below don't move texts.
        name = f"texts_{work.root.rsplit('-', 1)[1]}"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        one = classes.select("c").distinct().join(docs, F.col("c") == docs["id"]).select("c", F.xxhash64("text").alias("h"), "text").dropDuplicates(["c", "h"])
        one.write.option("path", work.path("texts")).option("compression", "zstd").bucketBy(parts, "c").sortBy("c").saveAsTable(name)
        try:
            texts = spark.table(name)
            families = None  # (c, family) of sets that have come together
            for turn in range(ROUNDS):
                # Later rounds ask only the first set of each family, by other hashes.
                asked = classes.select("c", F.slice("keys", turn * KEYS + 1, KEYS).alias("keys")).distinct()
                if families is not None:
                    asked = asked.join(families.filter("c <> family").select("c"), "c", "left_anti")
                buckets = asked.select("c", F.explode("keys").alias("key"))
                leaders = buckets.groupBy("key").agg(F.min("c").alias("a"), F.count("*").alias("m")).filter("m > 1").select("key", "a")
                star = buckets.join(leaders, "key").filter("a <> c").select("a", F.col("c").alias("b")).distinct()
                alike = work.table(_compared(work.table(star, f"star-{turn}"), texts, size, min(LOOSE, percent)), f"alike-{turn}")
                joined = components(alike, work, f"family-{turn}").select(F.col("id").alias("c"), F.col("component").alias("family"))
                if families is None:
                    families = joined
                else:
                    up = joined.select(F.col("c").alias("family"), F.col("family").alias("above"))
                    moved = families.join(up, "family", "left").select("c", F.coalesce("above", "family").alias("family"))
                    new = joined.join(families.select("c"), "c", "left_anti")
                    families = moved.unionByName(new)
                families = work.table(families, f"families-{turn}")
            inside = families.filter("c <> family").select(F.col("family").alias("a"), F.col("c").alias("b"))
            members = work.table(_differences(inside, texts, size, percent), "members")
            core = members.filter("core").select(F.col("family").alias("a"), F.col("c").alias("b"))
            near = work.table(core.unionByName(_inner_links(members, percent, tile)), "near")

            top = (docs.select("text").mapInArrow(count_common, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
                   .filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(common).toArrow())
            token = top.column("token").to_numpy().view(np.uint64)
            order = np.argsort(token)
            counts = top.column("n").to_numpy()
            place = np.empty(len(token), dtype=np.uint64)  # by count, then hash
            place[np.lexsort((token, counts))] = np.arange(len(token), dtype=np.uint64)
            often = spark.sparkContext.broadcast((token[order], counts[order], place[order]))

            def index(batches):
                known, counts, place = often.value
                for batch, block in blocks(batches, "text"):
                    values, offsets = shingle_sets(block, size)
                    doc = run_ids(offsets)
                    n = np.diff(offsets)[doc]
                    # The order of shingles: rare ones by hash, then common ones by count.
                    times, rank = np.zeros(len(values), np.int64), values >> np.uint64(1)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                        here = known[at] == values
                        times = np.where(here, counts[at], 0)
                        rank = np.where(here, np.uint64(1 << 63) | place[at], rank)
                    order = np.lexsort((values, rank, doc))
                    values, times, rank = values[order], times[order], rank[order]
                    pos = np.arange(len(values)) - offsets[:-1][doc]
                    prefix = n - _ceil(n * percent, 100) + 1
                    end = (rank[offsets[:-1][doc] + prefix - 1] >> np.uint64(33)).astype(np.int32)
                    keep = np.flatnonzero(pos < prefix)
                    # A long list is dealt into parts; each pair of parts meets in one place.
                    split = times[keep] // list_rows + 1
                    again = np.repeat(keep, split)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(split) - split, split)
                    split = np.repeat(split, split)
                    own = (mix(batch.column(0).to_numpy().view(np.uint64))[doc[again]] % split.astype(np.uint64)).astype(np.int64)
                    row = pa.array(doc[again])
                    yield pa.record_batch({
                        "token": pa.array(values[again].view(np.int64)), "part": pa.array(np.minimum(own, other) * split + np.maximum(own, other), pa.int32()),
                        "size": pa.array(n[again], pa.int32()), "pos": pa.array(pos[again], pa.int32()), "end": pa.array(end[again]),
                        "c": batch.column(0).take(row), "label": batch.column(2).take(row)})

            labelled = texts.join(families, "c", "left").select("c", "text", F.coalesce("family", "c").alias("label"))
            listed = labelled.mapInArrow(index, "token long, part int, size int, pos int, end int, c long, label long")
            matches = (listed.repartition("token", "part").sortWithinPartitions("token", "part", "size", "pos")
                       .mapInArrow(_list_pairs(percent), _MATCHES))
            # Of two prefixes one ends first in the order; what the sets share up to there stands in
            # both, so it has been counted, and the rest of that set is all that can be added.
            least = F.ceil(percent * (F.col("size_a") + F.col("size_b")) / F.lit(100.0 + percent) - F.lit(1e-9))
            rest_a, rest_b = [F.ceil(percent * F.col(c) / F.lit(100.0) - F.lit(1e-9)) - 1 for c in ("size_a", "size_b")]
            rest = F.when(F.col("end_a") < F.col("end_b"), rest_a).when(F.col("end_a") > F.col("end_b"), rest_b).otherwise(F.greatest(rest_a, rest_b))
            behind = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) - 1
            pairs = (matches.groupBy("a", "b").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("pos_a", "pos_b", "size_a", "size_b", "end_a", "end_b")])
                     .filter(F.col("n") + F.least(rest, behind) >= least).select("a", "b"))
            far = work.table(_compared(work.table(pairs, "pairs"), texts, size, percent), "far")
            whole = components(near.unionByName(far), work).select(F.col("id").alias("c"), "component")
            named = classes.select("s1", "s2", "n", "c").join(whole, "c", "left").select("s1", "s2", "n", F.coalesce("component", "c").alias("component_id"))
            placed = work.table(rows.drop("keys").join(named, ["s1", "s2", "n"], "left"), "placed")
            # A set that only rows with a null id have is named by its sums.
            group = [F.col("component_id"), *[F.when(F.col("component_id").isNull(), F.col(c)).alias(f"g{c}") for c in ("s1", "s2", "n")]]
            least = placed.filter("n > 0").groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("k")).select("k.id", "k.h", F.lit(True).alias("kept")).distinct()
            out = placed.join(least, placed["id"].eqNullSafe(least["id"]) & placed["h"].eqNullSafe(least["h"]), "left").select(
                placed["id"].alias(id), placed["h"].alias("text_hash"), F.col("n").alias("n_shingles"),
                F.coalesce("component_id", F.when(F.col("n") == 0, placed["id"])).alias("component_id"), (F.coalesce("kept", F.lit(False)) | (F.col("n") == 0)).alias("kept"))
            result = work.keep(out)
            often.unpersist()
            return result
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows, with all their columns, without near copies: of each component one row stays."""
    own, h, n, words = free_names(docs, "_id", "_h", "_n", "_words")
    stay = similar_sets(docs, id, text, size, percent).filter("kept").groupBy(F.col(id).alias(own), F.col("text_hash").alias(h)).agg(
        F.count("*").alias(n), F.max("n_shingles").alias(words))
    match = docs[id].cast("long").eqNullSafe(stay[own]) & F.xxhash64(docs[text]).eqNullSafe(stay[h])
    kept = docs.join(stay, match)
    repeated = (F.col(n) > 1) & (F.col(words) > 0)
    if stay.filter(repeated).isEmpty():
        return kept.drop(own, h, n, words)
    once = kept.filter(repeated).dropDuplicates([own, h])
    return kept.filter(~repeated).unionByName(once).drop(own, h, n, words)
