"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector x is rotated at random; its code is the signs of the rotated coordinates, which is
the corner o of the cube nearest to it. Stored with it is the correction factor <o, x>. For another
vector q, <o, q> / <o, x> estimates <x, q> without bias, with an error that falls with the number
of dimensions; <o, x> also bounds it for certain, since the angle between x and q is at least
the difference of their angles to o. Pairs whose estimate plus `sure` standard errors, and whose
certain bound, reach the threshold are computed again in double precision; no other pair is.

Pairs are looked for among vectors of one label that agree in some band of code bits. The
number of bands follows from the number of bits so that a pair at the threshold is missed with a
probability of at most `miss`; closer pairs are missed less. A bucket of more than `tile` vectors
is dealt into parts, and each two parts meet in a task of their own."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.components import components
from veilframe.llm.store import Workspace

THRESHOLD = 0.93
#: Vectors that a bucket should hold, which sets the number of bits in a band.
BUCKET = 512
TILE = 512
MISS = 0.002
SURE = 4.0
_SEED = 5


def rotation(size: int, turn: int) -> np.ndarray:
    """A random orthogonal matrix; the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng((_SEED, size, turn)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def band_count(bits: int, threshold: float, miss: float) -> int:
    """Bands of so many bits in which a pair at the threshold agrees at least once but for `miss`."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree))) if bits else 1


def band_keys(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """For each vector the number that its code bits make in each band."""
    size = unit.shape[1]
    turns = -(-bits * bands // size) if bits else 0
    signs = np.concatenate([unit @ rotation(size, 1 + t) > 0 for t in range(turns)], 1) if turns else np.zeros((len(unit), 0), bool)
    keys = np.zeros((len(unit), bands), dtype=np.int64)
    for b in range(bands):
        for k in range(bits):
            keys[:, b] = keys[:, b] << 1 | signs[:, b * bits + k]
    return keys


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their codes as +-1 / sqrt(size), and the correction factors."""
    turned = unit @ rotation(unit.shape[1], 0)
    corner = np.where(turned > 0, 1.0, -1.0) / math.sqrt(unit.shape[1])
    return turned, corner, np.clip((turned * corner).sum(1), 1e-9, 1.0)


def may_reach(turned: np.ndarray, corner: np.ndarray, factor: np.ndarray, threshold: float, sure: float) -> np.ndarray:
    """For each vector (row) and code (column): whether estimate and bound leave the threshold open."""
    product = turned @ corner.T
    size = turned.shape[1]
    error = np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(max(size - 1, 1))
    slack = 1e-9
    confident = product / factor + sure * error >= threshold - slack
    certain = product * factor + np.sqrt(np.maximum(1 - np.minimum(product ** 2, 1), 0) * np.maximum(1 - factor ** 2, 0)) >= threshold - slack
    return confident & certain


def _tile_links(threshold: float, sure: float):
    """One tile in: vectors of one bucket in one or two parts. Out: links counted per vector, and
    edges that connect what is linked."""

    def run(table: pa.Table) -> pa.Table:
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        band = table.column("band")[0].as_py()
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), dtype="<f8").reshape(len(ids), -1)
        keys = np.stack(table.column("keys").to_numpy())
        a = np.flatnonzero(own == own.min())
        b = np.flatnonzero(own == own.max())
        turned, corner, factor = codes(unit)
        i, j = np.nonzero(may_reach(turned[a], corner[b], factor[b], threshold, sure))
        i, j = a[i], b[j]
        if own.min() == own.max():
            i, j = i[i < j], j[i < j]
        exact = np.concatenate([np.einsum("ij,ij->i", unit[i[s:s + 65536]], unit[j[s:s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        i, j = i[exact >= threshold], j[exact >= threshold]
        # A pair that agrees in several bands counts in the first.
        first = np.concatenate([(keys[i[s:s + 65536]] == keys[j[s:s + 65536]]).argmax(1) for s in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
        i, j = i[first == band], j[first == band]
        links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        root = np.arange(len(ids))
        while True:  # smallest place that links lead to inside the tile
            best = root.copy()
            np.minimum.at(best, i, root[j])
            np.minimum.at(best, j, root[i])
            best = best[best]
            if (best == root).all():
                break
            root = best
        some = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[some]), "other": pa.array(ids[root[some]]), "n": pa.array(links[some], pa.int64())})

    return run


def near_vectors(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, miss: float = MISS, sure: float = SURE, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) per vector: others of the same label at a cosine of at
    least `threshold`, the smallest id that such links lead to, and whether it is the vector's own.

    Vectors that are null, zero, or hold null or non-finite components, and those without a
    label, link with nothing; neither do vectors of different lengths. Rows with a null id link
    with nothing and have no component. Of rows that share an id, the one with the smallest
    (label, vector) counts. Other columns are not read. Every link is confirmed in double
    precision; a pair just at the threshold is missed with a probability of at most `miss`."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    kind = every.schema["label"].dataType.simpleString()
    with Workspace(spark, "embeddings") as work:
        single = every.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
        rows = work.table(single.withColumn("use", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & usable, F.lit(False))), "vectors")
        good = rows.filter("use").select("id", "label", "v", F.size("v").alias("d"))
        sizes = good.groupBy("label", "d").agg(F.count("*").alias("m"))
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / F.lit(float(bucket))))).cast("int")
        sizes = sizes.select("label", "d", bits.alias("bits"))

        def expand(batches):
            for batch in batches:
                d, bit = batch.column("d").to_numpy(), batch.column("bits").to_numpy()
                for size, b in sorted(set(zip(d.tolist(), bit.tolist()))):
                    at = np.flatnonzero((d == size) & (bit == b))
                    unit = np.stack(batch.column("v").take(pa.array(at)).to_numpy(zero_copy_only=False)).astype(np.float64)
                    unit = unit / np.abs(unit).max(1, keepdims=True)
                    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                    bands = band_count(b, threshold, miss)
                    keys = band_keys(unit, b, bands)
                    row = np.repeat(at, bands)
                    raw = unit.astype("<f8").tobytes()
                    step = 8 * size
                    units = [raw[k * step:(k + 1) * step] for k in range(len(at)) for _ in range(bands)]
                    flat = np.repeat(keys, bands, axis=0)
                    yield pa.record_batch({
                        "id": batch.column("id").take(pa.array(row)), "label": batch.column("label").take(pa.array(row)), "d": pa.array(d[row], pa.int32()),
                        "band": pa.array(np.tile(np.arange(bands), len(at)), pa.int32()), "key": pa.array(keys.ravel()),
                        "keys": pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands), pa.int32()), pa.array(flat.ravel())), "unit": pa.array(units, pa.binary())})

        place = ["label", "d", "band", "key"]
        spread = good.join(sizes, ["label", "d"]).mapInArrow(expand, f"id long, label {kind}, d int, band int, key long, keys array<long>, unit binary")
        placed = work.table(spread, "places")
        full = placed.groupBy(*place).agg(F.count("*").alias("m")).filter(F.col("m") > tile).select(*place, F.ceil(F.col("m") / tile).cast("int").alias("parts"))
        dealt = (placed.join(full, place, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
                 .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")))
        found = work.table(dealt.select(*place, "low", "high", "id", "own", "keys", "unit").groupBy(*place, "low", "high")
                           .applyInArrow(_tile_links(threshold, sure), "id long, other long, n long"), "links")
        linked = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), work).withColumnRenamed("component", "component_id")
        counted = found.groupBy("id").agg(F.sum("n").alias("n_links"))
        out = (rows.select("id").join(counted, "id", "left").join(linked, "id", "left")
               .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))
        return work.keep(out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id))
