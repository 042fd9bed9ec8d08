"""Whitening of vectors by Spark MLlib's BlockMatrix.

Entries become whole numbers, so sums and deviations are exact. Rows are numbered from 0 without
gaps and centred; their blocks make a BlockMatrix X. Its transpose times itself, the scatter, is a
matrix of dimensions only, whose eigenvectors are taken on the driver. X times the whitening matrix
projects all rows. The middle dimension of the transposed product is split, since MLlib else
sends all blocks to the one task that makes the one block of the result."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.store import Workspace

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
#: Numbers in one block, 8 bytes each, and its rows at most.
BLOCK_NUMBERS = 1 << 20
BLOCK_ROWS = 1024
#: Entries from this size on have no exact sum in 64 bits and count as not finite.
LARGEST = float(1 << 40)
#: Components with less than this share of the largest variance are rounding, not directions.
_RELATIVE = 1e-12


def _block_matrix(rows: DataFrame, n: int, size: int) -> BlockMatrix:
    """From (index, v)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, size).toBlockMatrix(max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // size)), size)


@contextmanager
def _kept(matrix: BlockMatrix) -> Iterator[BlockMatrix]:
    """Blocks stay with the executors while they are read several times; lost ones are made again
    from the rows, which are a written table."""
    matrix.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield matrix
    finally:
        matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def _scatter(matrix: BlockMatrix, tasks: int) -> np.ndarray:
    """The matrix, transposed, times itself; small enough for the driver, as wide as the rows."""
    turned = matrix.transpose()
    # PySpark's multiply() has no argument for the number of splits, the JVM's has.
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, tasks)
    whole = BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (whole + whole.T) / 2


def _column_sums(rows: DataFrame, column: str, kind: str) -> list:
    """Sums of arrays' entries by place: partial ones per batch, then a row a place."""
    dtype = np.int64 if kind == "long" else np.float64

    def add(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column(0)
                table = column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, -1)
                yield pa.record_batch({"place": pa.array(np.arange(table.shape[1]), pa.int32()), "s": pa.array(table.sum(0))})

    total = "decimal(38,0)" if kind == "long" else "double"
    sums = rows.select(column).mapInArrow(add, f"place int, s {kind}").groupBy("place").agg(F.sum(F.col("s").cast(total)).alias("s"))
    return [r.s for r in sums.orderBy("place").collect()]  # one row a dimension


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """n * x - sums as doubles, and its exact squares added up per row; None beyond 64 bits."""
    widest = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums))
    if widest < 1 << 62:
        d = n * x - np.array(sums, dtype=np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * max(x.shape[1], 1) < 1 << 62:
            return d.astype(np.float64), (d * d).sum(1).tolist()
    d = x.astype(object) * n - np.array(sums, dtype=object)
    squares = [sum(int(c) ** 2 for c in row) for row in d]
    return d.astype(np.float64), [s if s < 1 << 63 else None for s in squares]


def whiten(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per vector and component.

    A vector's entries c count as floor(64 c) + 1000000. Dropped are vectors that are null, empty,
    hold null or non-finite entries or ones of 2 ** 40 and more, and those with another number of
    entries than most have (of equally many, the smaller number). n: vectors left; deviation: squared
    distance of n times the vector from the sum of all, null if beyond 64 bits; whitened: the
    centred vector on that component over its standard deviation; explained: the component's share
    of all variance; identity_error: how far the covariance of `whitened` is from the identity.
    Components come by falling variance; those without variance are left out, so equal vectors
    have none and give no rows, like an empty table. Repeated rows and null ids count and stay as they
    are. Among components of equal variance the choice is the solver's. Other columns are not read."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    kind = every.schema["id"].dataType.simpleString()
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    good = every.filter(usable)
    result = f"{id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    modes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head(1)
    if not modes:
        return spark.createDataFrame([], result)
    size, n = modes[0].d, modes[0].n
    with Workspace(spark, "whitening") as work:
        whole = good.filter(F.size("v") == size).select("id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))

        def number(batches):
            part, at = TaskContext.get().partitionId(), 0
            for batch in batches:
                place = np.arange(at, at + batch.num_rows)
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(place)], ["id", "x", "part", "place"])

        rows = work.table(whole.mapInArrow(number, f"id {kind}, x array<long>, part int, place long"), "rows")
        sums = [int(s) for s in _column_sums(rows, "x", "long")]
        sizes = rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a task
        ends = np.cumsum([r.n for r in sizes]).tolist()
        begins = {r.part: end - r.n for r, end in zip(sizes, ends)}

        def centre(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, size)
                apart, squares = _deviations(x, n, sums)
                index = np.array([begins[p] for p in batch.column(2).to_pylist()], dtype=np.int64) + batch.column(3).to_numpy()
                offsets = pa.array(np.arange(0, size * batch.num_rows + 1, size), pa.int32())
                yield pa.record_batch({
                    "index": pa.array(index), "id": batch.column(0), "deviation": pa.array(squares, pa.int64()),
                    "v": pa.ListArray.from_arrays(offsets, pa.array((apart / n).ravel()))})

        centred = work.table(rows.mapInArrow(centre, f"index long, id {kind}, deviation long, v array<double>"), "centred")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        with _kept(_block_matrix(centred, n, size)) as matrix:
            values, axes = np.linalg.eigh(_scatter(matrix, tasks) / n)
            order = [k for k in np.argsort(-values) if values[k] > values.max() * _RELATIVE][:components]
            if not order:
                return spark.createDataFrame([], result)
            turn = axes[:, order] / np.sqrt(values[order])
            narrow = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(size, len(order), turn.ravel("F").tolist()))], 1), size, len(order), size, len(order))
            projected = matrix.multiply(narrow).toIndexedRowMatrix()
            # The rows as a table; IndexedRowMatrix.rows would make each a Python object.
            white = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
            white = work.table(white.select("index", vector_to_array("vector").alias("v")), "white")
        trace = float(values.sum())
        means = np.array(_column_sums(white, "v", "double")) / n
        shift = F.array(*[F.lit(float(m)) for m in means])
        level = white.select("index", F.zip_with("v", shift, lambda a, b: a - b).alias("v"))
        with _kept(_block_matrix(level, n, len(order))) as matrix:
            error = float(np.abs(_scatter(matrix, tasks) / n - np.eye(len(order))).max())
        share = F.array(*[F.lit(float(values[k] / trace)) for k in order])
        out = (centred.select("index", F.col("id"), "deviation").join(white, "index")
               .select("id", "deviation", F.posexplode("v").alias("place", "whitened"))
               .select(F.col("id").alias(id), (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(share, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error")))
        return work.keep(out)
