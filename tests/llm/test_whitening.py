import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def _table(spark, data):
    df = spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA)
    for name in ("id", "v", "x", "index", "part", "place", "n", "vector", "component", "deviation"):
        df = df.withColumn(name, F.lit("other"))
    return df.repartition(4)


def _check(got, data, size, components=32):
    """Every figure against plain numpy; signs are free but one per component."""
    good = [(i, v) for i, v in data if v and len(v) == size and all(c is not None and np.isfinite(c) and abs(c) < 2 ** 40 for c in v)]
    x = np.floor(64 * np.array([v for _, v in good])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in x]
    centred = (n * x - s) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    order = [k for k in np.argsort(-values) if values[k] > values.max() * 1e-12][:components]
    white = centred @ axes[:, order] / np.sqrt(values[order])
    assert len(got) == n * len(order)
    place = {}
    for k, (i, _) in enumerate(good):
        place.setdefault(i, []).append(k)
    for c in range(1, len(order) + 1):
        rows = [r for r in got if r.component == c]
        assert {r.n for r in rows} == {n}
        assert rows[0].explained == pytest.approx(values[order[c - 1]] / np.trace(cov), rel=1e-9)
        rows.sort(key=lambda r: (str(r.vec_id), r.whitened))
        for sign in (1, -1):
            want = sorted(((str(i), sign * float(white[k, c - 1])) for i, ks in place.items() for k in ks))
            if np.allclose([w for _, w in want], [r.whitened for r in rows], rtol=1e-7, atol=1e-7):
                break
        else:
            raise AssertionError(f"component {c} differs")
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d if d < 2 ** 63 else None) for (i, _), d in zip(good, deviation))
    assert got[0].identity_error < 1e-8


def test_whitening_equals_numpy(spark):
    from veilframe.llm.whitening import whiten

    rng = np.random.default_rng(3)
    mixed = rng.standard_normal((3000, 40)) @ rng.standard_normal((40, 40))
    data = [(i, v.tolist()) for i, v in enumerate(mixed)]
    data += [(0, data[1][1]), (0, data[1][1]), (None, data[5][1]), (9000, [0.0] * 40)]
    data += [(9001 + k, v) for k, v in enumerate([None, [], [None] + [1.0] * 39, [float("nan")] + [1.0] * 39, [float("-inf")] + [1.0] * 39, [1e300] + [1.0] * 39, [1.0] * 39])]
    _check(whiten(_table(spark, data)).collect(), data, 40)


def test_whitening_of_awkward_tables(spark):
    from veilframe.llm.whitening import whiten

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for data in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whiten(_table(spark, data))
        assert out.columns == names and out.collect() == []
    # One direction only, and entries so large that squares are beyond 64 bits.
    line = [(i, [i * 1e9, 2e9 * i, 0.0]) for i in range(5)]
    _check(whiten(_table(spark, line)).collect(), line, 3)
    wide = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).standard_normal((60, 70)))]
    _check(whiten(_table(spark, wide), components=10).collect(), wide, 70, 10)


def test_scatter_is_split_over_tasks(spark):
    """No single task gets all blocks of the rows."""
    from veilframe.llm import whitening

    rows = spark.range(20_000).select(F.col("id").alias("index"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    matrix = whitening._block_matrix(rows, 20_000, 2)
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, 8)
    lineage = bytes(product.blocks().toDebugString().encode()).decode()
    assert "(8) " in lineage
    i = np.arange(20_000.0)
    assert np.allclose(whitening._scatter(matrix, 8), [[(i * i).sum(), i.sum()], [i.sum(), 20_000]])
