import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests import compare
from tests.llm.cases import frame
from veilframe.llm import queries
from veilframe.llm.store import Workspace

SF = "/root/testdata/sf0.001"


def test_names():
    from __spark_entry__ import queries as registered

    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(registered())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, name):
    problem, rows = compare.differences(spark, SF, name, queries.QUERIES[name], queries.ORACLES[name], compare.duck(SF))
    assert problem is None and rows > 0


def test_stages_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, left = docs.columns, [{r.doc_id for r in docs.collect()}]
    with Workspace(spark, "stages") as work:
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = work.table(stage(spark, docs, SF), name.replace(" ", "-"))
            assert docs.columns == columns
            left.append({r.doc_id for r in docs.collect()})
            assert left[-1] <= left[-2]
        good = [i for i in left[0] if i in labels and labels[i].quality == 1]
        assert len([i for i in good if i in left[1]]) >= 0.97 * len(good)
        assert left[2] == left[3]  # passages go, documents stay
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == left[4]
        whole = corpus_pipeline.run(spark, SF)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces.collect()))


def test_awkward_rows_pass_every_stage(spark):
    clashing = ("extra", "_quality", "_spans", "_id", "_h", "_n", "_words", "_key")
    docs = frame(spark).withColumns({name: F.lit(k) for k, name in enumerate(clashing)})
    empty = docs.limit(0)
    with Workspace(spark, "awkward") as work:
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            nothing = stage(spark, empty, SF)
            assert nothing.count() == 0
            docs = work.table(stage(spark, docs, SF), f"{k}")
            if k < 4:
                assert [tuple(r) for r in docs.select(*clashing).distinct().collect()] == [tuple(range(len(clashing)))]
