import pytest

import __spark_entry__ as entry
from tests import compare
from veilframe import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()
# each of these runs the whole request log; one of them stands for all in the quick suite
HEAVY = {
    "audit_records", "review_queue", "evaluation_cases", "evaluation_metrics", "stream_gateway", "stream_admission", "stream_review_resumed",
    "gateway_vault", "row_results",
}


@pytest.fixture(scope="module")
def duck(sf):
    return compare.duck(sf)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_query(spark, sf, duck, name):
    problem, rows = compare.differences(spark, sf, name, QUERIES[name], ORACLES[name], duck)
    assert problem is None
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200
