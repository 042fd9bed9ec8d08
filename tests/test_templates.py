import json

import pytest
from pyspark.sql import functions as F

from veilframe.operators import governed, templates


def test_shapes_by_letters():
    shape, values = templates.shape_of("SELECT id FROM t WHERE a = 'it''s' AND b < 7")
    assert values == ("it's", 7) and shape.kinds == "sn"
    assert templates.shape_of("SELECT id FROM t WHERE a = 'x' AND b < 12")[0] == shape
    assert shape.text() == "SELECT _values._call_no,  id FROM t CROSS JOIN _values WHERE a = _values._value_0 AND b < _values._value_1"
    for text in ("SELECT id FROM t", "SELECT id FROM t WHERE a = 1.5", "SELECT `a` FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 1 -- x", "SELECT a FROM t WHERE b = 99999999999",
                 "SELECT a FROM t WHERE b = 'x", "SELECT a FROM t WHERE b = 1 UNION SELECT a FROM t WHERE b = 2", "SELECT a FROM t WHERE b = '\\'"):
        assert templates.shape_of(text) is None


@pytest.mark.parametrize("text,fine", [
    ("SELECT id, a AS x, t.* FROM t WHERE a = 5", True), ("SELECT * FROM t, u WHERE t.id = u.id AND u.a = 'x' AND t.b > 3", True),
    ("SELECT t.id FROM t JOIN u ON t.id = u.id WHERE 5 = a", True), ("SELECT id FROM t WHERE a > 5", False), ("SELECT id FROM t WHERE a = 5 OR b = 6", False),
    ("SELECT id FROM t WHERE a = 5 LIMIT 3", False), ("SELECT id FROM t WHERE a = 5 ORDER BY id", False), ("SELECT DISTINCT id FROM t WHERE a = 5", False),
    ("SELECT COUNT(*) FROM t WHERE a = 5", False), ("SELECT ROW_NUMBER() OVER (ORDER BY id) FROM t WHERE a = 5", False), ("SELECT 3 FROM t WHERE a = 5", False),
    ("SELECT id FROM t WHERE a = 5 GROUP BY id", False), ("SELECT id FROM t WHERE a = 5 AND id IN (SELECT 1)", False), ("SELECT id FROM t WHERE a LIKE 'x' AND b = 1", False),
    ("SELECT id FROM (SELECT id, a FROM t) x WHERE a = 5", False), ("SELECT id FROM t WHERE a + 1 = 5", False), ("SELECT id FROM t WHERE a = -5", True),
])
def test_what_runs_together(spark, text, fine):
    found = templates.shape_of(text)
    assert (found is not None and templates.runs_together(spark, text, found[0])) == fine


def test_texts_of_one_shape_equal_one_by_one(spark, bank, monkeypatch):
    """Every role and awkward value, with texts that fail or that only look alike among them."""
    texts = [f"SELECT id, first_name, ssn FROM customers WHERE id = {k}" for k in range(12)]
    texts += [f"SELECT c.id, a.id, a.* FROM customers c JOIN accounts a ON c.id = a.customer_id WHERE a.account_type = '{t}' AND c.id > {k}" for t in ("trust", "savings", "no''ne", "") for k in (5, 10, 58)]
    texts += [f"SELECT COUNT(*) AS n FROM accounts WHERE customer_id = {k}" for k in range(8)]
    texts += [f"SELECT id FROM customers WHERE first_name = {k}" for k in range(8)]  # fails by its cast
    texts += [f"SELECT id FROM nowhere WHERE id = {k}" for k in range(8)] + [f"SELECT id FROM customers WHERE id = '{k}'" for k in range(8)]
    calls = spark.createDataFrame([(r, t) for r in ("analyst", "compliance_officer") for t in texts] + [("analyst", None)], "role string, call_key string").filter("call_key is not null")
    ran = []
    whole = governed.governed_query
    monkeypatch.setattr(governed, "governed_query", lambda s, query, *a, **k: (ran.append(query), whole(s, query, *a, **k))[1])
    got = governed.query_rows(calls, bank).cache()
    rows = lambda df: sorted((r.role, r.call_key, r.row_json or "", r.error or "") for r in df.collect())
    together = rows(got)
    assert len(ran) < 90  # those that cannot run together, and a query a shape
    cut = {(r.role, r.call_key): r for r in governed.query_outputs(calls, bank, 300).collect()}
    monkeypatch.setattr(templates, "LEAST", 10**9)
    assert rows(governed.query_rows(calls, bank)) == together
    alone = {(r.role, r.call_key): r for r in governed.query_outputs(calls, bank, 10**6).collect()}
    for key, one in cut.items():
        assert (one.error is None) == (alone[key].error is None)
        if one.error is None:
            full = sorted(map(str, json.loads(alone[key].output)))
            assert one.output.endswith("[truncated]") if len(alone[key].output) > 300 else sorted(map(str, json.loads(one.output))) == full
    assert all("ssn" not in j for role, _, j, _ in together if role == "analyst")
    assert got.filter("error is null").select(F.countDistinct("role", "call_key", "position")).first()[0] == got.filter("error is null").count()


def test_a_shape_is_one_query_whatever_its_number_of_texts(spark, bank, monkeypatch):
    monkeypatch.setattr(governed, "_BATCH", 10)
    ran = []
    whole = governed.governed_query
    monkeypatch.setattr(governed, "governed_query", lambda s, query, *a, **k: (ran.append(query), whole(s, query, *a, **k))[1])
    calls = spark.range(40).selectExpr("'analyst' as role", "concat('SELECT id, email FROM customers WHERE id = ', id) as call_key")
    assert {r.call_key: json.loads(r.row_json)["id"] for r in governed.query_rows(calls, bank).collect()} == {
        f"SELECT id, email FROM customers WHERE id = {r.id}": r.id for r in bank["customers"](spark).filter("id < 40").collect()
    }
    assert len(ran) == 1
    # a text that fails costs those of its part alone
    ran.clear()
    odd = spark.createDataFrame([("analyst", f"SELECT id FROM customers WHERE id = '{'x' if i == 7 else i}'") for i in range(30)], "role string, call_key string")
    out = governed.query_rows(odd, bank).collect()
    assert [r.call_key for r in out if r.error] == ["SELECT id FROM customers WHERE id = 'x'"]
    wanted = bank["customers"](spark).filter("id < 30 and id <> 7").collect()
    assert sorted(json.loads(r.row_json)["id"] for r in out if not r.error) == sorted(r.id for r in wanted)
    assert len(ran) < 30
