import random
import statistics

import pytest
from pyspark.sql import functions as F

from veilframe import schemas
from veilframe.operators import trail
from veilframe.sources import logs, synthetic


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 2), (3, 100), (4, 1001), (5, 3000)])
def test_latency_statistics(spark, seed, n):
    rng = random.Random(seed)
    values = [rng.choice([5.0, 5.0, round(rng.expovariate(0.1), 3), rng.uniform(0, 1e6)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "latency_ms double").repartition(5)
    r = trail.latency_statistics(df).first()
    ordered = sorted(values)
    assert r.n == n and abs(r["mean"] - statistics.mean(values)) < 1e-6 * max(1, r["mean"])
    assert abs(r.p50 - statistics.median(values)) < 1e-9
    assert [r.p90, r.p95, r.p99] == [ordered[int(n * p)] for p in (0.90, 0.95, 0.99)]


def test_latest_record(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", "2", 3), ("a", "3", 3), ("b", "4", 2)], "user string, request_id string, t int")
    df = df.withColumn("timestamp_utc", F.timestamp_seconds("t"))
    rows = trail.latest_records(df, F.col("user")).collect()
    assert {(r.user, r.request_id) for r in rows} == {("a", "3"), ("b", "4")}


def record(i):
    span = ("secret", 0, 5, "[secret]", 0.95)
    return (str(i), None, ("analyst", "u", str(i)), "sql_query", "h", [span], [("secret", "redact", "r")], "q", "", [], [], "", "success", 1.5, None, "v", "m")


def test_log_files(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert logs.read_log(spark, path).count() == 0
    rows = spark.createDataFrame([record(1), record(2)], schemas.AUDIT)
    logs.append_log(rows.filter("request_id = '1'"), path)
    logs.append_log(rows.filter("request_id = '2'"), path)
    (tmp_path / "audit" / "extra.json").write_text("\n\n")
    back = logs.read_log(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert len(back.columns) == 17
    logs.clear_log(spark, path)
    assert logs.read_log(spark, path).count() == 0
    (tmp_path / "bad.json").write_text('{"request_id": \n')
    with pytest.raises(Exception, match="MALFORMED"):
        logs.read_log(spark, str(tmp_path / "bad.json")).collect()


def test_batch_write_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame([record(1)], schemas.AUDIT)
    for batch in (0, 1, 1):
        logs.write_batch(rows, path, batch)
    assert logs.read_log(spark, path).count() == 2


def test_read_golden(spark, tmp_path):
    path = tmp_path / "golden.jsonl"
    path.write_text('{"role": "analyst", "query": "SELECT 1", "expected_status": "success", "expected_rbac": "allow"}\n\n')
    row = logs.read_golden(spark, str(path)).first()
    assert row.expected_inbound_categories is None and len(row.case_id) == 16


def test_synthetic_bank(spark):
    bank = synthetic.bank(spark, 500, 20)
    c, a, t = (bank[n].cache() for n in ("customers", "accounts", "transactions"))
    assert c.count() == 500 and bank["advisors"].count() == 20
    per = [r["count"] for r in a.groupBy("customer_id").count().collect()]
    assert len(per) == 500 and set(per) == {1, 2, 3} and a.select("id").distinct().count() == a.count()
    assert set(r["count"] for r in t.groupBy("account_id").count().collect()) == {1, 2, 3, 4, 5}
    assert a.filter(~F.col("account_number").rlike(r"^\d{4}-\d{4}-\d{4}$")).count() == 0
    again = synthetic.customers(spark.newSession(), 500).repartition(7)
    assert sorted(map(str, again.collect())) == sorted(map(str, c.collect()))
    assert all(f.dataType.simpleString() in ("bigint", "string", "double") for n in bank for f in bank[n].schema.fields)


def test_stored_logs_join_without_shuffle(spark, sf):
    import uuid

    from veilframe.catalog import trail as entries
    from veilframe.sources import bucketed

    run = uuid.uuid4().hex
    logs_ = {name: getattr(entries, name)(spark, sf) for name in ("audit", "review", "vault")}
    half = lambda df, k: df.filter(F.pmod(F.xxhash64("request_id"), F.lit(2)) == k)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for part in (0, 1):  # two appends, one after the other
            stored = {name: bucketed.store_bucketed(half(df, part), f"{name}_{run}", buckets=4) for name, df in logs_.items()}
        joined = trail.correlate_stored(*(stored[n] for n in ("audit", "review", "vault")))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        columns = ["request_id", "status", "review_status", "review_detections", "vault_entries"]
        expected = trail.correlate(logs_["audit"], logs_["review"], logs_["vault"])
        assert sorted(map(str, joined.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in logs_:
            bucketed.drop_table(spark, f"{name}_{run}")
