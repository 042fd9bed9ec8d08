"""Compare registered queries with their SQL twins: python -m tests.compare <sf_dir> [names]."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r)
    )


def differences(spark, sf_dir, name, query, sql, con):
    df = query(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = normal(columns, cursor.fetchall())
    if got == expected:
        return None, len(got[1])
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}", len(got[1])
    left = [r for r in got[1] if r not in set(expected[1])][:3]
    right = [r for r in expected[1] if r not in set(got[1])][:3]
    return f"{len(got[1])} rows vs {len(expected[1])}; only ours {left}; only expected {right}", len(got[1])


def main() -> None:
    from tests.session import get_spark

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = get_spark(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, n = differences(spark, sf_dir, name, query, oracles[name], con)
            else:
                problem, n = None, query(spark, sf_dir).count()
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name} [{kind}] rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
