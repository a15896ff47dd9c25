"""Run registered queries against their DuckDB oracles: ``python -m tests.oracle_check [ids...]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def compare(spark_df, con, sql):
    got = rows_of(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}", len(got[1])
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}", len(got[1])
    types = [(n, type(a).__name__, type(b).__name__) for n, a, b in zip(got[0], got[1][0], want[1][0]) if a is not None and type(a) is not type(b)] if got[1] else []
    return (f"types {types}" if types else None), len(got[1])


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from kinetable.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(8), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    failed = 0
    for name in queries:
        if not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, n = compare(queries[name](spark, sf), con, oracles[name])
            else:
                n = queries[name](spark, sf).count()
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        failed += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name:8} {n:7} rows {time.time() - start:6.2f}s {'' if name in oracles else '(no oracle) '}{problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
