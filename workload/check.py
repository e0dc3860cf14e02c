"""Run registered queries next to their SQL and compare all rows.

    python -m workload.check [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0 if v != 0 else 0.0)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return False, f"{len(got)} rows, {took:.1f}s, but no SQL to compare with"
    start = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    note = f"{len(got)} rows, {took:.1f}s, SQL {time.time() - start:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return False, f"{note}; {len(a)} vs {len(b)} rows\n   spark {str(only_a)[:700]}\n   sql   {str(only_b)[:700]}"
    return True, note


def main() -> int:
    from sheaf.session import local_session
    from workload import ORACLES, QUERIES

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(a in n for a in args)]
    spark = local_session(8, "check")
    con = connect(sf_dir)
    failed = []
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:1200]}"
        print(("ok   " if ok else "FAIL ") + f"{name}: {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
