"""Compare registered queries with their SQL twins: ``python tests/oracle.py [sf_dir] [name...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


def compare(df, con, sql) -> str | None:
    """None if equal, else what differs."""
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    if a == b:
        return None
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return f"rows {len(a)} / {len(b)}\n  cols {sorted(got_columns)}\n  spark {only_a}\n  sql   {only_b}"


def main(argv):
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = make_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        start = time.time()
        try:
            if name in oracles:
                found = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                found = None if fn(spark, sf_dir).collect() else "no rows"
        except Exception as e:  # report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += found is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if found is None else 'BAD '} {kind} {time.time() - start:6.2f}s {name}")
        if found:
            print("   ", found)
    print(f"{bad} differ")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
