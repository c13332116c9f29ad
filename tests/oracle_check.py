"""Run queries() on Spark and oracle_sql() on DuckDB and compare the values.

Usage: python tests/oracle_check.py [--sf DIR] [name …]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    """A value in one comparable form per type; numbers keep int and float apart."""
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    values = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(values, key=repr)


def compare(df, con, sql):
    """Empty string when equal, else a description of the first difference."""
    s_names, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    d_names, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    if s_names != d_names:
        return f"columns {s_names} vs {d_names}", len(s_rows)
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} vs {len(d_rows)}; e.g. {[r for r in s_rows if r not in set(d_rows)][:2]} vs {[r for r in d_rows if r not in set(s_rows)][:2]}", len(s_rows)
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if repr(a) != repr(b)]
    if bad:
        a, b = bad[0]
        cells = [(n, x, y) for n, x, y in zip(s_names, a, b) if repr(x) != repr(y)]
        return f"{len(bad)} rows differ, first: {str(cells)[:600]}", len(s_rows)
    return "", len(s_rows)


def main(argv):
    import __spark_entry__ as entry
    from vacantia.session import local_session

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = local_session(8)
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in argv or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                message, n = compare(df, con, oracles[name])
            else:
                message, n = "", len(df.collect())
        except Exception as e:  # noqa: BLE001
            message, n = f"{type(e).__name__}: {str(e)[:700]}", 0
            if len(argv) == 1:
                traceback.print_exc()
        note = "" if name in oracles else " (rows only)"
        print(f"{'ok  ' if not message else 'FAIL'} {name}{note} rows={n} {time.time() - start:.2f}s {message}", flush=True)
        if message or n == 0:
            failed.append(name)
    print(f"{len(failed)} to look at: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
