"""Compares queries with their SQL twins in DuckDB: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def compare(spark, sf_dir: str, name: str, fn, sql: str, con) -> str:
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        return f"{len(got[1])} and {len(want[1])} rows; only here {sorted(a - b)[:2]}; only in SQL {sorted(b - a)[:2]}"
    return ""


if __name__ == "__main__":
    import time

    import __spark_entry__ as e
    from stackroom.session import build_session

    spark = build_session(master="local[6]", spark__sql__shuffle__partitions="6", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sys.argv[1])
    sql, bad = e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            if name in sql:
                why = compare(spark, sys.argv[1], name, fn, sql[name], con)
                n = "" if why else con.execute(f"SELECT count(*) FROM ({sql[name]})").fetchone()[0]
            else:
                why, n = "", f"{fn(spark, sys.argv[1]).count()} (rows only)"
        except Exception as x:
            why, n = f"{type(x).__name__}: {str(x)[:600]}", ""
        bad += bool(why)
        print("BAD " if why else "ok  ", name, n, f"{time.time() - t:.1f}s", why[:900], flush=True)
    print("bad:", bad)
