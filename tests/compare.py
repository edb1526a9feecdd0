"""Side-by-side check of registered queries against their SQL in DuckDB.

    python -m tests.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
from datetime import date, datetime
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int,)):
        return float(v)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir, need_rows=False):
    """(message or None, spark seconds)."""
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    cols = df.columns
    if len(set(cols)) != len(cols):
        return f"duplicate columns {cols}", took
    if not got and (need_rows or sql is None):
        return "no rows", took
    if sql is None:
        return None, took
    cur = con.execute(sql)
    want = cur.fetchall()
    wcols = [c[0] for c in cur.description]
    c1, r1 = rows_of(cols, got)
    c2, r2 = rows_of(wcols, want)
    if c1 != c2:
        return f"columns {c1} vs {c2}", took
    if len(r1) != len(r2):
        return f"rows {len(r1)} vs {len(r2)}", took
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return f"{len(bad)} of {len(r1)} rows differ, columns {c1}: {bad[:2]}", took
    return None, took


def main():
    import sys, os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from chronolith.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in args.names or qs:
        try:
            message, took = compare(spark, con, name, qs[name], sqls.get(name), args.sf, need_rows=True)
        except Exception as e:  # noqa: BLE001
            message, took = f"ERROR {type(e).__name__}: {str(e)[:900]}", 0.0
        bad += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {took:6.2f}s {name}{'' if name in sqls else ' (no sql)'}"
              f"{'' if message is None else ': ' + message}", flush=True)
    print(f"{bad} failed")
    raise SystemExit(bad > 0)


if __name__ == "__main__":
    main()
