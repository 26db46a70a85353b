"""Run registered queries next to their SQL in DuckDB.

``python -m tests.oracle sf0.01 [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return ("", "null")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("n", "nan")
        return ("n", repr(v + 0.0))
    if isinstance(v, int):
        return ("n", repr(float(v)))
    if isinstance(v, dict):
        return ("d", str(sorted((plain(k), plain(x)) for k, x in v.items())))
    if isinstance(v, (list, tuple)):
        return ("l", str([plain(x) for x in v]))
    return ("s", str(v))


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    started = time.time()
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return len(got), "rows-only", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(got), f"COLUMNS {sorted(df.columns)} != {sorted(names)}", took
    a, b = canon(df.columns, got), canon(names, want)
    if a == b:
        return len(got), "ok", took
    extra = [x for x in a if x not in set(b)][:2]
    lack = [x for x in b if x not in set(a)][:2]
    return len(got), f"DIFF rows {len(a)} vs {len(b)} extra={extra} lack={lack} cols={sorted(names)}", took


def main():
    import __spark_entry__ as entry
    from contestlake.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    picked = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if picked and name not in picked:
            continue
        started = time.time()
        try:
            rows, status, took = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            rows, status, took = -1, "ERROR " + str(e)[:1500], 0.0
        bad += status not in ("ok", "rows-only")
        print(f"{name:32s} {rows:8d} {time.time()-started:6.2f}s {status}", flush=True)
    print("not ok:", bad)


if __name__ == "__main__":
    main()
