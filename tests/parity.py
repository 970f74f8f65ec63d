"""Compare queries with their SQL on one data directory: python -m tests.parity DIR [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb


def tables(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{path}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows(cols, data) -> Counter:
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in at) for r in data)


def compare(spark, path: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, path)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = tables(path).execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} and {sorted(cols)}"
    extra, lack = got - want, want - got
    return not extra and not lack, f"{sum(got.values())} rows; extra {list(extra.items())[:3]}; lacking {list(lack.items())[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    qs, sq = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or list(qs):
        t = time.time()
        try:
            if name in sq:
                ok, say = compare(s, sys.argv[1], qs[name], sq[name])
            else:
                ok, say = True, f"no SQL; {qs[name](s, sys.argv[1]).count()} rows"
        except Exception as x:  # noqa: BLE001
            ok, say = False, f"{type(x).__name__}: {str(x)[:1500]}"
        print("ok " if ok else "BAD", name, f"{time.time() - t:.1f}s", say, flush=True)
