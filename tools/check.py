"""Compare registered queries with their reference SQL on one data folder.

Usage: python tools/check.py [folder] [name-prefix ...]
"""

import math
import sys
import time

import duckdb

from staylens.catalog import load
from staylens.catalog.tables import BASE
from staylens.session import build_session


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return [cell(x) for x in v]
        if isinstance(v, bool):
            return v
        return v

    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    start = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows only: {len(rows)} rows, {took:.1f}s"
    start = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    sql_took = time.time() - start
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = canonical(rows, df.columns), canonical(want, names)
    if got != want:
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} vs {len(want)} rows\n  spark {only[0]}\n  sql   {only[1]}"[:3000]
    kinds = [f"{c}:{k}" for c, k in df.dtypes]
    empty = " EMPTY" if not rows else ""
    return True, f"{len(rows)} rows, {took:.1f}s / {sql_took:.1f}s{empty}"


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                          "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = load()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, note = compare(spark, con, folder, name, fn, sql.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
