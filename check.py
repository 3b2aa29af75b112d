"""Run registered queries on Spark and their SQL twins on DuckDB and compare the results."""

from __future__ import annotations

import argparse
import sys
import time
from collections import Counter

import duckdb

from harvestlens.catalog import load
from harvestlens.catalog.base import TABLES
from harvestlens.session import build_session


def rows_of(df):
    names = sorted(df.columns)
    return names, Counter(tuple(r[n] for n in names) for r in df.collect())


def twin_rows(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    place = [rel.columns.index(n) for n in names]
    return names, Counter(tuple(r[i] for i in place) for r in rel.fetchall())


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*", help="query names or parts of names; all when empty")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name, q in load().items():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            start = time.time()
            names, got = rows_of(q.run(spark, args.sf))
            took = time.time() - start
            if q.sql is None:
                print(f"rows  {name}: {sum(got.values())} rows, {took:.1f}s", flush=True)
                continue
            want_names, want = twin_rows(con, q.sql)
            ok = names == want_names and got == want
            print(f"{'ok   ' if ok else 'DIFF '} {name}: {sum(got.values())}/{sum(want.values())} rows, {took:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   ", names, "\n    spark only", list((got - want).items())[:3], "\n    sql only  ", list((want - got).items())[:3])
        except Exception as e:
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
    print("differences:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
