"""Run every registered query beside its SQL and compare the results.

    python tools/check_queries.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from catalog import QUERIES, SQL  # noqa: E402
from tallyframe.session import local_session  # noqa: E402

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == 0 and math.copysign(1, v) < 0:
        return "-0.0"  # shown apart: some comparisons go by text
    return v


def key(row):
    return [(v is not None, str(type(v)), v if v is not None else 0) for v in row]


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: str(key(r)))


def kinds(rows):
    return [sorted({type(r[i]).__name__ for r in rows if r[i] is not None}) for i in range(len(rows[0]))] if rows else []


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = local_session(8, memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            mine = normal([tuple(r) for r in df.collect()], df.columns)
            took = time.time() - start
            if name not in SQL:
                print(f"rows  {name}: {len(mine[1])} rows {took:.2f}s", mine[1][:3])
                continue
            res = con.execute(SQL[name])
            theirs = normal(res.fetchall(), [d[0] for d in res.description])
            if mine == theirs and kinds(mine[1]) == kinds(theirs[1]):
                print(f"ok    {name}: {len(mine[1])} rows {took:.2f}s")
                continue
            bad += 1
            print(f"DIFF  {name}: {mine[0]} / {theirs[0]}; rows {len(mine[1])} / {len(theirs[1])}; types {kinds(mine[1])} / {kinds(theirs[1])}")
            left, right = set(mine[1]), set(theirs[1])
            print("   only spark ", sorted(left - right, key=str)[:4])
            print("   only duckdb", sorted(right - left, key=str)[:4])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:700]}")
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
