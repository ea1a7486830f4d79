"""Compare registered queries with their SQL counterparts.

usage: python tools/check.py [--sf DIR] [name-prefix ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from wikimill.plans import ORACLES, QUERIES  # noqa: E402
from wikimill.plans.registry import BASE  # noqa: E402
from wikimill.session import build_session  # noqa: E402


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        return f"f:{v:.6f}"
    if isinstance(v, int):
        return f"i:{v}"
    return f"{type(v).__name__}:{v}"


def main() -> int:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    names = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    spark = build_session("check", "local[8]", 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            cols = sorted(df.columns)
            rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERR   {name}: {str(e)[:900]}", flush=True)
            continue
        t1 = time.time() - t0
        if name not in ORACLES:
            print(f"rows  {name} n={len(rows)} {t1:.1f}s {rows[:1]}"[:400], flush=True)
            continue
        t0 = time.time()
        try:
            con.execute(ORACLES[name])
            dcols = [d[0] for d in con.description]
            order = sorted(range(len(dcols)), key=lambda i: dcols[i])
            orows = sorted(tuple(norm(r[i]) for i in order) for r in con.fetchall())
        except Exception as e:
            bad += 1
            print(f"ORAERR {name}: {str(e)[:900]}", flush=True)
            continue
        t2 = time.time() - t0
        if sorted(dcols) != cols:
            bad += 1
            print(f"COLS  {name}: {cols} vs {sorted(dcols)}", flush=True)
        elif rows != orows:
            bad += 1
            a, b = set(rows), set(orows)
            print(f"DIFF  {name}: spark={len(rows)} sql={len(orows)}\n   only spark {sorted(a - b)[:2]}\n   only sql   {sorted(b - a)[:2]}"[:1800], flush=True)
        else:
            flag = " EMPTY" if not rows else ""
            print(f"ok    {name} n={len(rows)} spark {t1:.1f}s sql {t2:.1f}s{flag}", flush=True)
    print("bad", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
