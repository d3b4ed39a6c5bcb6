"""Run queries() against oracle_sql() on one scale factor and report matches.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of values
(floats rounded to 6 places), like the driver's correctness gate.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EXACT = os.environ.get("ORACLE_EXACT") == "1"  # compare doubles bit-exactly

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    try:
        import numpy as np
        if isinstance(v, np.generic):
            v = v.item()
        if isinstance(v, np.ndarray):
            v = v.tolist()
    except ImportError:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {str(k): norm(x) for k, x in sorted(v.items())}
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([norm(r[i]) for i in order], default=str, ensure_ascii=False)
                   for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    import __spark_entry__ as E
    from narrata.session import local_session
    spark = local_session(8, 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    ok = bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        hs, ls = digest(srows, scols)
        hd, ld = digest(drows, dcols)
        same_cols = sorted(scols) == sorted(dcols)
        if same_cols and len(srows) == len(drows) and hs == hd:
            ok += 1
            print(f"ok   {name}: {len(srows)} rows {ts:.1f}s")
        else:
            bad += 1
            print(f"FAIL {name}: cols {sorted(scols)} vs {sorted(dcols)}; rows {len(srows)} vs {len(drows)}")
            a, b = set(ls), set(ld)
            for x in list(a - b)[:3]:
                print("   spark only:", x[:300])
            for x in list(b - a)[:3]:
                print("   duck  only:", x[:300])
    print(f"\n{ok} ok, {bad} failed, {len(qs)} queries, {len(sqls)} oracles")
    spark.stop()


if __name__ == "__main__":
    main()
