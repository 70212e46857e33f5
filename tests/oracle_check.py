"""Run registered Spark queries and their SQL oracles side by side (DuckDB).

Usage: python tests/oracle_check.py [SF_DIR] [name ...]
Compares row count, column names and sorted values (floats to 9 digits).
"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows(df_cols, data):
    order = sorted(range(len(df_cols)), key=lambda i: df_cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def open_oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, sf, name, fn, sql):
    """Returns (ok, message)."""
    sdf = fn(spark, sf)
    scols = sdf.columns
    sdata = [tuple(r) for r in sdf.collect()]
    if sql is None:
        return True, f"{len(sdata)} rows (no oracle)"
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    odata = res.fetchall()
    if sorted(scols) != sorted(ocols):
        return False, f"columns {sorted(scols)} vs {sorted(ocols)}"
    a, b = rows(scols, sdata), rows(ocols, odata)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{len(a)} vs {len(b)} rows; first diffs {diff}"
    return True, f"{len(a)} rows"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from __spark_entry__ import oracle_sql, queries
    from lexicount.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf)
            scols = sdf.columns
            sdata = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(sdata)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            res = con.execute(sqls[name])
            ocols = [d[0] for d in res.description]
            odata = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(ocols):
            print(f"FAIL {name}: columns {sorted(scols)} vs {sorted(ocols)}")
            bad += 1
            continue
        a, b = rows(scols, sdata), rows(ocols, odata)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows; first diffs {diff}")
            bad += 1
        else:
            print(f"OK   {name}: {len(a)} rows {dt:.1f}s")
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
