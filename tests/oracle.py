"""Run a registered query in Spark and its SQL in DuckDB and compare the results.

Columns are compared by name, rows as an order-insensitive multiset of normalised
values (timestamps as text, floats exact), like the driver's value hash.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == 0.0 and math.copysign(1.0, v) < 0:
            return "-0.0"  # a value hash tells the zeros apart, so do we
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return int(v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return float(v)
    except Exception:
        pass
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, name, fn, sql, sf_dir, con=None, show=5):
    df = fn(spark, sf_dir)
    spdf = df.toPandas()
    s_cols = list(spdf.columns)
    s_rows = list(spdf.itertuples(index=False, name=None))
    con = con or duck(sf_dir)
    dpdf = con.execute(sql).df()
    d_cols = list(dpdf.columns)
    d_rows = list(dpdf.itertuples(index=False, name=None))
    sc, sr = rows_of(s_cols, s_rows)
    dc, dr = rows_of(d_cols, d_rows)
    problems = []
    s_types = {c: str(t) for c, t in spdf.dtypes.items()}
    d_types = {c: str(t) for c, t in dpdf.dtypes.items()}
    if sc == dc and s_types != d_types:
        problems.append(f"dtypes differ: {[(c, s_types[c], d_types[c]) for c in sc if s_types[c] != d_types[c]]}")
    if sc != dc:
        problems.append(f"columns differ: spark={sc} duck={dc}")
    if len(sr) != len(dr):
        problems.append(f"row count spark={len(sr)} duck={len(dr)}")
    if not problems and sr != dr:
        from collections import Counter
        cs, cd = Counter(sr), Counter(dr)
        diff_s = list((cs - cd).elements())[:show]
        diff_d = list((cd - cs).elements())[:show]
        problems.append(f"values differ; spark-only={diff_s} duck-only={diff_d}")
    return len(sr), problems


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from logsift.plans.catalog import _entries
    from logsift.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = get_spark("local[8]", 8)
    con = duck(sf)
    bad = 0
    import time
    for name, (fn, sql) in _entries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            if sql:
                n, problems = compare(spark, name, fn, sql, sf, con)
            else:
                n, problems = fn(spark, sf).count(), []
        except Exception as e:  # noqa: BLE001
            n, problems = -1, [f"error: {type(e).__name__}: {str(e)[:600]}"]
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {name:24s} rows={n:7d} {'E' if sql else 'R'} {time.time() - t:6.2f}s", flush=True)
        for p in problems:
            print("     ", p[:3000], flush=True)
    print("bad:", bad)
