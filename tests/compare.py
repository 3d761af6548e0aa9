"""Run registered queries next to their SQL: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v + 0.0))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


SQL_TYPE = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def compare(spark, con, name, fn, sql, sf):
    """(ok, message, physical plan)"""
    t0 = time.time()
    df = fn(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    got = rows_of(df.columns, df.collect())
    print(f"[{time.time() - t0:.1f}s]", end=" ")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}", plan
    odd = {n: (t, types[n]) for n, t in df.dtypes if SQL_TYPE.get(t, t) != types[n]}
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}", plan
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}", plan
    return (not odd), f"{len(got)} rows{' types ' + str(odd) if odd else ''}", plan


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pulsegrid.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            if name in oracles:
                ok, text, _ = compare(spark, con, name, fn, oracles[name], sf)
            else:
                ok, text = True, f"{len(fn(spark, sf).collect())} rows (no SQL)"
        except Exception as e:
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, f"{time.time() - t:.1f}s", text, flush=True)
    print("failed:", failed)
