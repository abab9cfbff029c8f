"""Side-by-side check of a registered Spark query against its DuckDB SQL.

Mirrors the driver's gate: same row count, same column names, and the same
multiset of rows (columns sorted by name, floats compared after rounding).
Run as a script: ``python tests/oracle.py [--plain] /root/testdata/sf0.01 [names...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(x):
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(_norm(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _norm(v)) for k, v in x.items()))
    if hasattr(x, "item") and not isinstance(x, (bytes, str)):
        try:
            return _norm(x.item())
        except Exception:
            pass
    return x


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], [tuple(_norm(r[k]) for k in order) for r in data]


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    import __spark_entry__ as e
    con = con or duck(sf_dir)
    q = e.queries()[name]
    sql = e.oracle_sql().get(name)
    t0 = time.time()
    scols, srows = rows_of_spark(q(spark, sf_dir))
    ts = time.time() - t0
    if sql is None:
        return True, f"{name}: rows-only {len(srows)} ({ts:.1f}s)"
    dcols, drows = rows_of_duck(con, sql)
    if scols != dcols:
        return False, f"{name}: columns differ spark={scols} duck={dcols}"
    if len(srows) != len(drows):
        return False, f"{name}: row count spark={len(srows)} duck={len(drows)}"
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    s_sorted, d_sorted = sorted(srows, key=key), sorted(drows, key=key)
    for a, b in zip(s_sorted, d_sorted):
        if a != b:
            return False, f"{name}: first differing row spark={a} duck={b}"
    return True, f"{name}: ok {len(srows)} rows ({ts:.1f}s)"


if __name__ == "__main__":
    # --plain: a session with Spark's defaults (200 shuffle partitions, no
    # library settings, no checkpoint dir), as a driver may hand in.
    args = [a for a in sys.argv[1:] if a != "--plain"]
    sf = args[0] if args else "/root/testdata/sf0.01"
    if "--plain" in sys.argv:
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        from tessera.session import get_session
        spark = get_session("local[8]", 8)
    import __spark_entry__ as e
    names = args[1:] or list(e.queries())
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, sf, con)
        except Exception as ex:  # report and continue
            ok, msg = False, f"{n}: ERROR {type(ex).__name__}: {str(ex)[:300]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
