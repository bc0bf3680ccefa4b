"""Side-by-side check of registered queries against their SQL form.

Usage: python -m tests.compare SF_DIR [name ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}f"
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    ok = got == want
    note = ""
    if not ok:
        if got[0] != want[0]:
            note = f"columns {got[0]} vs {want[0]}"
        else:
            a, b = set(got[1]), set(want[1])
            note = f"rows {len(got[1])} vs {len(want[1])}; spark only {list(a - b)[:2]}; sql only {list(b - a)[:2]}"
    return ok, len(got[1]), t1 - t0, t2 - t1, note


def main(argv):
    from pyspark.sql import SparkSession

    from boxtrail.plans.catalog import ORACLE, QUERIES

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(argv[0])
    names = argv[1:] or list(QUERIES)
    bad = 0
    for n in names:
        try:
            if n in ORACLE:
                ok, rows, a, b, note = compare(spark, con, argv[0], QUERIES[n], ORACLE[n])
            else:
                t0 = time.time()
                rows, ok, note, b = QUERIES[n](spark, argv[0]).count(), True, "rows only", 0.0
                a = time.time() - t0
            print(f"{'ok ' if ok and rows else 'BAD'} {n:28s} rows={rows:<8d} spark={a:6.2f}s duck={b:6.2f}s {note}", flush=True)
            bad += not (ok and rows)
        except Exception as e:
            bad += 1
            print(f"ERR {n:28s} {type(e).__name__}: {str(e)[:700]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
