"""Compare registered queries with their SQL on DuckDB: python tests/check.py [names…]"""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from newsloom.session import local_session


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}" if value else "0"
    if isinstance(value, bool):
        return str(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL, {took:.1f}s"
    start = time.time()
    con.execute(sql)
    columns = [d[0] for d in con.description]
    want = con.fetchall()
    sql_took = time.time() - start
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    note = f"{len(a)} vs {len(b)} rows, spark {took:.1f}s, sql {sql_took:.1f}s"
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{note}\n   spark only {only_a}\n   sql only   {only_b}"
    return True, note


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


if __name__ == "__main__":
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in sys.argv[1:] or entry.queries():
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
