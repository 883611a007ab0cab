"""Compares a registered query with its SQL: ``python tests/compare.py NAME... [--sf DIR]``."""

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(plain, x)) + "]"
        return str(x)

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def session():
    return (
        SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").getOrCreate()
    )


def compare(spark, name, sf, queries, oracles):
    began = time.time()
    df = queries[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - began
    if name not in oracles:
        return f"{name}: {len(got[1])} rows, no SQL, {took:.1f} s"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(oracles[name])
    want = rows_of([x[0] for x in cur.description], cur.fetchall())
    if got == want:
        return f"{name}: {len(got[1])} rows match, {took:.1f} s"
    diff = [x for x in zip(got[1], want[1]) if x[0] != x[1]][:3]
    return f"{name}: MISMATCH {got[0]} {want[0]} {len(got[1])} {len(want[1])} {diff}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    for name in args or q:
        try:
            print(compare(spark, name, sf, q, o), flush=True)
        except Exception as x:
            print(f"{name}: ERROR {str(x)[:1500]}", flush=True)
