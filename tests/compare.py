"""Run registered queries against their SQL: python tests/compare.py <sf_dir> [name ...]"""

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    """(rows, problem or None, seconds of Spark, seconds of SQL)"""
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    t1 = time.time()
    rel = con.sql(entry.oracle_sql()[name])
    if sorted(rel.columns) != cols:
        return len(got), f"columns {cols} != {sorted(rel.columns)}", t1 - t0, 0
    want = sorted(rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall(), key=repr)
    t2 = time.time()
    problem = None
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        problem = f"{len(got)} rows, want {len(want)}\n  only here: {extra}\n  only SQL: {missing}"
    return len(got), problem, t1 - t0, t2 - t1


if __name__ == "__main__":
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sys.argv[1])
    bad = 0
    for name in sys.argv[2:] or entry.oracle_sql():
        try:
            n, problem, a, b = compare(spark, con, sys.argv[1], name)
        except Exception as exc:  # report and go on with the next query
            n, problem, a, b = 0, f"{type(exc).__name__}: {str(exc)[:600]}", 0, 0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} rows={n:7d} spark={a:6.2f}s sql={b:6.2f}s {problem or ''}", flush=True)
    print("failures:", bad)
