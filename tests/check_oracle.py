"""Compare every query with its SQL on one scale: python tests/check_oracle.py [sf_dir] [name ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return repr(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(float(v)) if abs(v) < 2**53 else repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, sf_dir):
    """None if equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    result = con.execute(entry.oracle_sql()[name])
    want_columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    a, b = canonical(got, df.columns), canonical(want, want_columns)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    differ = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(differ)} of {len(a)} rows differ, first {differ[0]}" if differ else None


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in names or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) > 0)
