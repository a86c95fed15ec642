"""Runs registered queries next to their SQL and reports differences.

    python tests/compare.py [folder] [name ...]
"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connection(folder):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, name, fn, sql, folder):
    """(row count, list of differences) of one query."""
    df = fn(spark, folder)
    got = df.collect()
    if sql is None:
        return len(got), []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(got), [f"columns {sorted(df.columns)} != {sorted(names)}"]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return len(got), []
    only_a = list((set(a) - set(b)))[:3]
    only_b = list((set(b) - set(a)))[:3]
    return len(got), [f"{len(a)} rows vs {len(b)}", f"ours only {only_a}", f"sql only {only_b}"]


def main(argv):
    from pyspark.sql import SparkSession

    from shelfmark.plans.queries import ORACLE, QUERIES

    folder = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connection(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            n, diff = differences(spark, con, name, QUERIES[name], ORACLE.get(name), folder)
        except Exception as e:  # noqa: BLE001
            n, diff = -1, [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(diff)
        state = "DIFF" if diff else ("ok" if name in ORACLE else "ok (no sql)")
        print(f"{name:28s} {state:12s} {n:7d} rows {time.time() - start:6.1f}s", flush=True)
        for d in diff:
            print("     ", d[:900])
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
