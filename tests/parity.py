"""Runs every query against its expected result: ``python tests/parity.py [folder] [key ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def normalised(names, rows):
    """Columns by name, rows sorted, so that only values count."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    out.sort(key=lambda row: tuple((v is None, str(v)) for v in row))
    return [names[i] for i in order], out


def kinds(rows):
    """Python types per column, None left out."""
    return [{type(v) for v in column if v is not None} for column in zip(*rows, strict=True)]


def compare(spark, con, folder: str, query, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, folder)
    got = normalised(df.columns, df.collect())
    cur = con.execute(sql)
    want = normalised([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    if kinds(got[1]) != kinds(want[1]):
        return f"types {kinds(got[1])} != {kinds(want[1])}"
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, expected, bad = connect(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if name not in expected or (sys.argv[2:] and name not in sys.argv[2:]):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, query, expected[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ")
    return min(bad, 1)


if __name__ == "__main__":
    sys.exit(main())
