"""Run queries and their SQL twins side by side: python -m checks.compare SF_DIR [names]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from checks.oracle import ORACLE_SQL
from checks.queries import QUERIES
from inkprint.session import local_session


def duck(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return value


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(picked, key=lambda row: [(v is None, str(v)) for v in row])


def differences(spark, connection, sf_dir: str, name: str) -> str | None:
    """None if both give the same rows, else what differs first."""
    df = QUERIES[name](spark, sf_dir)
    mine = sorted_rows(df.collect(), df.columns)
    if name not in ORACLE_SQL:
        return None if mine else "no rows"
    result = connection.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    theirs = sorted_rows(result.fetchall(), columns)
    if len(mine) != len(theirs):
        return f"{len(mine)} / {len(theirs)} rows"
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(different)} rows differ, first {different[0]}" if different else None


def main() -> int:
    sf_dir, *names = sys.argv[1:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = differences(spark, connection, sf_dir, name)
        except Exception as error:  # report all queries, then fail
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.1f}s  {problem or 'same'}", flush=True)
    print(f"{bad} problems")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
