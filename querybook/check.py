"""Run queries on Spark and their SQL on DuckDB, and compare the results.

    python -m querybook.check [--sf /root/testdata/sf0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from querybook import ORACLES, QUERIES


def local_session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("querybook")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return repr(x)
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
        return repr(x)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str:
    """Empty text when both sides agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLES:
        return ""
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    expected = normal(result.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    if got != expected:
        bad = [(a, b) for a, b in zip(got, expected) if a != b]
        return f"{len(bad)} rows differ over {sorted(names)}, first: {bad[0]}"
    if not got:
        return "no rows on either side"
    return ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session(), duck(args.sf)
    wanted = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    bad = 0
    for name in wanted:
        start = time.perf_counter()
        try:
            problem = compare(spark, con, args.sf, name)
        except Exception as error:  # report it and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.perf_counter() - start:.2f}s {problem}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
