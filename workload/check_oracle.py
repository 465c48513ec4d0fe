"""Runs registered queries against DuckDB: ``python -m workload.check_oracle [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from workload.oracle import ORACLE
from workload.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def local_session(name: str = "newsmood", cpus: str = "8", **conf) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if the rows are the same, else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    order = sorted(names)
    theirs = sorted((tuple(repr(row[names.index(c)]) for c in order) for row in found.fetchall()))
    ours = sorted((tuple(repr(row[c]) for c in order) for row in df.collect()))
    if ours == theirs:
        return None
    only_ours, only_theirs = [r for r in ours if r not in set(theirs)], [r for r in theirs if r not in set(ours)]
    return (f"rows {len(ours)} <> {len(theirs)}; {len(only_ours)} only ours, {len(only_theirs)} only theirs\n"
            f"   {order}\n   ours   {[str(r)[:300] for r in only_ours[:2]]}\n"
            f"   theirs {[str(r)[:300] for r in only_theirs[:2]]}")


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(), connect(sf), 0
    for name in names:
        start = time.time()
        try:
            problem = difference(QUERIES[name](spark, sf), con, ORACLE[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.1f}s"
              + ("" if problem is None else f"\n   {problem}"), flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
