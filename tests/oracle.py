"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def row_bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, query, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    """Number of rows and the differences found."""
    frame = query(spark, sf_dir)
    rows = [tuple(row) for row in frame.collect()]
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    problems = []
    if sorted(frame.columns) != sorted(columns):
        return len(rows), [f"columns {sorted(frame.columns)} and {sorted(columns)}"]
    # the types pandas sees have to agree as well
    ours = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    names = {"BIGINT": "bigint", "VARCHAR": "string", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}
    for name, kind in zip(columns, [str(d[1]) for d in result.description]):
        if names.get(kind, kind) != ours[name]:
            problems.append(f"type of {name}: {ours[name]} and {kind}")
    bag, other = row_bag(frame.columns, rows), row_bag(columns, expected)
    if bag != other:
        only_ours, only_theirs = bag - other, other - bag
        problems.append(
            f"{len(rows)} and {len(expected)} rows; only Spark {list(only_ours)[:2]}; only SQL {list(only_theirs)[:2]}"
        )
    return len(rows), problems


def main() -> None:
    """python tests/oracle.py [table folder] [part of a query name …]"""
    from pyspark.sql import SparkSession

    from siftmill import tune
    from siftmill.catalog import all_queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    connection = connect(sf_dir)
    for name, (query, sql) in all_queries().items():
        if len(sys.argv) > 2 and not any(part in name for part in sys.argv[2:]):
            continue
        start = time.time()
        try:
            if sql is None:
                count, problems = len(query(spark, sf_dir).collect()), ["no SQL"]
            else:
                count, problems = compare(spark, connection, query, sql, sf_dir)
        except Exception as problem:
            count, problems = -1, [f"{type(problem).__name__}: {str(problem)[:1500]}"]
        print(f"{'ok ' if not problems else '-- '} {name}: {count} rows, {time.time() - start:.2f} s {problems or ''}", flush=True)


if __name__ == "__main__":
    main()
