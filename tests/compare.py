"""Run queries on Spark and their SQL on DuckDB, and compare values exactly."""

from __future__ import annotations

import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = pathlib.Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else value + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark_df, connection, sql: str) -> list[str]:
    got = rows_of(spark_df.columns, spark_df.collect())
    relation = connection.sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    problems = []
    if sorted(spark_df.columns) != sorted(relation.columns):
        problems.append(f"columns {sorted(spark_df.columns)} against {sorted(relation.columns)}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows against {len(want)}")
    if got != want:
        only = [(a, b) for a, b in zip(got, want) if a != b]
        problems.append(f"{len(only)} rows differ, first {only[:2]}")
        kinds = {(type(x).__name__, type(y).__name__) for a, b in only[:50] for x, y in zip(a, b) if type(x) is not type(y)}
        if kinds:
            problems.append(f"types {kinds}")
    return problems
