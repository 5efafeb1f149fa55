"""Runs catalog queries next to their DuckDB twins and compares whole results."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else repr(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty when both sides agree."""
    spark_cols, spark_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    duck_cols, duck_rows = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if spark_cols != duck_cols:
        return [f"columns {spark_cols} != {duck_cols}"]
    problems = []
    only_spark, only_duck = spark_rows - duck_rows, duck_rows - spark_rows
    if only_spark or only_duck:
        problems.append(f"{sum(spark_rows.values())} spark rows, {sum(duck_rows.values())} duck rows")
        problems.append(f"columns     {spark_cols}")
        problems += [f"only spark  {r}" for r in list(only_spark)[:3]]
        problems += [f"only duckdb {r}" for r in list(only_duck)[:3]]
    return problems
