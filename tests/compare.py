"""Spark results against DuckDB's over the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame


def plain(value):
    """A value that compares equal over both engines: floats to nine digits, lists as tuples."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return value


def duck(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    with duckdb.connect() as con:
        for name in os.listdir(sf_dir):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}{'/*' if os.path.isdir(f'{sf_dir}/{name}') else ''}')")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        return sorted(names), counted(names, found.fetchall())


def counted(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df: DataFrame, sf_dir: str, sql: str) -> None:
    names, wanted = duck(sf_dir, sql)
    assert sorted(df.columns) == names
    got = counted(df.columns, df.collect())
    assert got == wanted, (list((got - wanted).items())[:3], list((wanted - got).items())[:3])
