"""Joins with a table of one row per key, in which no key is one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most; their rows are narrow.
HOT = 1 << 16


def by_weight(rows: DataFrame, values: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with what ``values`` has for their keys; ``how`` is inner or left.

    ``values`` has one row per key, and in ``weight`` how many of ``rows`` have that key. Keys with more
    than one in ``HOT`` of all rows so counted are fewer than ``HOT``: they are broadcast, so their rows
    stay where they are. The others are shuffled by key. Up to ``HOT`` values are broadcast as they are.
    Null keys meet nothing. ``rows`` and ``values`` are read more than once, so they are written before,
    or cheap to make again.
    """
    n, every = values.agg(F.count("*"), F.sum(weight)).first()
    if n <= HOT:
        return rows.join(F.broadcast(values), keys, how)
    hot = F.broadcast(values.filter(F.col(weight) > every // HOT))
    rest = rows.join(hot, keys, "left_anti").join(values.filter(F.col(weight) <= every // HOT), keys, how)
    return rows.join(hot, keys).unionByName(rest)
