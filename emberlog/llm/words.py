"""Words and word sequences, as native expressions.

A word is a run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda's variable is bound, never inlined."""
    return F.transform(F.array(value), body)[0]


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not among ``columns``, which Spark compares without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sha256_utf8(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


RUN = 64  # Spark copies a fold's accumulator at each step, so arrays are built in short runs


def running_sums(numbers: Column) -> Column:
    """Array of the sums of an array<int> up to and with each element."""
    empty = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def fold(places: Column, value) -> Column:
        def add(acc: Column, i: Column) -> Column:
            total = acc["sum"] + value(i)
            return F.struct(total.alias("sum"), F.concat(acc["out"], F.array(total)).alias("out"))

        return F.aggregate(places, empty, add)["out"]

    def of(a: Column) -> Column:
        n = F.size(a)
        first = F.sequence(F.lit(0), n - 1, F.lit(RUN))
        each = F.transform(first, lambda f: fold(F.sequence(f, F.least(f + (RUN - 1), n - 1)), lambda i: F.get(a, i)))
        whole = lambda runs: let(fold(F.sequence(F.lit(0), F.size(runs) - 1), lambda k: F.element_at(F.get(runs, k), -1)), lambda sums: F.flatten(F.transform(runs, lambda r, k: F.transform(r, lambda x: x + F.when(k == 0, 0).otherwise(F.get(sums, k - 1))))))
        return F.when(n == 0, F.array().cast("array<int>")).otherwise(let(each, whole))

    return let(numbers, of)
