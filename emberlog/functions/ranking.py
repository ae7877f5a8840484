"""Global positions without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import stored

SMALL = 1 << 17


def offset_by_bucket(df: DataFrame, bucket: str, weight: Column, within: list[str] | None = None) -> DataFrame:
    """Per ``within`` and ``bucket``: the sum of ``weight`` over all smaller buckets, as ``bucket_offset``.

    Only one row per bucket reaches the cumulative window, so callers choose a bounded number of buckets.
    """
    keys = within or []
    sums = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("bucket_sum"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, bucket, F.coalesce(F.sum("bucket_sum").over(before), F.lit(0)).cast("long").alias("bucket_offset"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` in the order of ``order``, which no two rows share, with ``name``: 1, 2, ...

    Rows are dealt to tasks by ranges, sorted there and written once to the shared folder, so a number
    holds when a task runs again. What is summed in one place is a row per range, and their number is
    that of the shuffle's partitions: it does not grow with the rows.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mark", F.monotonically_increasing_id())
    laid = stored(laid, "numbered").withColumn("_part", F.shiftright("_mark", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.col("_mark").bitwiseAND((1 << 33) - 1)
    return laid.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + place + 1).cast("long")).drop("_part", "_mark", "_before")


def row_at(df: DataFrame, by: str, then: str, place: Column, bucket: int = 100_000) -> DataFrame:
    """The row at ``place`` (a Column over ``n``, the number of rows; from 0) in the order of (by, then); ``then`` are whole numbers, unique.

    Counts per value of ``by`` tell the value, counts per range of ``then`` the range within it, and only
    the rows of this range are ranked: at most ``bucket``. ``by`` has few values, or they add up to what
    the rows stand for: counts of distinct sizes are fewer than the square root of twice their sum.
    """
    upto = lambda order: Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(F.lit(0))
    values = df.groupBy(by).agg(F.count("*").alias("_rows")).withColumn("_upto", F.sum("_rows").over(upto(by))).withColumn("n", F.sum("_rows").over(total))
    value = values.withColumn("_at", place).filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_rows")))
    value = value.select(by, (F.col("_at") - F.col("_upto") + F.col("_rows")).alias("_at"))
    own = df.join(F.broadcast(value), by).withColumn("_range", F.floor(F.col(then) / bucket))  # one row
    ranges = own.groupBy("_range", "_at").agg(F.count("*").alias("_rows")).withColumn("_upto", F.sum("_rows").over(upto("_range")))
    chosen = ranges.filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_rows")))
    chosen = chosen.select("_range", (F.col("_at") - F.col("_upto") + F.col("_rows")).alias("_in_range"))
    inside = own.join(F.broadcast(chosen), "_range")  # one row
    ranked = inside.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(then)))
    return ranked.filter(F.col("_place") == F.col("_in_range") + 1).select(*df.columns)
