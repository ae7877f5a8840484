"""Log sources: text files, JSON records, and lines rendered from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.sources.arrays import read_json_array


def read_log_text(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """Columns line_number (1-based over all physical lines) and value.

    Files follow one another by path, the splits of a file by where they start. A count per split, a
    running sum over the splits, and each line's place in its split give the numbers; lines are not
    shuffled. Splits are a row each, as many as Spark has files and tasks.
    ``max_lines`` keeps the first so many physical lines; None or 0 means all.
    """
    if max_lines is not None and max_lines < 0:
        raise ValueError("max_lines must not be negative")
    split = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("mark"))
    before = Window.partitionBy(F.lit(0)).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("lines"), F.min("mark").alias("first"))
    offsets = counts.select("path", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    # A task may read several splits, one after the other; the first mark of each tells where it begins.
    out = lines.join(F.broadcast(offsets), ["path", "block"]).select((F.col("before") + F.col("mark") - F.col("first") + 1).cast("long").alias("line_number"), "value")
    return out.filter(F.col("line_number") <= max_lines) if max_lines else out


def read_records_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records from JSON array files, or from JSON lines where the path ends in .jsonl."""
    if path.rstrip("/").endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    return read_json_array(spark, path, schema)


def lines_from_events(events: DataFrame) -> DataFrame:
    """Log lines rendered from ``events``; rules in FIXTURES.md (F6). Columns line_number, value."""
    e, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id")
    text = lambda c: c.cast("string")
    level = F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "click", "DEBUG").when(kind == "signup", "TRACE").otherwise("INFO")
    prefix = F.when(e % 13 == 0, "Lost heartbeat ").when(kind == "error", "Timeout while handling ").otherwise("Handled ")
    rest = F.when(e % 7 == 0, "system status").otherwise(
        F.concat(F.lit("block blk_"), F.when(user % 2 != 0, "-").otherwise(""), text(user), F.lit(" value "), text(e))
    )
    line = F.concat(
        F.date_format("ts", "yyMMdd HHmmss"), F.lit(" "), text(e % 200), F.lit(" "), level, F.lit(" svc."), kind, F.lit("$Handler"), text(e % 3), F.lit(": "), prefix, rest
    )
    value = F.when(e % 97 == 0, "").when(e % 11 == 0, F.concat(F.lit("malformed record "), text(e))).otherwise(line)
    return events.select((e + 1).alias("line_number"), value.alias("value"))
