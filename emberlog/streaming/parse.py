"""Streams of lines to records: the parser works on them as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators.parse import parse_records


def records(spark: SparkSession, source: str, files: int | None = None) -> DataFrame:
    """Records of new text files of a folder, at most ``files`` a batch. Lines have no number there."""
    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    lines = reader.text(source).select(F.lit(None).cast("long").alias("line_number"), "value")
    return parse_records(lines).drop("line_number")


def stream_parsed(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Parse new text files of a folder into Parquet, once each, then stop."""
    out = records(spark, source).drop("ts").writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()
