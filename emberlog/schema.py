"""Schemas of parsed logs and incidents."""

from pyspark.sql import types as T

PARSED_LOG = T.StructType(
    [
        T.StructField("line_number", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("raw_line", T.StringType()),
    ]
)

INCIDENT = T.StructType(
    [
        T.StructField("incident_id", T.LongType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("num_logs", T.LongType()),
        T.StructField("severity", T.StringType()),
        T.StructField("components", T.ArrayType(T.StringType())),
        T.StructField("logs", T.ArrayType(PARSED_LOG)),
    ]
)

FLAT_INCIDENT = T.StructType(INCIDENT.fields[:-1])

CHUNK = T.StructType(
    [
        T.StructField("incident_id", T.LongType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("last", T.BooleanType()),
        INCIDENT.fields[-1],
    ]
)
