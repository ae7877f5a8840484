"""JSON sinks: JSON lines, and one indented array; executors write both.

An array is written as part files in order, each record followed by a comma, and these are copied one
after another into one file, between the brackets. The copy streams inside the JVM, so an array may have
any size; nothing of it is held in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberlog.session import remove, shared_path


BUFFER = 1 << 20


def write_json_lines(df: DataFrame, path: str) -> None:
    """One record a line, nulls kept; written by the executors."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _indented(record, levels: int) -> str:
    """A value as JSON of two blanks a level, ASCII only, begun at a depth of ``levels``."""
    pad = "  " * levels
    return pad + json.dumps(record, indent=2).replace("\n", "\n" + pad)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_indented(r, 1) + "," for r in b.to_pylist()], pa.string())], ["value"])


def _join(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of ``folder``, in order, as one array in a file at ``path``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    source, target = hadoop.fs.Path(folder), hadoop.fs.Path(path)
    fs, to = source.getFileSystem(conf), target.getFileSystem(conf)
    to.setWriteChecksum(False)
    parts = [(s.getPath(), s.getLen()) for s in fs.listStatus(source) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
    parts.sort(key=lambda p: p[0].getName())
    out = to.create(target, True)
    try:
        if not parts:
            out.write(bytearray(b"[]"))
            return
        out.write(bytearray(b"[\n"))
        for i, (p, size) in enumerate(parts):
            part = fs.open(p)
            # The last record has a comma and a line break too many.
            whole = hadoop.util.LimitInputStream(part, size - 2 if i == len(parts) - 1 else size)
            hadoop.io.IOUtils.copyBytes(whole, out, BUFFER, False)
            part.close()
        out.write(bytearray(b"\n]"))
    finally:
        out.close()


def _write_array(ordered: DataFrame, path: str) -> int:
    """``ordered``: value, in its final order over partitions; returns the number of rows."""
    spark, seen = ordered.sparkSession, Observation()
    parts = shared_path(spark, "array")
    ordered.observe(seen, F.count("*").alias("n")).write.text(parts)
    _join(spark, parts, path)
    remove(spark, parts)
    return seen.get["n"]


def write_json_array(df: DataFrame, path: str, order: str) -> int:
    """One array, indented by two, ASCII only, in a file at ``path``; records in the order of ``order``. Returns their number."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order)
    return _write_array(rows.mapInArrow(_records, "value string"), path)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings of records whose last field is an open array ``logs``."""
    for b in batches:
        values = []
        for r in b.drop_columns(["_id", "_n"]).to_pylist():
            values.append(_indented(r, 1)[: -len("\n  }")] + ',\n    "logs": [')
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_n"), pa.array(values, pa.string())], ["_id", "_n", "value"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = []
        for logs, last in zip(b.column("logs").to_pylist(), b.column("last").to_pylist(), strict=True):
            values.append(",\n".join(_indented(x, 3) for x in logs) + ("\n    ]\n  }," if last else ","))
        yield pa.RecordBatch.from_arrays([b.column("incident_id"), b.column("chunk"), pa.array(values, pa.string())], ["_id", "_n", "value"])


def write_incident_array(incidents: DataFrame, chunks: DataFrame, path: str) -> None:
    """The array of nested incidents, byte for byte as ``write_json_array`` would write it, from flat ones and their logs in chunks.

    No task holds more of an incident than a chunk.
    """
    schema = "_id long, _n long, value string"
    heads = incidents.withColumns({"_id": F.col("incident_id"), "_n": F.lit(-1).cast("long")}).mapInArrow(_heads, schema)
    rows = heads.unionByName(chunks.mapInArrow(_chunks, schema))
    _write_array(rows.repartitionByRange("_id", "_n").sortWithinPartitions("_id", "_n").select("value"), path)


def write_incident_lines(incidents: DataFrame, chunks: DataFrame, path: str) -> None:
    """Flat incidents as JSON lines in ``path``/incidents, chunks of their logs in ``path``/logs."""
    write_json_lines(incidents, f"{path}/incidents")
    write_json_lines(chunks, f"{path}/logs")
