"""Lines to typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from emberlog.functions import text as X
from emberlog.session import kept_path


def head_lines(lines: DataFrame, n: int | None) -> DataFrame:
    """The first n physical lines; None or 0 means all."""
    if n is not None and n < 0:
        raise ValueError("n must not be negative")
    return lines.filter(F.col("line_number") <= n) if n else lines


def _stripped(lines: DataFrame) -> DataFrame:
    return lines.select("line_number", X.strip(F.col("value")).alias("raw_line"))


def classified(lines: DataFrame) -> DataFrame:
    """A row per line: line_number, kind (record, reject or blank), raw_line and the fields of the record, ``ts`` among them (null if impossible).

    A null line is blank. A line gives an array of one struct; filters stay behind its explosion, so no
    expression over a line is evaluated twice.
    """

    def row(raw: Column, f: Column) -> Column:
        day, time, thread, level, component, message = (f[i] for i in range(6))
        kind = F.when(f.isNotNull(), "record").when(F.coalesce(raw, F.lit("")) != "", "reject").otherwise("blank")
        # The names of a record's fields and their order.
        fields = lambda ts: {
            "kind": kind,
            "timestamp": X.iso_timestamp(ts, day, time),
            "thread_id": thread,
            "level": level,
            "component": component,
            "message": message,
            "block_id": X.block_id(message),
            "raw_line": raw,
            "ts": ts,
        }
        return X.let(X.time_of(day, time), lambda ts: F.struct(*[c.alias(name) for name, c in fields(ts).items()]))

    one = X.let(X.strip(F.col("value")), lambda raw: X.let(X.line_fields(raw), lambda f: row(raw, f)))
    return lines.select("line_number", F.inline_outer(F.array(one)))


def parse_records(lines: DataFrame) -> DataFrame:
    """Records of the lines that have the log shape, and ``ts``, their time (null if impossible)."""
    return classified(lines).filter("kind = 'record'").drop("kind")


def parse_once(lines: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Records, rejects, and the numbers of lines: total_lines, parsed, failed. One scan: lines are written by kind and counted on the way."""
    seen = Observation()
    found = classified(lines).observe(seen, F.count("*").alias("total_lines"), F.count_if(F.col("kind") == "record").alias("parsed"))
    path = kept_path(lines.sparkSession, "lines")
    found.filter("kind <> 'blank'").write.partitionBy("kind").parquet(path)
    rows = lines.sparkSession.read.schema(found.schema).parquet(path)
    records = rows.filter("kind = 'record'").drop("kind", "ts")
    n = seen.get
    return records.select("line_number", *[c for c in records.columns if c != "line_number"]), _start(rows.filter("kind = 'reject'")), n | {"failed": n["total_lines"] - n["parsed"]}


def parse_lines(lines: DataFrame) -> DataFrame:
    """The records without ``ts``; lines that have not the log shape drop out (see ``rejects``)."""
    return parse_records(lines).drop("ts")


def rejects(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor of the log shape: number and first 100 characters."""
    bad = _stripped(lines).filter((F.col("raw_line") != "") & ~F.col("raw_line").rlike(X.LINE_PATTERN))
    return _start(bad)


def _start(bad: DataFrame) -> DataFrame:
    return bad.select("line_number", F.substring("raw_line", 1, 100).alias("start"))


def parse_summary(lines: DataFrame) -> DataFrame:
    """One row: lines, parsed, failed (blank lines included), success in per cent (null without lines)."""
    ok = F.coalesce(F.col("raw_line").rlike(X.LINE_PATTERN), F.lit(False))
    counted = _stripped(lines).agg(F.count("*").alias("total_lines"), F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("failed"))
    return counted.withColumn("success_pct", F.when(F.col("total_lines") > 0, F.round(F.col("parsed") / F.col("total_lines") * 100, 6)))
