"""Command line: parse a log, group parsed logs, profile them.

    python -m emberlog.cli parse LOG OUT [--max-lines N]
    python -m emberlog.cli group PARSED OUT [--minutes 5]
    python -m emberlog.cli profile PARSED INCIDENTS

A name that ends in .json is one JSON array in a file, one in .jsonl a folder of JSON lines. Any other
name for incidents is a folder with flat incidents and, apart from them, their logs in chunks, both as
JSON lines: for incidents of any size. Lines that fail to parse and records that belong to no incident
are written beside the output, all of them.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import incidents as I
from emberlog.operators import parse as P
from emberlog.operators import profile as R
from emberlog.schema import CHUNK, FLAT_INCIDENT, INCIDENT, PARSED_LOG
from emberlog.session import clear, stored
from emberlog.sources import read_log_text, read_records_json, write_incident_array, write_incident_lines, write_json_array, write_json_lines


def _show(title: str, df: DataFrame) -> None:
    print(title)
    df.show(20, truncate=False, vertical=len(df.columns) > 5)


def _write(df: DataFrame, path: str, order: str) -> None:
    if path.endswith(".json"):
        write_json_array(df, path, order)
    else:
        write_json_lines(df, path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="emberlog")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("parse")
    p.add_argument("log")
    p.add_argument("out")
    p.add_argument("--max-lines", type=int, default=None)
    g = sub.add_parser("group")
    g.add_argument("parsed")
    g.add_argument("out")
    g.add_argument("--minutes", type=int, default=5)
    r = sub.add_parser("profile")
    r.add_argument("parsed")
    r.add_argument("incidents")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("emberlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "parse":
        records, rejects, n = P.parse_once(read_log_text(spark, a.log, a.max_lines))
        _write(records, a.out, "line_number")
        failed = f"{a.out}.rejects.jsonl"
        write_json_lines(rejects, failed)
        print("Parsing summary")
        print(f"  Lines: {n['total_lines']}, parsed: {n['parsed']}, failed: {n['failed']}, success: {100 * n['parsed'] / n['total_lines'] if n['total_lines'] else 0:.1f}%")
        _show(f"Lines that failed to parse, all of them in {failed}", rejects.orderBy("line_number"))
        _show("First record", records.orderBy("line_number").limit(1))
    elif a.command == "group":
        parsed = stored(read_records_json(spark, a.parsed, PARSED_LOG), "parsed")
        flat, chunks = I.incidents_in_chunks(parsed, a.minutes)
        flat, chunks = stored(flat, "incidents"), stored(chunks, "chunks")
        if a.out.endswith(".json"):
            write_incident_array(flat, chunks, a.out)
        elif a.out.endswith(".jsonl"):
            write_json_lines(I.nested(flat, chunks), a.out)
        else:
            write_incident_lines(flat, chunks, a.out)
        odd, left = I.ungroupable(parsed).select("line_number", "timestamp", "block_id"), f"{a.out}.ungroupable.jsonl"
        write_json_lines(odd, left)
        stats = I.stats_record(flat).first()
        blocks = R.distinct_blocks(I.groupable(parsed)).first()["n_blocks"]
        logs = stats["total_logs"] if stats else 0
        print(f"Logs with block ids: {logs}, blocks: {blocks}")
        print(f"Created {stats['total_incidents'] if stats else 0} incidents from {logs} logs" + (f", {stats['avg_logs_per_incident']:.1f} logs each on average" if stats else ""))
        _show(f"Records without an incident, as their time is impossible, all of them in {left}", odd.orderBy("line_number"))
        print("Incident statistics\n" + json.dumps(stats.asDict() if stats else {}, indent=2))
        _show("First incident", flat.filter("incident_id = 1").withColumn("logs", F.concat(F.lit("["), F.col("num_logs").cast("string"), F.lit(" logs...]"))))
    else:
        logs = read_records_json(spark, a.parsed, PARSED_LOG)
        if a.incidents.endswith((".json", ".jsonl")):
            found = read_records_json(spark, a.incidents, INCIDENT)
            messages = found.select("block_id", F.col("incident_id").alias("anchor"), F.explode("logs.message").alias("message"))
            middle = R.median_incident_logs(found)
        else:
            found, chunks = spark.read.schema(FLAT_INCIDENT).json(f"{a.incidents}/incidents"), spark.read.schema(CHUNK).json(f"{a.incidents}/logs")
            messages = chunks.select(F.lit("").alias("block_id"), F.col("incident_id").alias("anchor"), F.explode("logs.message").alias("message"))
            middle = R.chunk_logs(chunks, R.middle_incident(found))
        for title, df in (
            ("Overview", R.dataset_overview(logs)),
            ("Levels", R.value_counts(logs, "level")),
            ("Top components", R.value_counts(logs, "component", 10)),
            ("Sample", R.sample_logs(logs)),
            ("Incidents", R.incident_summary(found, 10)),
            ("Logs per incident", R.describe(found, "num_logs")),
            ("Severity", R.severity_colors(found)),
            ("Incidents by number of logs", R.histogram(found, "num_logs").orderBy("bin")),
            ("Incidents by duration", R.histogram(found, "duration_seconds").orderBy("bin")),
            ("Means", R.mean_markers(found)),
            ("Failure keywords", R.failure_keywords(messages)),
            ("Middle incident", middle),
        ):
            _show(title, df)
    clear(spark)


if __name__ == "__main__":
    main()
