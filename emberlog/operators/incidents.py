"""Records to incidents, and statistics of incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import text as X
from emberlog.functions.ranking import numbered
from emberlog.operators.windows import assign_anchor
from emberlog.session import stored

CHUNK = 1000
# The fields of a nested record besides its line number.
RECORD = ["timestamp", "thread_id", "level", "component", "message", "block_id", "raw_line"]


def _timed(parsed: DataFrame) -> DataFrame:
    return parsed if "ts" in parsed.columns else parsed.withColumn("ts", F.col("timestamp").try_cast("timestamp_ntz"))


def groupable(parsed: DataFrame) -> DataFrame:
    """Records with a block id and a valid time, with ``ts``; records that have it already are not read again."""
    return _timed(parsed).filter((F.col("block_id") != "") & F.col("ts").isNotNull())


def ungroupable(parsed: DataFrame) -> DataFrame:
    """Records with a block id whose time is impossible; they belong to no incident."""
    return _timed(parsed).filter((F.col("block_id") != "") & F.col("ts").isNull()).drop("ts")


def grouped_logs(parsed: DataFrame, minutes: int = 5, strategy: str = "auto") -> DataFrame:
    """One row per groupable record, with the anchor of its incident. Records are written once, as blocks are counted and then grouped."""
    logs = groupable(parsed)
    return assign_anchor(stored(logs, "logs") if strategy == "auto" else logs, minutes, strategy)


def _narrow(parsed: DataFrame) -> DataFrame:
    return _timed(parsed).select("block_id", "ts", "line_number", "level", "component")


def _incidents(anchored: DataFrame, nested: bool = False) -> DataFrame:
    aggs = [
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count("*").alias("num_logs"),
        F.min_by("level", F.struct(-X.level_rank(F.col("level")), F.col("ts"), F.col("line_number"))).alias("severity"),
        F.sort_array(F.collect_set("component")).alias("components"),
    ]
    if nested:
        ordered = F.array_sort(F.collect_list(F.struct("ts", "line_number", *RECORD)))
        aggs.append(F.transform(ordered, lambda x: F.struct(*[x[f].alias(f) for f in ["line_number", *RECORD]])).alias("logs"))
    return anchored.groupBy("block_id", "anchor").agg(*aggs)


def _shown(incidents: DataFrame, *first: str) -> DataFrame:
    return incidents.select(
        *first,
        "block_id",
        X.iso(F.col("start_ts")).alias("start_time"),
        X.iso(F.col("end_ts")).alias("end_time"),
        (F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / 1e6).alias("duration_seconds"),
        "num_logs",
        "severity",
        "components",
        *[c for c in incidents.columns if c == "logs"],
    )


def unnumbered_incidents(parsed: DataFrame, minutes: int = 5, strategy: str = "auto") -> DataFrame:
    """The incidents without ids, for all that needs none: nothing is ordered or numbered."""
    return _shown(_incidents(grouped_logs(_narrow(parsed), minutes, strategy)))


def _numbered(logs: DataFrame, anchored: DataFrame, nested: bool = False) -> DataFrame:
    """Incidents with first_line (of the block), anchor and incident_id: in the order of the block's first line, then time."""
    first = logs.groupBy("block_id").agg(F.min("line_number").alias("first_line"))
    return numbered(_incidents(anchored, nested).join(first, "block_id"), ["first_line", "start_ts"], "incident_id")


def group_incidents(parsed: DataFrame, minutes: int = 5, nested: bool = False, strategy: str = "auto") -> DataFrame:
    """One row per incident; ids follow the first line of each block, then time. ``nested`` adds the logs, in order.

    Records are written once and incidents once, to the shared folder. Flat incidents carry five narrow
    columns; a nested one gathers its logs in one row, so it must fit a task: see ``incidents_in_chunks``.
    """
    logs = stored(groupable(parsed if nested else _narrow(parsed)), "logs")
    return _shown(_numbered(logs, assign_anchor(logs, minutes, strategy), nested), "incident_id")


def incidents_in_chunks(parsed: DataFrame, minutes: int = 5, rows: int = CHUNK, strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Flat incidents, and their logs in chunks of at most ``rows``: incident_id, chunk (0, 1, ...), last, logs (in order).

    Logs are placed in the order of incidents and time by ranges, so an incident of any size lies in as
    many tasks as it needs. A chunk ends where the place is a multiple of ``rows`` or the incident ends.
    """
    logs = stored(groupable(parsed), "logs")
    anchored = stored(assign_anchor(logs, minutes, strategy), "anchored")
    found = stored(_numbered(logs, anchored), "incidents")
    keys = found.select("block_id", "anchor", "incident_id")
    first = logs.groupBy("block_id").agg(F.min("line_number").alias("first_line"))
    placed = numbered(anchored.join(first, "block_id"), ["first_line", "anchor", "ts", "line_number"], "place")
    record = F.struct("place", "line_number", *RECORD)
    chunks = placed.withColumn("run", F.floor((F.col("place") - 1) / rows)).groupBy("block_id", "anchor", "run").agg(F.array_sort(F.collect_list(record)).alias("logs"))
    ends = chunks.groupBy("block_id", "anchor").agg(F.min("run").alias("first_run"), F.max("run").alias("last_run"))
    logs_of = F.transform("logs", lambda x: F.struct(*[x[f].alias(f) for f in ["line_number", *RECORD]])).alias("logs")
    joined = chunks.join(ends, ["block_id", "anchor"]).join(keys, ["block_id", "anchor"])
    out = joined.select("incident_id", (F.col("run") - F.col("first_run")).cast("long").alias("chunk"), (F.col("run") == F.col("last_run")).alias("last"), logs_of)
    return _shown(found, "incident_id"), out


def nested(incidents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Incidents with all their logs in a row, from chunks; for incidents that fit a task."""
    whole = chunks.groupBy("incident_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "logs"))), lambda x: x["logs"])).alias("logs"))
    return incidents.join(whole, "incident_id").select(*incidents.columns, "logs")


def incident_stats(incidents: DataFrame) -> DataFrame:
    """One row of totals; no row without incidents."""
    return incidents.agg(
        F.count("*").alias("total_incidents"),
        F.sum("num_logs").alias("total_logs"),
        F.round(F.avg("num_logs"), 6).alias("avg_logs_per_incident"),
        F.min("num_logs").alias("min_logs_per_incident"),
        F.max("num_logs").alias("max_logs_per_incident"),
        F.round(F.avg("duration_seconds"), 6).alias("avg_duration_seconds"),
    ).filter("total_incidents > 0")


def severity_distribution(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("severity").agg(F.count("*").alias("n"))


def stats_record(incidents: DataFrame) -> DataFrame:
    """The totals with the severities as a map: the whole statistics record."""
    return incident_stats(incidents).crossJoin(F.broadcast(severity_map(incidents)))  # one row


def severity_map(incidents: DataFrame) -> DataFrame:
    """The distribution as one map, as in the nested statistics record."""
    pairs = severity_distribution(incidents).agg(F.collect_list(F.struct("severity", "n")).alias("pairs"))
    return pairs.select(F.map_from_entries("pairs").alias("severity_distribution"))
