"""Registered queries over the log lines rendered from ``events``, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import FAILURE_KEYWORDS
from emberlog.operators import incidents as I
from emberlog.operators import parse as P
from emberlog.operators import profile as R
from emberlog.schema import INCIDENT
from emberlog.session import shared_path, stored, table
from emberlog.sources import lines_from_events, read_records_json, write_json_lines

MINUTES = 1440

Query = Callable[[SparkSession, str], DataFrame]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_events(table(spark, sf_dir, "events"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_lines(lines(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_records(lines(spark, sf_dir))


def incidents(spark: SparkSession, sf_dir: str, minutes: int = MINUTES, nested: bool = False) -> DataFrame:
    return I.group_incidents(records(spark, sf_dir), minutes, nested)


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unnumbered_incidents(records(spark, sf_dir), MINUTES)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of incidents from chunks of 16."""
    chunks = I.incidents_in_chunks(records(spark, sf_dir), MINUTES, 16)[1]
    logs = chunks.select("incident_id", F.inline("logs"))
    return logs.select("incident_id", "line_number", "timestamp", "message")


def _middle_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat, chunks = I.incidents_in_chunks(records(spark, sf_dir), MINUTES)
    return R.chunk_logs(chunks, R.middle_incident(stored(flat.select("incident_id", "num_logs"), "incidents")))


def flat_incidents(spark: SparkSession, sf_dir: str, minutes: int = MINUTES) -> DataFrame:
    return incidents(spark, sf_dir, minutes).withColumn("components", F.array_join("components", ","))


def _grouped(spark: SparkSession, sf_dir: str, minutes: int = MINUTES, strategy: str = "auto") -> DataFrame:
    logs = I.grouped_logs(records(spark, sf_dir), minutes, strategy)
    return logs.select("block_id", "line_number", "timestamp", F.date_format("anchor", "yyyy-MM-dd'T'HH:mm:ss").alias("anchor"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = incidents(spark, sf_dir, nested=True)
    return full.select("incident_id", F.posexplode("logs").alias("pos", "log")).select("incident_id", (F.col("pos") + 1).alias("place"), "log.line_number", "log.message")


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested incidents written as JSON lines to the shared folder and read back."""
    path = shared_path(spark, "incidents") + ".jsonl"
    write_json_lines(incidents(spark, sf_dir, nested=True), path)
    back = read_records_json(spark, path, INCIDENT)
    return back.select("incident_id", "block_id", "num_logs", F.size("logs").cast("long").alias("logs_read"), F.array_join("components", ",").alias("components"))


def queries() -> dict[str, Query]:
    on_parsed = lambda f: lambda s, d: f(parsed(s, d))
    on_lines = lambda f: lambda s, d: f(lines(s, d))
    on_incidents = lambda f: lambda s, d: f(incidents(s, d))
    on_unnumbered = lambda f: lambda s, d: f(unnumbered(s, d))
    return {
        "incidents": flat_incidents,
        "incidents_5min": lambda s, d: flat_incidents(s, d, 5),
        "parse_lines": parsed,
        "parse_rejects": on_lines(P.rejects),
        "parse_summary": on_lines(P.parse_summary),
        "head_lines": on_lines(lambda x: P.parse_lines(P.head_lines(x, 100))),
        "block_extract": on_parsed(lambda p: p.select("line_number", "block_id")),
        "grouped_logs": _grouped,
        "grouped_logs_fold": lambda s, d: _grouped(s, d, strategy="fold"),
        "grouped_logs_buckets": lambda s, d: _grouped(s, d, strategy="buckets"),
        "distinct_blocks": on_parsed(R.distinct_blocks),
        "incident_logs_nested": _nested,
        "incident_chunks": _chunks,
        "incident_stats": on_unnumbered(I.incident_stats),
        "severity_distribution": on_unnumbered(I.severity_distribution),
        "dataset_overview": on_parsed(R.dataset_overview),
        "level_counts": on_parsed(lambda p: R.value_counts(p, "level")),
        "top_components": on_parsed(lambda p: R.value_counts(p, "component", 10)),
        "sample_logs": on_parsed(R.sample_logs),
        "incident_summary": on_incidents(R.incident_summary),
        "incident_head": on_incidents(lambda i: R.incident_summary(i, 10)),
        "size_describe": on_unnumbered(lambda i: R.describe(i, "num_logs")),
        "size_histogram": on_unnumbered(lambda i: R.histogram(i, "num_logs")),
        "duration_histogram": on_unnumbered(lambda i: R.histogram(i, "duration_seconds")),
        "mean_markers": on_unnumbered(R.mean_markers),
        "failure_keywords": lambda s, d: R.failure_keywords(I.grouped_logs(records(s, d).select("block_id", "ts", "line_number", "message"), MINUTES)),
        "median_incident": lambda s, d: R.median_incident(stored(incidents(s, d), "incidents")),
        "median_incident_logs": _middle_logs,
        "severity_color": on_unnumbered(R.severity_colors),
        "json_round_trip": _round_trip,
    }


# Fixed values in the SQL below: the shape of a log line and of a block id, the rank of the levels, and the colours.
_LINES = r"""
lines AS (
  SELECT event_id + 1 AS line_number,
    CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'malformed record ' || event_id
    ELSE strftime(ts, '%y%m%d %H%M%S') || ' ' || (event_id % 200) || ' ' ||
      CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' WHEN 'signup' THEN 'TRACE' ELSE 'INFO' END
      || ' svc.' || event_type || '$Handler' || (event_id % 3) || ': ' ||
      CASE WHEN event_id % 13 = 0 THEN 'Lost heartbeat ' WHEN event_type = 'error' THEN 'Timeout while handling ' ELSE 'Handled ' END ||
      CASE WHEN event_id % 7 = 0 THEN 'system status'
      ELSE 'block blk_' || CASE WHEN user_id % 2 <> 0 THEN '-' ELSE '' END || user_id || ' value ' || event_id END
    END AS raw_line
  FROM events),
shaped AS (
  SELECT line_number, raw_line, regexp_extract(raw_line, '^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([\w.$]+):\s+(.+)$', ['d','t','thread_id','level','component','message']) AS f
  FROM lines WHERE regexp_matches(raw_line, '^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([\w.$]+):\s+(.+)$')),
timed AS (
  SELECT line_number, raw_line, f.thread_id AS thread_id, f.level AS level, f.component AS component, f.message AS message,
    strptime(f.d || ' ' || f.t, '%y%m%d %H%M%S') AS ts, nullif(regexp_extract(f.message, 'blk_-?\d+'), '') AS block_id
  FROM shaped),
parsed AS (
  SELECT line_number, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, thread_id, level, component, message, block_id, raw_line FROM timed)"""


def _with(body: str, minutes: int | None = None, extra: str = "") -> str:
    if minutes is None:
        return f"WITH {_LINES.strip()}\n{body}"
    return f"""WITH RECURSIVE {_LINES.strip()},
g AS (SELECT * FROM timed WHERE block_id IS NOT NULL),
anchors(block_id, anchor) AS (
  SELECT block_id, min(ts) FROM g GROUP BY block_id
  UNION ALL
  SELECT g.block_id, min(g.ts) FROM anchors a JOIN g ON g.block_id = a.block_id AND g.ts > a.anchor + INTERVAL {minutes} MINUTE GROUP BY g.block_id),
grouped AS (SELECT g.*, a.anchor FROM g ASOF JOIN anchors a ON g.block_id = a.block_id AND g.ts >= a.anchor),
ranked AS (SELECT *, CASE level WHEN 'FATAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END AS prio FROM grouped),
merged AS (
  SELECT block_id, anchor, min(ts) AS s, max(ts) AS e, count(*) AS num_logs, first(level ORDER BY prio DESC, ts, line_number) AS severity,
    list_sort(list(DISTINCT component)) AS comps, min(line_number) AS fl
  FROM ranked GROUP BY block_id, anchor),
placed AS (SELECT *, min(fl) OVER (PARTITION BY block_id) AS first_line FROM merged),
incidents AS (
  SELECT row_number() OVER (ORDER BY first_line, s) AS incident_id, block_id, anchor, strftime(s, '%Y-%m-%dT%H:%M:%S') AS start_time,
    strftime(e, '%Y-%m-%dT%H:%M:%S') AS end_time, epoch(e) - epoch(s) AS duration_seconds, num_logs, severity, comps
  FROM placed){extra}
{body}"""


def _histogram_sql(column: str) -> str:
    return _with(
        f"""SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 6) AS bin_start, round(lo + (b.bin + 1) * w, 6) AS bin_end, coalesce(n, 0) AS n
FROM (SELECT range AS bin FROM range(20)) b CROSS JOIN ends LEFT JOIN counted c ON c.bin = b.bin""",
        MINUTES,
        f""",
raw AS (SELECT min(CAST({column} AS DOUBLE)) AS a, max(CAST({column} AS DOUBLE)) AS b FROM incidents),
ends AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, ((CASE WHEN a = b THEN b + 0.5 ELSE b END) - (CASE WHEN a = b THEN a - 0.5 ELSE a END)) / 20 AS w FROM raw),
counted AS (SELECT least(floor((CAST({column} AS DOUBLE) - lo) / w), 19) AS bin, count(*) AS n FROM incidents CROSS JOIN ends GROUP BY 1)""",
    )


def oracle_sql() -> dict[str, str]:
    flat = "SELECT incident_id, block_id, start_time, end_time, duration_seconds, num_logs, severity, array_to_string(comps, ',') AS components FROM incidents"
    summary = "SELECT incident_id, block_id, start_time, duration_seconds, num_logs, severity, CAST(len(comps) AS INTEGER) AS num_components FROM incidents"
    grouped = "SELECT block_id, line_number, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, strftime(anchor, '%Y-%m-%dT%H:%M:%S') AS anchor FROM grouped"
    middle = "pick AS (SELECT * FROM incidents ORDER BY num_logs, incident_id LIMIT 1 OFFSET (SELECT count(*) // 2 FROM incidents))"
    keywords = ", ".join(f"'{k}'" for k in FAILURE_KEYWORDS)
    return {
        "incidents": _with(flat, MINUTES),
        "incidents_5min": _with(flat, 5),
        "parse_lines": _with("SELECT * FROM parsed"),
        "parse_rejects": _with("SELECT line_number, raw_line[:100] AS start FROM lines WHERE raw_line <> '' AND line_number NOT IN (SELECT line_number FROM parsed)"),
        "parse_summary": _with(
            "SELECT count(*) AS total_lines, count(p.line_number) AS parsed, count(*) - count(p.line_number) AS failed, round(count(p.line_number) / count(*) * 100, 6) AS success_pct FROM lines l LEFT JOIN parsed p USING (line_number)"
        ),
        "head_lines": _with("SELECT * FROM parsed WHERE line_number <= 100"),
        "block_extract": _with("SELECT line_number, block_id FROM parsed"),
        "grouped_logs": _with(grouped, MINUTES),
        "grouped_logs_fold": _with(grouped, MINUTES),
        "grouped_logs_buckets": _with(grouped, MINUTES),
        "distinct_blocks": _with("SELECT count(DISTINCT block_id) AS n_blocks FROM parsed"),
        "incident_logs_nested": _with(
            "SELECT incident_id, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY g.ts, g.line_number) AS INTEGER) AS place, g.line_number, g.message FROM grouped g JOIN incidents i ON i.block_id = g.block_id AND i.anchor = g.anchor", MINUTES
        ),
        "incident_chunks": _with("SELECT incident_id, line_number, strftime(g.ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, message FROM grouped g JOIN incidents i ON i.block_id = g.block_id AND i.anchor = g.anchor", MINUTES),
        "incident_stats": _with(
            "SELECT count(*) AS total_incidents, CAST(sum(num_logs) AS BIGINT) AS total_logs, round(avg(num_logs), 6) AS avg_logs_per_incident, min(num_logs) AS min_logs_per_incident, max(num_logs) AS max_logs_per_incident, round(avg(duration_seconds), 6) AS avg_duration_seconds FROM incidents",
            MINUTES,
        ),
        "severity_distribution": _with("SELECT severity, count(*) AS n FROM incidents GROUP BY severity", MINUTES),
        "dataset_overview": _with(
            "SELECT count(*) AS total_logs, min(timestamp) AS start_time, max(timestamp) AS end_time, datediff('second', min(CAST(timestamp AS TIMESTAMP)), max(CAST(timestamp AS TIMESTAMP))) AS span_seconds, count(block_id) AS with_block, round(count(block_id) / count(*) * 100, 6) AS with_block_pct, count(DISTINCT block_id) AS unique_blocks, count(DISTINCT component) AS unique_components FROM parsed"
        ),
        "level_counts": _with("SELECT level, count(*) AS n FROM parsed GROUP BY level"),
        "top_components": _with("SELECT component, count(*) AS n FROM parsed GROUP BY component ORDER BY n DESC, component LIMIT 10"),
        "sample_logs": _with("SELECT line_number, level, component, coalesce(block_id, 'N/A') AS block, message[:100] AS message_start FROM parsed ORDER BY line_number LIMIT 5"),
        "incident_summary": _with(summary, MINUTES),
        "incident_head": _with(summary + " ORDER BY incident_id LIMIT 10", MINUTES),
        "size_describe": _with(
            "SELECT count(num_logs) AS n, round(avg(num_logs), 6) AS mean, round(stddev_samp(num_logs), 6) AS std, CAST(min(num_logs) AS DOUBLE) AS min, round(CAST(quantile_cont(num_logs, 0.25) AS DOUBLE), 6) AS p25, round(CAST(quantile_cont(num_logs, 0.5) AS DOUBLE), 6) AS p50, round(CAST(quantile_cont(num_logs, 0.75) AS DOUBLE), 6) AS p75, CAST(max(num_logs) AS DOUBLE) AS max FROM incidents",
            MINUTES,
        ),
        "size_histogram": _histogram_sql("num_logs"),
        "duration_histogram": _histogram_sql("duration_seconds"),
        "mean_markers": _with("SELECT round(avg(num_logs), 6) AS mean_logs, round(avg(duration_seconds), 6) AS mean_duration FROM incidents", MINUTES),
        "failure_keywords": _with(
            f"SELECT keyword, count(*) AS n FROM (SELECT DISTINCT block_id, anchor, keyword FROM grouped, (SELECT unnest([{keywords}]) AS keyword) WHERE contains(lower(message), keyword)) GROUP BY keyword", MINUTES
        ),
        "median_incident": _with("SELECT incident_id, block_id, start_time, round(duration_seconds, 1) AS duration_seconds, num_logs, severity, array_to_string(comps, ', ') AS components FROM pick", MINUTES, f",\n{middle}"),
        "median_incident_logs": _with(
            "SELECT * FROM (SELECT p.incident_id, CAST(row_number() OVER (ORDER BY g.ts, g.line_number) AS INTEGER) AS place, g.level, g.message[:80] AS message_start, CAST(greatest(p.num_logs - 5, 0) AS INTEGER) AS more FROM grouped g JOIN pick p ON p.block_id = g.block_id AND p.anchor = g.anchor) WHERE place <= 5",
            MINUTES,
            f",\n{middle}",
        ),
        "severity_color": _with("SELECT severity, count(*) AS n, CASE severity WHEN 'ERROR' THEN 'red' WHEN 'WARN' THEN 'orange' ELSE 'green' END AS color FROM incidents GROUP BY severity", MINUTES),
        "json_round_trip": _with("SELECT incident_id, block_id, num_logs, num_logs AS logs_read, array_to_string(comps, ',') AS components FROM incidents", MINUTES),
    }
