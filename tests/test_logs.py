"""Parsing, windows, sources, sinks and the command line on hand-made lines."""

from __future__ import annotations

import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog import cli
from emberlog.functions import ranking
from emberlog.operators import incidents as I
from emberlog.operators import parse as P
from emberlog.operators import profile as R
from emberlog.operators import windows as W
from emberlog.plans import queries as Q
from emberlog.schema import INCIDENT, PARSED_LOG
from emberlog.sources import read_json_array, read_log_text, read_records_json, write_incident_array, write_incident_lines, write_json_array
from emberlog.streaming import stream_grouped, stream_parsed

LINES = [
    "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-1 src: /10.0.0.1",
    "081109 203518 35 INFO dfs.FSNamesystem: BLOCK* allocate /x/part-1. blk_-1",
    "081109 203519 143 ERROR dfs.DataNode: failure of block blk_22",
    "",
    "not a log line",
    "  \t081109 203521 1 WARN dfs.DataNode: blk_22 then blk_33 \x1c ",
    "081109 204100 1 FATAL dfs.DataNode: late blk_22",
    "090230 101010 1 INFO a.b: impossible day blk_5",
    "090228 240000 1 INFO a.b: impossible hour blk_5",
    "090228 101060 1 INFO a.b: impossible second",
    "690101 000000 1 info a.B$c: lower case level blk_12x",
    "680101 000000 1 INFO blk_7.x: id in the component only",
    "081109 203518 143 INFO dfs-node: hyphen",
    "081109 203518 143 INFO dfs.DataNode:",
    "081109\t203518 \x1c143  INFO dfs.DataNode: tabs  inside",
]


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "sample.log"
    path.write_bytes("\n".join(LINES).encode() + b"\n081109 203518 1 INFO a.b: caf\xff y \xc3\xa9\n")
    return str(path)


def test_parse_edge_cases(spark, log):
    lines = read_log_text(spark, log)
    got = {r["line_number"]: r for r in P.parse_lines(lines).collect()}
    assert sorted(got) == [1, 2, 3, 6, 7, 8, 9, 10, 11, 12, 15, 16]
    assert [got[i]["timestamp"] for i in (1, 8, 9, 10, 11, 12)] == ["2008-11-09T20:35:18", "2009-02-30T10:10:10", "2009-02-28T24:00:00", "2009-02-28T10:10:60", "1969-01-01T00:00:00", "2068-01-01T00:00:00"]
    assert [got[i]["block_id"] for i in (1, 6, 10, 11, 12)] == ["blk_-1", "blk_22", None, "blk_12", None]
    assert (got[6]["raw_line"], got[6]["message"]) == ("081109 203521 1 WARN dfs.DataNode: blk_22 then blk_33", "blk_22 then blk_33")
    assert got[11]["level"] == "info" and got[15]["message"] == "tabs  inside"
    assert got[16]["message"] == "caf y é" and "\ufffd" not in got[16]["raw_line"]
    assert {r["line_number"] for r in P.rejects(lines).collect()} == {5, 13, 14}
    summary = P.parse_summary(lines).first()
    assert (summary["total_lines"], summary["parsed"], summary["failed"], summary["success_pct"]) == (16, 12, 4, 75.0)
    assert [read_log_text(spark, log, n).count() for n in (None, 0, 3, 99)] == [16, 16, 3, 16]


def test_lines_are_parsed_once(spark, sf_dir):
    plan = Q.queries()["grouped_logs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$1\x01$2") <= 2, "one evaluation for each branch of the windows"


def _greedy(times: list[int], span: int) -> list[int]:
    out: list[int] = []
    for t in times:
        out.append(out[-1] if out and t - out[-1] <= span else t)
    return out


def _blocks(rng: random.Random) -> dict[str, list[int]]:
    blocks = {"anchor": [180, 420, 660, 960, 1261], "bound": [0, 300, 301], "zero": [5, 5, 6], "one": [9], "before": [-400, -100, -1, 0, 250], "hot": sorted(rng.randrange(0, 40_000) for _ in range(600))}
    return blocks | {f"r{i}": sorted(rng.randrange(0, 3_000) for _ in range(rng.randrange(1, 30))) for i in range(30)}


def _anchored(spark, blocks: dict[str, list[int]], minutes: int, assign) -> None:
    """Anchors against a plain loop."""
    rows = [(b, t) for b, ts in blocks.items() for t in ts]
    random.Random(1).shuffle(rows)
    logs = spark.createDataFrame([(b, t, i) for i, (b, t) in enumerate(rows)], "block_id string, t long, line_number long").repartition(4)
    logs = logs.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = assign(logs).select("block_id", "t", F.unix_timestamp(F.col("anchor").cast("timestamp")).alias("a")).collect()
    assert len(got) == len(rows)
    found: dict[str, list] = {}
    for r in got:
        found.setdefault(r["block_id"], []).append((r["t"], r["a"]))
    for b, ts in blocks.items():
        assert sorted(found[b]) == list(zip(ts, _greedy(ts, 60 * minutes), strict=True))


@pytest.mark.parametrize("strategy", W.STRATEGIES)
def test_windows(spark, strategy):
    """Edges of a window, windows of no length, times before 1970, a hot block, random times."""
    blocks = _blocks(random.Random(3))
    for minutes in (5, 0):
        _anchored(spark, blocks, minutes, lambda logs, m=minutes: I.assign_anchor(logs, m, strategy, hot=100))
    with pytest.raises(ValueError):
        I.assign_anchor(spark.createDataFrame([], "block_id string, ts timestamp_ntz"), -1)
    none = spark.createDataFrame([], "block_id string, ts timestamp_ntz, line_number long")
    assert I.assign_anchor(none, 5, strategy).count() == 0


def test_buckets_over_levels(spark):
    """Buckets of two windows, composed three at a time: many levels, long chains, gaps over whole buckets."""
    rng = random.Random(8)
    blocks = {"dense": list(range(0, 60_000, 7)), "gaps": sorted(t + 20_000 * (t // 900) for t in rng.sample(range(20_000), 900)), "few": [0, 10_000_000]}
    _anchored(spark, blocks, 1, lambda logs: W._bucketed(logs, 60_000_000, windows=2, fan=3))


def test_transfer_functions():
    """Of neighbouring buckets and of their composition, for every anchor that may enter."""
    rng = random.Random(5)
    for _ in range(200):
        span, begin = rng.randrange(1, 12), rng.randrange(-50, 50)
        a = np.array(sorted(rng.sample(range(begin, begin + 40), rng.randrange(1, 15))))
        b = np.array(sorted(rng.sample(range(begin + 40, begin + 80), rng.randrange(1, 15))))
        f, g = W.transfer(a, span, begin), W.transfer(b, span, begin + 40)
        both = W.composed(f, g, span, begin)
        for anchor in [W.NEVER, *range(begin - 20, begin)]:
            after = int(W.greedy(a, span, anchor)[-1])
            assert W.leaving(f, span, np.array([anchor]))[0] == after
            assert W.leaving(both, span, np.array([anchor]))[0] == int(W.greedy(b, span, after)[-1])


def test_hot_block_takes_several_tasks(spark):
    """200,000 logs of one block: no task sorts them all, and anchors equal a plain loop's."""
    n = 200_000
    logs = spark.range(n).select(F.lit("blk_1").alias("block_id"), F.timestamp_seconds((F.col("id") * 7919) % n * 3).cast("timestamp_ntz").alias("ts"), F.col("id").alias("line_number"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows end in one task
    found = I.assign_anchor(logs, 5, "auto", hot=10_000).select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.unix_timestamp(F.col("anchor").cast("timestamp")).alias("a"), F.spark_partition_id().alias("p"))
    rows = found.toPandas()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows["p"].nunique() > 3 and rows["p"].value_counts().max() < n / 3
    rows = rows.sort_values("t")
    assert rows["a"].tolist() == _greedy(rows["t"].tolist(), 300)


def test_json_array_both_ways(spark, log, tmp_path):
    parsed = P.parse_lines(read_log_text(spark, log))
    path = f"{tmp_path}/parsed.json"
    assert write_json_array(parsed, path, "line_number") == 12
    with open(path, encoding="ascii") as f:
        text = f.read()
    assert [r["line_number"] for r in json.loads(text)] == sorted(r["line_number"] for r in parsed.collect()) and text.startswith('[\n  {\n    "line_number": 1,')
    assert sorted(map(str, read_records_json(spark, path, PARSED_LOG).collect())) == sorted(map(str, parsed.collect()))
    assert text == json.dumps([r.asDict() for r in parsed.orderBy("line_number").collect()], indent=2)
    assert write_json_array(parsed.limit(0), path, "line_number") == 0 and open(path).read() == "[]"
    assert read_records_json(spark, path, PARSED_LOG).count() == 0


def test_nested_incidents_in_chunks(spark, sf_dir, tmp_path):
    """Chunks hold the logs in order and no more than asked for; the array of their incidents equals that of nested rows, byte for byte."""
    records = Q.records(spark, sf_dir)
    whole = I.group_incidents(records, 1440, nested=True).orderBy("incident_id").collect()
    flat, chunks = I.incidents_in_chunks(records, 1440, 2)
    assert chunks.select(F.max(F.size("logs"))).first()[0] == 2
    assert I.nested(flat, chunks).orderBy("incident_id").collect() == whole
    path = f"{tmp_path}/incidents.json"
    write_incident_array(flat, chunks, path)
    with open(path, encoding="ascii") as f:
        assert f.read() == json.dumps([r.asDict(recursive=True) for r in whole], indent=2)
    assert read_records_json(spark, path, INCIDENT).orderBy("incident_id").collect() == whole
    write_incident_lines(flat, chunks, f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines/logs").count() == chunks.count()


def test_json_array_in_splits(spark, tmp_path):
    """Splits of every small size over records with braces, quotes and backslashes in strings, nested and empty ones, and several files."""
    odd = ['}', '{"', '\\"}', '{}{', "\\", 'a"b', "\n}\n{", "é}漢", ""]
    rows = [{"a": i, "s": odd[i % len(odd)] * (1 + i % 5), "n": [{"x": "}" * (i % 3)}] * (i % 4)} for i in range(120)]
    schema = "a long, s string, n array<struct<x string>>"
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps(rows[:70], indent=2))
    (folder / "2.json").write_text(json.dumps(rows[70:], ensure_ascii=False, separators=(",", ":")))
    (folder / "3.json").write_text("[]")
    conf = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(c) for c in conf]
    try:
        for size in (97, 700, 1 << 20):
            for c in conf:
                spark.conf.set(c, str(size))
            got = read_json_array(spark, str(folder), T._parse_datatype_string(schema))
            if size == 700:
                assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
            assert sorted((r.asDict(recursive=True) for r in got.collect()), key=lambda r: r["a"]) == rows
    finally:
        for c, x in zip(conf, before, strict=True):
            spark.conf.set(c, x)


def test_line_numbers_over_files_and_splits(spark, tmp_path):
    """Files follow by path; splits of a few lines each; no line is numbered twice."""
    lines = [f"line {i}" + "x" * (i % 50) for i in range(900)]
    for name, part in (("b", lines[300:750]), ("a", lines[:300]), ("c", lines[750:])):
        (tmp_path / f"{name}.log").write_text("\n".join(part) + "\n")
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = read_log_text(spark, str(tmp_path)).collect()
        head = read_log_text(spark, str(tmp_path), 301).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["value"] for r in sorted(got)] == lines and sorted(r["line_number"] for r in got) == list(range(1, 901))
    assert sorted(r["value"] for r in head) == sorted(lines[:301])


def test_parse_once(spark, log):
    """One scan gives records, rejects and counts, as the three operators by themselves."""
    lines = read_log_text(spark, log)
    records, rejects, n = P.parse_once(lines)
    assert sorted(map(str, records.collect())) == sorted(map(str, P.parse_lines(lines).collect()))
    assert sorted(rejects.collect()) == sorted(P.rejects(lines).collect())
    assert n == {"total_lines": 16, "parsed": 12, "failed": 4}


def test_rows_at_a_place(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 5, 9])) for i in rng.sample(range(10_000), 500)]
    frame = spark.createDataFrame(rows, "id long, size long").repartition(4)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for k in (0, 1, 250, 499):
        assert [tuple(r) for r in ranking.row_at(frame, "size", "id", F.lit(k), bucket=100).collect()] == [order[k]]
    assert ranking.row_at(frame, "size", "id", F.lit(500)).count() == 0
    numbers = ranking.numbered(frame, ["size", "id"], "place").collect()
    assert [tuple(r)[:2] for r in sorted(numbers, key=lambda r: r["place"])] == order and {r["place"] for r in numbers} == set(range(1, 501))


def test_plans(spark, sf_dir):
    """Statistics need no numbers; nothing ranks all incidents; distinct counts do not expand rows; windows leave one branch without a Window."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    queries = Q.queries()
    for name in ("incident_stats", "severity_distribution", "mean_markers", "severity_color"):
        text = plan(queries[name](spark, sf_dir))
        assert "numbered" not in text and "Window" not in text and "_mark" not in text
    assert "Expand" not in plan(queries["dataset_overview"](spark, sf_dir)) + plan(queries["distinct_blocks"](spark, sf_dir))
    grouped = plan(queries["grouped_logs"](spark, sf_dir))
    assert "Window" not in grouped and "Union" not in grouped


def test_describe_small(spark):
    for values in ([3.0], [1.0, 2.0], [1.0, 2.0, 4.0, 8.0, 8.0, 8.0], []):
        frame = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = R.describe(frame, "v").first()
        want = np.percentile(values, [25, 50, 75]).round(6).tolist() if values else [None] * 3
        assert [got[c] for c in ("n", "p25", "p50", "p75")] == [len(values), *want]


def test_command_line(spark, log, tmp_path, capfd):
    parsed, found = f"{tmp_path}/parsed.json", f"{tmp_path}/incidents.jsonl"
    cli.main(["parse", log, parsed], spark)
    cli.main(["group", parsed, found], spark)
    cli.main(["profile", parsed, found], spark)
    rows = {(r["block_id"], r["start_time"]): r for r in read_records_json(spark, found, INCIDENT).collect()}
    assert sorted(rows) == [("blk_-1", "2008-11-09T20:35:18"), ("blk_12", "1969-01-01T00:00:00"), ("blk_22", "2008-11-09T20:35:19"), ("blk_22", "2008-11-09T20:41:00")]
    first = rows[("blk_22", "2008-11-09T20:35:19")]
    assert (first["incident_id"], first["num_logs"], first["severity"], first["duration_seconds"]) == (2, 2, "ERROR", 2.0)
    assert sorted(r["line_number"] for r in spark.read.json(f"{parsed}.rejects.jsonl").collect()) == [5, 13, 14]
    assert [r["timestamp"] for r in spark.read.json(f"{found}.ungroupable.jsonl").orderBy("line_number").collect()] == ["2009-02-30T10:10:10", "2009-02-28T24:00:00"]
    array = f"{tmp_path}/incidents.json"
    cli.main(["group", parsed, array], spark)
    with open(array) as f:
        assert sorted((r["block_id"], len(r["logs"])) for r in json.load(f)) == sorted((r["block_id"], r["num_logs"]) for r in rows.values())
    cli.main(["group", parsed, f"{tmp_path}/folder"], spark)
    assert spark.read.json(f"{tmp_path}/folder/incidents").count() == 4
    shown = capfd.readouterr().out
    cli.main(["profile", parsed, f"{tmp_path}/folder"], spark)
    assert not Counter(capfd.readouterr().out.splitlines()) - Counter(shown.splitlines()), "chunks give the profile of nested incidents"
    assert "Created 4 incidents from 6 logs, 1.5 logs each" in shown and '"severity_distribution"' in shown and "blocks: 3" in shown
    assert "75.0%" in shown and "impossible" in shown and "Failure keywords" in shown and "2009-02-30T10:10:10" in shown


def test_severity_map(spark):
    found = spark.createDataFrame([("WARN",), ("INFO",), ("WARN",)], "severity string")
    assert I.severity_map(found).first()["severity_distribution"] == {"WARN": 2, "INFO": 1}


def test_stats_record(spark):
    found = spark.createDataFrame([("WARN", 2, 1.0), ("INFO", 4, 3.0)], "severity string, num_logs long, duration_seconds double")
    got = I.stats_record(found).first()
    assert got["severity_distribution"] == {"WARN": 1, "INFO": 1} and (got["total_incidents"], got["total_logs"], got["avg_logs_per_incident"]) == (2, 6, 3.0)
    assert I.stats_record(found.limit(0)).count() == 0


def test_stream_of_files(spark, log, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, lines in (("a", LINES[:3]), ("b", LINES[3:])):
        (source / name).write_text("\n".join(lines))
    stream_parsed(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/marks").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 11


def test_stream_of_incidents(spark, tmp_path):
    """Lines of shuffled files, at most so late, get the anchors of a batch; those behind the watermark are out, the others wait."""
    rng = random.Random(6)
    rows = sorted((rng.randrange(0, 6_000), f"blk_{rng.randrange(4)}", i) for i in range(300))
    text = lambda t, b, i: f"090101 {t // 3600:02d}{t // 60 % 60:02d}{t % 60:02d} {i} INFO a.b: of {b}"
    source = tmp_path / "in"
    source.mkdir()
    late = sorted(rows, key=lambda r: r[0] + rng.randrange(0, 500))  # within the delay of ten minutes
    for k in range(0, 300, 50):
        (source / f"{k:03d}").write_text("\n".join(text(*r) for r in late[k : k + 50]))
        os.utime(source / f"{k:03d}", (1_600_000_000 + k, 1_600_000_000 + k))
    for k, t in (("998", 20_000), ("999", 30_000)):  # the watermark of a batch counts in the next one
        (source / k).write_text(text(t, "blk_99", k))
    stream_grouped(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/marks", files=1).awaitTermination()
    got = {int(r["thread_id"]): r["anchor"] for r in spark.read.parquet(f"{tmp_path}/out").withColumn("anchor", F.unix_timestamp("anchor")).collect()}
    zero = 1_230_768_000
    want = {}
    for b in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == b]
        want |= {i: zero + a for (_, _, i), a in zip(own, _greedy([t for t, _, _ in own], 300), strict=True)}
    assert {i: a for i, a in got.items() if i < 900} == want
