"""JSON arrays of records, read by several tasks.

A file is cut at closing braces, which Spark's text reader does split by split. Whether such a brace
closes a record depends on what stands before the split: is the place inside a string, and how deep? A
first scan answers, for each split, both cases: what it leaves if it begins inside a string, and if it
does not. One short row a split is composed in order; then each split knows how it begins, and a second
scan emits the records. A record that goes over a split's end comes as pieces, which are put together.
Inside a valid array no brace can follow a lone backslash, so no split begins after one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.session import stored

MARK = re.compile(r'\\.|["{]', re.S)


def _walk(piece: str, inside: bool, depth: int) -> tuple[bool, int, int]:
    """String state and depth of braces after a piece, and where in it the first record begins (-1: nowhere)."""
    begin = -1
    for m in MARK.finditer(piece):
        if m[0] == '"':
            inside = not inside
        elif m[0] == "{" and not inside:
            if depth == 0 and begin < 0:
                begin = m.start()
            depth += 1
    return inside, depth, begin


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split and case: string state, depth and least depth at its end, relative to its begin."""
    found: dict[tuple, list] = {}
    for b in batches:
        for path, block, piece in zip(*(b.column(c).to_pylist() for c in ("path", "block", "value")), strict=True):
            for case in found.setdefault((path, block), [[False, 0, 0], [True, 0, 0]]):
                case[0], depth, _ = _walk(piece, case[0], case[1])
                case[1] = depth if case[0] else depth - 1
                case[2] = min(case[2], case[1])
    rows = [(p, k, [int(x) for case in cases for x in case]) for (p, k), cases in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["path", "block", "cases"])


def _records(begins: dict[tuple[str, int], tuple[bool, int, int]]):
    """Texts of records; of those over a split's end pieces: first split of the record, split, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list] = {}

        def emitted(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "first", "block", "text"])

        for b in batches:
            rows = []
            for path, block, piece in zip(*(b.column(c).to_pylist() for c in ("path", "block", "value")), strict=True):
                key = (path, block)
                if key not in state:
                    inside, depth, first = begins[key]
                    state[key] = [inside, depth, [], first]  # string state, depth, open text, split where it began (-1: here)
                s = state[key]
                opened = s[1] > 0
                inside, depth, begin = _walk(piece, s[0], s[1])
                if opened or begin >= 0:
                    s[2].append((piece if opened else piece[begin:]) + "}")
                s[0], s[1] = inside, depth if inside else depth - 1
                if s[1] == 0 and not inside and s[2]:
                    over = s[3] >= 0
                    rows.append((path, s[3] if over else None, block, "".join(s[2])))
                    s[2], s[3] = [], -1
            yield emitted(rows)
        rest = [(path, s[3] if s[3] >= 0 else block, block, "".join(s[2])) for (path, block), s in state.items() if s[2]]
        yield emitted(rest)

    return run


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON array files. An empty array or file has none.

    The driver holds a short row per split, as Spark itself does for its tasks. Only records over a split's
    end are moved; what stands between records is not looked at.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    found = pieces.mapInArrow(_splits, "path string, block long, cases array<long>")
    begins: dict[tuple[str, int], tuple[bool, int, int]] = {}  # string state, depth, split where the open record began
    file, inside, depth, first = None, False, 0, -1
    for r in found.orderBy("path", "block").toLocalIterator():
        if r["path"] != file:
            file, inside, depth, first = r["path"], False, 0, -1
        begins[(file, r["block"])] = (inside, depth, first)
        end, change, least = r["cases"][3:] if inside else r["cases"][:3]
        if depth == 0 or depth + least <= 0:
            first = r["block"]
        inside, depth = bool(end), depth + change
        if depth == 0:
            first = -1
    texts = stored(pieces.mapInArrow(_records(begins), "path string, first long, block long, text string"), "array")
    whole = texts.filter("first IS NULL").select("text")
    joined = texts.filter("first IS NOT NULL").groupBy("path", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(joined.select("text")).select(F.from_json("text", schema).alias("r")).select("r.*")
