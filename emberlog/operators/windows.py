"""Anchored greedy windows.

Per block, in order of time: the first log is the anchor; a log belongs to the anchor's incident while
its time minus the anchor's is at most the window; the next one is a new anchor.

Blocks of usual size are sorted, each in one task, and streamed past. A hot block is cut into time
buckets. What a bucket does to the anchor that enters it is a small table: for each time that may become
the first anchor inside, the last one that follows from it. Tables of consecutive buckets compose to
tables of the same kind, so the anchors that enter all buckets are found by composing ``FAN`` at a time
upwards and handing anchors downwards; then every bucket is its own task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.ranking import SMALL
from emberlog.session import stored

STRATEGIES = ("auto", "stream", "fold", "buckets")
HOT = 1 << 20  # rows of a block that one task sorts
WINDOWS = 16  # windows in a bucket
FAN = 64  # buckets composed at a time
NEVER = -(1 << 62)
ROWS = 10_000

Function = tuple[np.ndarray, np.ndarray]


def _us(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def _ts(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))


def _chains(logs: DataFrame, seconds: int) -> DataFrame:
    """Adds ``chain``: a gap beyond the window always starts an incident, so chains are independent."""
    order = Window.partitionBy("block_id").orderBy("ts", "line_number")
    late = F.timestamp_diff("MICROSECOND", F.lag("ts").over(order), F.col("ts")) > seconds * 1_000_000
    cut = logs.withColumn("cut", F.when(late, 1).otherwise(0))
    return cut.withColumn("chain", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def greedy(times: np.ndarray, span: int, anchor: int) -> np.ndarray:
    """The anchor of each of sorted times, given the one that enters."""
    out, i = np.empty(len(times), np.int64), 0
    while i < len(times):
        j = i + int(np.searchsorted(times[i:], anchor + span, "right"))
        out[i:j] = anchor
        if j < len(times):
            anchor = int(times[j])
        i = j
    return out


def _stream(span: int):
    """Arrow batches sorted by (block, time): adds the anchor. Only the last block, time and anchor carry over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, anchor = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            times = b.column("us").to_numpy()
            blocks = b.column("block_id").dictionary_encode()
            codes = blocks.indices.to_numpy()
            goes_on = blocks.dictionary[codes[0]].as_py() == block and int(times[0]) - last <= span
            # A gap beyond the window always starts an incident; a stretch no longer than the window is one.
            begin = np.concatenate([[0], np.flatnonzero((codes[1:] != codes[:-1]) | (times[1:] - times[:-1] > span)) + 1])
            end = np.concatenate([begin[1:], [len(times)]])
            first = times[begin].copy()
            if goes_on:
                first[0] = anchor
            out = np.repeat(first, end - begin)
            for k in np.flatnonzero(times[end - 1] - first > span):
                out[begin[k] : end[k]] = greedy(times[begin[k] : end[k]], span, int(first[k]))
            block, last, anchor = blocks.dictionary[codes[-1]].as_py(), int(times[-1]), int(out[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "anchor_us"])

    return run


def _streamed(logs: DataFrame, span: int) -> DataFrame:
    timed = logs.withColumn("us", _us(F.col("ts"))).repartition("block_id").sortWithinPartitions("block_id", "us")
    out = timed.mapInArrow(_stream(span), T.StructType([*timed.schema.fields, T.StructField("anchor_us", T.LongType())]))
    return out.withColumn("anchor", _ts(F.col("anchor_us"))).select(*logs.columns, "anchor")


def _folded(logs: DataFrame, seconds: int) -> DataFrame:
    keys, columns = ["block_id", "chain"], [*logs.columns, "anchor"]
    whole = Window.partitionBy(*keys)
    sized = _chains(logs, seconds).withColumn("chain_start", F.min("ts").over(whole)).withColumn("chain_end", F.max("ts").over(whole))
    span = F.expr(f"INTERVAL '{seconds}' SECOND")
    long = F.col("chain_end") > F.col("chain_start") + span
    short = sized.filter(~long).withColumn("anchor", F.col("chain_start")).select(*columns)
    wide = sized.filter(long).drop("chain_start", "chain_end")
    none = F.array().cast("array<timestamp_ntz>")
    anchors = F.aggregate(
        F.array_sort(F.collect_set("ts")), none, lambda acc, t: F.when((F.size(acc) == 0) | (t > F.element_at(acc, -1) + span), F.concat(acc, F.array(t))).otherwise(acc)
    )
    folded = wide.join(wide.groupBy(*keys).agg(anchors.alias("anchors")), keys)
    return short.unionByName(folded.withColumn("anchor", F.array_max(F.filter("anchors", lambda a: a <= F.col("ts")))).select(*columns))


# What a bucket does to anchors


def _short(starts: np.ndarray, ends: np.ndarray, limit: int) -> Function:
    """Without starts that no anchor before the bucket can lead to (beyond the first after ``limit``), and one start for equal ends."""
    n = int(np.searchsorted(starts, limit, "right")) + 1
    starts, ends = starts[:n], ends[:n]
    kept = np.concatenate([ends[1:] != ends[:-1], [True]])
    return starts[kept], ends[kept]


def transfer(times: np.ndarray, span: int, begin: int) -> Function:
    """Of a bucket that begins at ``begin``: the first start beyond entering anchor + span gives the leaving anchor; without one the anchor passes through."""
    after = np.searchsorted(times, times + span, "right")
    last = np.where(after < len(times), np.minimum(after, len(times) - 1), np.arange(len(times)))
    while not np.array_equal(last, last[last]):
        last = last[last]
    return _short(times, times[last], begin + span - 1)


def leaving(f: Function, span: int, anchor: np.ndarray) -> np.ndarray:
    starts, ends = f
    i = np.searchsorted(starts, anchor + span, "right")
    return np.where(i < len(starts), ends[np.minimum(i, len(starts) - 1)], anchor)


def composed(f: Function, g: Function, span: int, begin: int) -> Function:
    """First f, then g, whose times are all later; f's bucket begins at ``begin``."""
    return _short(np.concatenate([f[0], g[0]]), np.concatenate([leaving(g, span, f[1]), g[1]]), begin + span - 1)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of sorted batches: rows that agree in ``keys``."""
    held = None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            c = b.column(k)
            c = (c.dictionary_encode().indices if pa.types.is_string(c.type) else c).to_numpy()
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield b.slice(i, j - i)
        held = b.slice(cuts[-1])
    if held is not None:
        yield held


def _lists(column: pa.Array) -> list[np.ndarray]:
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[i:j] for i, j in zip(at, at[1:], strict=False)]


def _emitted(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about ``ROWS`` from tuples of columns, one tuple a group."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[0])
        if n >= ROWS:
            yield _batch(held, schema)
            held, n = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    def column(i: int, f: pa.Field) -> pa.Array:
        if pa.types.is_list(f.type):
            return pa.array([x for r in held for x in r[i]], f.type)
        parts = [pa.array(r[i], f.type) if not isinstance(r[i], pa.Array) else r[i] for r in held]
        return pa.concat_arrays(parts)

    return pa.RecordBatch.from_arrays([column(i, f) for i, f in enumerate(schema)], schema=schema)


_LISTS = [("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
_TABLE = pa.schema([("block_id", pa.string()), ("bucket", pa.int64()), *_LISTS])
_TABLE_SQL = "block_id string, bucket long, starts array<long>, ends array<long>"


def _tables(span: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for g in _groups(batches, ["block_id", "bucket"]):
                bucket = g.column("bucket")[0].as_py()
                starts, ends = transfer(g.column("us").to_numpy(), span, bucket * length)
                yield g.column("block_id").slice(0, 1), [bucket], [starts], [ends]

        yield from _emitted(each(), _TABLE)

    return run


def _up(span: int, length: int):
    """``FAN`` tables to one, which begins where the first of them does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for g in _groups(batches, ["block_id", "parent"]):
                own = list(zip(_lists(g.column("starts")), _lists(g.column("ends")), strict=True))
                f = own[0]
                for more in own[1:]:
                    f = composed(f, more, span, g.column("bucket")[0].as_py() * length)
                yield g.column("block_id").slice(0, 1), g.column("parent").slice(0, 1), [f[0]], [f[1]]

        yield from _emitted(each(), _TABLE)

    return run


def _down(span: int):
    """Entering anchors of buckets from that of their parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for g in _groups(batches, ["block_id", "parent"]):
                anchor, enters = g.column("enters")[0].as_py(), []
                for f in zip(_lists(g.column("starts")), _lists(g.column("ends")), strict=True):
                    enters.append(anchor)
                    anchor = int(leaving(f, span, np.array([anchor]))[0])
                yield g.column("block_id"), g.column("bucket"), enters

        yield from _emitted(each(), pa.schema([("block_id", pa.string()), ("bucket", pa.int64()), ("enters", pa.int64())]))

    return run


def _inside(span: int):
    """Anchors of the points of each bucket from the one that enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for g in _groups(batches, ["block_id", "bucket"]):
                yield g.column("block_id"), g.column("us"), greedy(g.column("us").to_numpy(), span, g.column("enters")[0].as_py())

        yield from _emitted(each(), pa.schema([("block_id", pa.string()), ("us", pa.int64()), ("anchor_us", pa.int64())]))

    return run


def _bucketed(logs: DataFrame, span: int, windows: int = WINDOWS, fan: int = FAN) -> DataFrame:
    """Anchors by time buckets. Equal times of a block are one point, combined before they are shuffled."""
    if span == 0:
        return logs.withColumn("anchor", F.col("ts"))
    length, us = span * windows, F.col("us")
    timed = logs.withColumn("us", _us(F.col("ts")))
    points = timed.select("block_id", "us").distinct()
    points = stored(points.withColumn("bucket", F.call_function("div", us - F.pmod(us, F.lit(length)), F.lit(length))), "points")
    under = lambda df, *keys: df.repartition(*keys[:2]).sortWithinPartitions(*keys)
    parent = F.call_function("div", F.col("bucket") - F.pmod("bucket", F.lit(fan)), F.lit(fan))

    levels = [stored(under(points, "block_id", "bucket", "us").mapInArrow(_tables(span, length), _TABLE_SQL), "tables")]
    lengths = [length]
    while (levels[-1].groupBy("block_id").count().agg(F.max("count")).first()[0] or 0) > fan:
        below = levels[-1].withColumn("parent", parent)
        levels.append(stored(under(below, "block_id", "parent", "bucket").mapInArrow(_up(span, lengths[-1]), _TABLE_SQL), "tables"))
        lengths.append(lengths[-1] * fan)
    # At most ``fan`` tables a block are left.
    rows = levels[-1].withColumn("parent", F.lit(0).cast("long")).withColumn("enters", F.lit(NEVER))
    while True:
        enters = under(rows, "block_id", "parent", "bucket").mapInArrow(_down(span), "block_id string, bucket long, enters long")
        levels.pop()
        if not levels:
            break
        rows = levels[-1].withColumn("parent", parent).join(enters.withColumnRenamed("bucket", "parent"), ["block_id", "parent"])
    entered = under(points.join(enters, ["block_id", "bucket"]), "block_id", "bucket", "us")
    anchors = entered.mapInArrow(_inside(span), "block_id string, us long, anchor_us long")
    return timed.join(anchors, ["block_id", "us"]).withColumn("anchor", _ts(F.col("anchor_us"))).select(*logs.columns, "anchor")


def assign_anchor(logs: DataFrame, minutes: int = 5, strategy: str = "auto", hot: int = HOT) -> DataFrame:
    """Adds ``anchor`` (TIMESTAMP_NTZ) to logs with block_id and ts (TIMESTAMP_NTZ).

    stream: one pass over sorted Arrow batches, a block in one task; linear in time, constant in memory.
    buckets: a block in as many tasks as it has time buckets; for any size. fold: native expressions over each chain's
    sorted times (needs line_number, unique), for moderate chains. auto: buckets for blocks of more than ``hot`` rows,
    stream for the others; it reads ``logs`` several times, so it suits a stored table.
    Logs must have no null block_id or ts. A window of 0 groups equal times; a negative one is refused.
    """
    if minutes < 0:
        raise ValueError("minutes must not be negative")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    span = minutes * 60_000_000
    if strategy == "fold":
        return _folded(logs, minutes * 60)
    if strategy == "buckets":
        return _bucketed(logs, span)
    if strategy == "stream" or logs.count() <= hot:
        return _streamed(logs, span)
    blocks = stored(logs.groupBy("block_id").count().filter(F.col("count") > hot).select("block_id"), "hot-blocks")
    n = blocks.count()
    if not n:
        return _streamed(logs, span)
    listed = F.broadcast(blocks) if n <= SMALL else blocks
    return _streamed(logs.join(listed, "block_id", "left_anti"), span).unionByName(_bucketed(logs.join(listed, "block_id", "left_semi"), span))
