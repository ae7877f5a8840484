"""Anchored windows on streams.

A late log could move the anchors of its block, so logs wait in state until the watermark has passed
their time, and are then released in the order of time. A block's state is its open anchor and the logs
that wait. Released logs get the anchors that they would get in a batch of all logs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from emberlog.streaming.parse import records

FIELDS = ["thread_id", "level", "component", "message", "raw_line"]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "block_id string, ts_us long, anchor_us long, " + ", ".join(f"{c} string" for c in FIELDS)


class Anchors(StatefulProcessor):
    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", "anchor_us long")
        self.count = handle.getValueState("count", "n long")
        self.waiting = handle.getMapState("waiting", "ts_us long, n long", ", ".join(f"{c} string" for c in FIELDS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        due = set()
        for frame in rows:
            for r in frame.itertuples(index=False):
                self.waiting.updateValue((int(r.ts_us), n), tuple(getattr(r, c) for c in FIELDS))
                due.add(-(-int(r.ts_us) // 1000))
                n += 1
        self.count.update((n,))
        for ms in due:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All logs whose time the watermark has reached; what a later timer of this batch would release goes with them."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        anchor = self.anchor.get()[0] if self.anchor.exists() else None
        out = []
        for at in sorted(k for k in self.waiting.keys() if k[0] <= passed):
            if anchor is None or at[0] - anchor > self.span:
                anchor = at[0]
            out.append((key[0], at[0], anchor, *self.waiting.getValue(at)))
            self.waiting.removeKey(at)
        if out:
            self.anchor.update((anchor,))
            yield pd.DataFrame(out, columns=["block_id", "ts_us", "anchor_us", *FIELDS])

    def close(self) -> None:
        pass


def grouped(parsed: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Streaming records with ``ts`` and ``anchor`` (TIMESTAMP): logs may come up to ``delay`` late; those that come later yet are dropped."""
    span = minutes * 60_000_000
    # Watermarks want an instant; the time without a zone is taken as UTC on both ways.
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    timed = parsed.filter((F.col("block_id") != "") & F.col("ts").isNotNull()).select("block_id", us.alias("ts_us"), F.timestamp_micros(us).alias("at"), *FIELDS)
    keyed = timed.withWatermark("at", delay).groupBy("block_id")
    out = keyed.transformWithStateInPandas(Anchors(span), OUT, "Append", "EventTime")
    return out.select("block_id", F.timestamp_micros("ts_us").alias("ts"), F.timestamp_micros("anchor_us").alias("anchor"), *FIELDS)


def stream_grouped(spark: SparkSession, source: str, sink: str, checkpoint: str, minutes: int = 5, delay: str = "10 minutes", files: int | None = None) -> StreamingQuery:
    """Logs of new text files of a folder with the anchor of their incident, into Parquet, then stop; the last ones wait for a next run."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = grouped(records(spark, source, files), minutes, delay).writeStream.format("parquet")
    return out.option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
