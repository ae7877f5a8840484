"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.session import checkpointed

SMALL = 1 << 17


def together(df: DataFrame, n: int) -> DataFrame:
    """``df`` in one partition if its ``n`` rows are few; joins and aggregates on it need no shuffle then."""
    return df.coalesce(1) if n <= SMALL else df


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns u, v (long). Returns node, component (the smallest node reachable); nodes without an edge are absent.

    Each round joins edges with the smallest neighbour of each node; no neighbourhood is gathered.
    Rounds grow with the logarithm of the longest path. Each round is written to the checkpoint folder.
    A graph of at most ``SMALL`` edges is one task's work and needs no shuffle.
    """
    e = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark, n = None, e.count()
    while True:
        both = together(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), n)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = together(small, n).distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
