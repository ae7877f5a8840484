"""Profiles of logs and incidents: the data behind each table and figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import text as X
from emberlog.functions.ranking import row_at
from emberlog.session import stored


def dataset_overview(parsed: DataFrame) -> DataFrame:
    """Rows, time range and length, share with a block id, distinct blocks and components.

    Records are counted per pair of block and component before they are shuffled; pairs are written once,
    and each figure is a plain count over them.
    """
    ts = F.col("timestamp").try_cast("timestamp_ntz")
    pairs = stored(parsed.groupBy("block_id", "component").agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")), "pairs")
    totals = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_logs"), F.min("first").alias("first"), F.max("last").alias("last"), F.coalesce(F.sum(F.when(F.col("block_id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_block"))
    distinct = lambda c, name: pairs.filter(F.col(c).isNotNull()).select(c).distinct().agg(F.count("*").alias(name))
    out = totals.crossJoin(distinct("block_id", "unique_blocks")).crossJoin(distinct("component", "unique_components"))  # one row each
    return out.select(
        "total_logs",
        X.iso(F.col("first")).alias("start_time"),
        X.iso(F.col("last")).alias("end_time"),
        F.timestamp_diff("SECOND", F.col("first"), F.col("last")).alias("span_seconds"),
        "with_block",
        F.when(F.col("total_logs") > 0, F.round(F.col("with_block") / F.col("total_logs") * 100, 6)).alias("with_block_pct"),
        "unique_blocks",
        "unique_components",
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts of a column's non-null values, most first; ties by value."""
    out = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out.limit(top) if top else out


def sample_logs(parsed: DataFrame, n: int = 5) -> DataFrame:
    """The first n records, with a default block and the first 100 characters of the message."""
    first = parsed.orderBy("line_number").limit(n)
    block = F.coalesce(F.when(F.col("block_id") != "", F.col("block_id")), F.lit("N/A"))
    return first.select("line_number", "level", "component", block.alias("block"), F.substring("message", 1, 100).alias("message_start"))


def incident_summary(incidents: DataFrame, n: int | None = None) -> DataFrame:
    out = incidents.select("incident_id", "block_id", "start_time", "duration_seconds", "num_logs", "severity", F.size("components").alias("num_components"))
    return out.orderBy("incident_id").limit(n) if n else out


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample standard deviation, minimum, interpolated quartiles and maximum.

    Quartiles come from counts per value: a row per distinct value is summed up in order, not a row per
    record. Sizes of incidents have fewer distinct values than the square root of twice the logs.
    """
    value = F.col(column).cast("double")
    counts = stored(df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n")), "values")
    ordered = Window.partitionBy(F.lit(0)).orderBy("v")
    upto = counts.withColumn("upto", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))

    def quartile(p: float) -> Column:
        """Between the values at the whole places around p (n - 1)."""
        at = (F.col("all") - 1) * p
        held = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
        low, high, part = held(F.floor(at)), held(F.ceil(at)), F.max(at - F.floor(at))
        return F.round(low + (high - low) * part, 6)

    quartiles = upto.agg(quartile(0.25).alias("p25"), quartile(0.5).alias("p50"), quartile(0.75).alias("p75"))
    plain = df.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return plain.crossJoin(F.broadcast(quartiles)).select("n", "mean", "std", "min", "p25", "p50", "p75", "max")  # one row


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the least and greatest value, the last one closed; all bins, also empty ones.

    Equal values all round: the range widens by half to each side. No values: no bins.
    """
    value = F.col(column).cast("double")
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).filter(F.col("a").isNotNull())
    same = F.col("a") == F.col("b")
    ends = ends.select(F.when(same, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(same, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = df.filter(F.col(column).isNotNull()).select(value.alias("v")).crossJoin(F.broadcast(ends))  # one row
    counted = placed.groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    edges = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("w"))
    return edges.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        F.round(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("bin_start"),
        F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 6).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def mean_markers(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.round(F.avg("num_logs"), 6).alias("mean_logs"), F.round(F.avg("duration_seconds"), 6).alias("mean_duration"))


def failure_keywords(logs: DataFrame) -> DataFrame:
    """Incidents per keyword: each keyword counts once per incident whose messages contain it. Takes ``grouped_logs``."""
    words = F.array(*[F.lit(w) for w in X.FAILURE_KEYWORDS])
    found = F.filter(words, lambda w: F.contains(F.lower("message"), w))
    hits = logs.select("block_id", "anchor", F.explode(found).alias("keyword")).distinct()
    return hits.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword")


def middle_incident(incidents: DataFrame) -> DataFrame:
    """The row of the incident in the middle when sorted by size, then id. Incidents are counted, not ranked; they are read four times."""
    return row_at(incidents, "num_logs", "incident_id", F.floor(F.col("n") / 2))


def median_incident(incidents: DataFrame) -> DataFrame:
    """The middle incident as it is shown."""
    return middle_incident(incidents).select("incident_id", "block_id", "start_time", F.round("duration_seconds", 1).alias("duration_seconds"), "num_logs", "severity", F.array_join("components", ", ").alias("components"))


def median_incident_logs(incidents: DataFrame, n: int = 5) -> DataFrame:
    """The first n logs of the middle incident and how many more it has. Takes nested incidents."""
    pick = middle_incident(incidents.select("incident_id", "num_logs")).select("incident_id")
    chosen = incidents.join(F.broadcast(pick), "incident_id")
    more = F.greatest(F.size("logs") - n, F.lit(0))
    rows = chosen.select("incident_id", more.alias("more"), F.posexplode(F.slice("logs", 1, n)).alias("pos", "log"))
    return rows.select("incident_id", (F.col("pos") + 1).alias("place"), "log.level", F.substring("log.message", 1, 80).alias("message_start"), "more")


def severity_colors(incidents: DataFrame) -> DataFrame:
    counts = incidents.groupBy("severity").agg(F.count("*").alias("n"))
    return counts.withColumn("color", X.severity_color(F.col("severity")))


def distinct_blocks(parsed: DataFrame) -> DataFrame:
    """Blocks are made distinct before and after the shuffle, then counted."""
    return parsed.filter(F.col("block_id") != "").select("block_id").distinct().agg(F.count("*").alias("n_blocks"))


def chunk_logs(chunks: DataFrame, pick: DataFrame, n: int = 5) -> DataFrame:
    """The first n logs of the picked incidents (incident_id, num_logs), and how many more each has. Takes chunked incidents."""
    first = chunks.filter("chunk = 0").join(F.broadcast(pick.select("incident_id", "num_logs")), "incident_id")  # the picked ones, few
    rows = first.select("incident_id", F.greatest(F.col("num_logs") - n, F.lit(0)).cast("int").alias("more"), F.posexplode(F.slice("logs", 1, n)).alias("pos", "log"))
    return rows.select("incident_id", (F.col("pos") + 1).alias("place"), "log.level", F.substring("log.message", 1, 80).alias("message_start"), "more")
