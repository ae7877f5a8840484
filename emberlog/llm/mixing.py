"""Mixing sources to target weights by Pfair scheduling.

Documents of a source line up in a hashed order and are cut into blocks. With the weight w of its source,
as a share of all weights, block k may not start before slot floor(k / w) and must start before slot
ceil((k + 1) / w); each slot goes to the released block with the earliest deadline. Every source is then
less than one block away from its share at every slot, as long as it lasts; slots that nobody may take,
because sources have run out, stay empty. No document is dropped or repeated.

Weights are whole multiples of 2^-40 of their sum, and at least one; releases and deadlines are computed
in whole numbers for each block, so nothing drifts, whatever the weights. A block has ``block_bytes``, or
more where the corpus would give more than ``MOST_BLOCKS``: the schedule is a fold in one row over all
blocks, whose work is their number times that of the sources. It suits hundreds of sources. Documents meet the
schedule in a join by source and block. Native expressions only.

A null source is a source of its own; a null text has no bytes and counts as one byte. Repeated rows
stay. Other columns pass through; those that ``mix`` adds replace columns of their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.ranking import offset_by_bucket
from emberlog.llm.words import let
from emberlog.session import stored

BLOCK_BYTES = 16 << 10
MOST_BLOCKS = 1 << 17
SCALE = 1 << 40
EXPONENT = 0.7
BUCKETS = 1024
RUN = 512  # blocks whose documents are counted together
FOLD = 64  # slots between two copies of the schedule so far
ADDED = ["mix_source", "mix_bytes", "mix_block", "mix_slot", "mix_position"]


def shares(sizes: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """weight (a multiple of 1 / all), all, blocks and block_bytes of each source.

    ``sizes``: mix_source and total bytes, one row per source. Without ``weights`` a source counts as
    its bytes to the power ``exponent``; a source not in ``weights`` has the least weight that there is.
    """
    if weights is None:
        weight = F.pow(F.greatest(F.col("bytes"), F.lit(1)), F.lit(exponent))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source") == name, float(w)).otherwise(weight)
    every = Window.partitionBy(F.lit(0))  # a row per source
    w = sizes.withColumn("_weight", weight).withColumn("_sum", F.sum("_weight").over(every))
    share = F.when(F.col("_sum") > 0, F.col("_weight") / F.col("_sum")).otherwise(1 / F.count("*").over(every))
    w = w.withColumn("weight", F.greatest(F.round(share * SCALE), F.lit(1)).cast("long"))
    w = w.withColumn("all", F.sum("weight").over(every))
    w = w.withColumn("block_bytes", F.greatest(F.lit(block_bytes), F.ceil(F.sum("bytes").over(every) / MOST_BLOCKS)).cast("long"))
    return w.select("mix_source", "weight", "all", F.ceil(F.col("bytes") / F.col("block_bytes")).cast("long").alias("blocks"), "block_bytes")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def schedule(share: DataFrame) -> DataFrame:
    """All blocks of all sources, earliest deadline first: mix_source, mix_block, mix_slot and mix_rank (0, 1, ... without the empty slots)."""
    sources = share.agg(F.sort_array(F.collect_list(F.struct("mix_source", "weight", "blocks"))).alias("s"), F.max("all").alias("all"), F.sum("blocks").alias("n"))

    def block(k: Column, i: Column) -> Column:
        """Of source i: what is compared comes first."""
        w, all_ = F.get("s", i)["weight"], F.col("all")
        return F.struct(_div((k + 1) * all_ + w - 1, w).alias("due"), i.alias("i"), _div(k * all_, w).alias("release"), k.alias("k"))

    def step(acc: Column) -> Column:
        """acc: the next slot, the next block of each source that has one, and the blocks of the slots so far."""
        now = F.greatest(acc["t"], F.array_min(F.transform(acc["next"], lambda x: x["release"])))

        def taken(t: Column) -> Column:
            best = F.array_min(F.filter(acc["next"], lambda x: x["release"] <= t))

            def after(b: Column) -> Column:
                k = b["k"] + 1
                rest = F.filter(acc["next"], lambda x: x["i"] != b["i"])
                more = F.when(k < F.get("s", b["i"])["blocks"], F.array(block(k, b["i"]))).otherwise(F.filter(rest, lambda x: F.lit(False)))
                return F.struct((t + 1).alias("t"), F.concat(rest, more).alias("next"), F.concat(acc["picks"], F.array(F.struct(b["i"].alias("i"), b["k"].alias("k"), t.alias("slot")))).alias("picks"))

            return let(best, after)

        return let(now, taken)

    none = F.array().cast("array<struct<i:int,k:bigint,slot:bigint>>")
    longs = lambda a, z, by=1: F.sequence(a, z, F.lit(by).cast("long"))

    def some(acc: Column, t: Column) -> Column:
        """FOLD slots, at most all that are left."""
        begin = F.struct(acc["t"].alias("t"), acc["next"].alias("next"), none.alias("picks"))
        own = F.aggregate(longs(t, F.least(t + (FOLD - 1), F.col("n") - 1)), begin, lambda a, _: step(a))
        return let(own, lambda o: F.struct(o["t"].alias("t"), o["next"].alias("next"), F.concat(acc["runs"], F.array(o["picks"])).alias("runs")))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("t"), F.transform("s", lambda x, i: block(F.lit(0).cast("long"), i)).alias("next"), F.array().cast("array<array<struct<i:int,k:bigint,slot:bigint>>>").alias("runs"))
    picks = F.flatten(F.aggregate(longs(zero, F.col("n") - 1, FOLD), start, some)["runs"])
    rows = sources.filter("n > 0").select("s", F.posexplode(picks).alias("rank", "b"))
    return rows.select(F.get("s", F.col("b")["i"])["mix_source"].alias("mix_source"), F.col("b")["k"].alias("mix_block"), F.col("b")["slot"].alias("mix_slot"), F.col("rank").alias("mix_rank"))


def _sides(plan: DataFrame) -> DataFrame:
    """For a join: broadcast where it has no more than the blocks that a schedule may have and a few for the ends of sources."""
    return F.broadcast(plan) if plan.count() <= 2 * MOST_BLOCKS else plan


def slots(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, columns: list[str] | None = None) -> DataFrame:
    """_row (the document's own columns, or those of ``columns``), _id, mix_source, mix_bytes, mix_block, mix_slot, mix_rank and _from, the bytes of the source before the document.

    The running sum of bytes in a source is taken in ``BUCKETS`` hashed parts, so a source that holds
    most rows is spread over as many tasks.
    """
    size = F.greatest(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)), F.lit(1)).cast("long")
    mark = F.xxhash64("doc_id", F.col("text").cast("string"))
    own = F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("_row")
    sized = docs.select(own, F.col("doc_id").alias("_id"), F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")).alias("mix_source"), size.alias("mix_bytes"), mark.alias("_mark"))
    sized = sized.withColumn("_bucket", F.pmod("_mark", F.lit(BUCKETS)).cast("int"))

    narrow = stored(sized.groupBy("mix_source", "_bucket").agg(F.sum("mix_bytes").alias("bytes")), "sizes")
    named = {f"s:{k}": v for k, v in weights.items()} if weights is not None else None
    share = stored(shares(narrow.groupBy("mix_source").agg(F.sum("bytes").alias("bytes")), named, block_bytes=block_bytes), "shares")
    plan = stored(schedule(share), "plan")
    offsets = offset_by_bucket(narrow, "_bucket", F.col("bytes"), ["mix_source"]).join(share.select("mix_source", "block_bytes"), "mix_source")

    before = Window.partitionBy("mix_source", "_bucket").orderBy("_mark", "_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inside", F.coalesce(F.sum("mix_bytes").over(before), F.lit(0))).join(offsets, ["mix_source", "_bucket"])
    placed = placed.withColumn("_from", F.col("bucket_offset") + F.col("_inside")).withColumn("mix_block", _div(F.col("_from"), F.col("block_bytes")))
    met = placed.join(_sides(plan), ["mix_source", "mix_block"])
    return met.select("_row", "_id", "mix_source", "mix_bytes", "mix_block", "mix_slot", "mix_rank", "_from")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, columns: list[str] | None = None) -> DataFrame:
    """Adds mix_source, mix_bytes, mix_block (of the source), mix_slot and mix_position (0, 1, ... in the mixed order); ``columns`` names the own columns to carry, all without it."""
    kept = [c for c in columns or docs.columns if c.lower() not in ADDED]
    return _position(slots(docs, weights, block_bytes, kept)).select("_row.*", *ADDED)


def _position(slotted: DataFrame) -> DataFrame:
    """Counts per run of blocks, then per block of a run, then the place inside the block; all but the last are at most ``MOST_BLOCKS`` rows and a few."""
    counts = stored(slotted.groupBy("mix_rank").agg(F.count("*").alias("rows")).withColumn("run", F.floor(F.col("mix_rank") / RUN)), "blocks")
    upto = Window.partitionBy("run").orderBy("mix_rank").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("inside", F.coalesce(F.sum("rows").over(upto), F.lit(0))).join(offset_by_bucket(counts, "run", F.col("rows")), "run")
    place = F.row_number().over(Window.partitionBy("mix_rank").orderBy("_from", "_id"))
    before = _sides(offsets.select("mix_rank", (F.col("bucket_offset") + F.col("inside")).alias("_before")))
    return slotted.withColumn("_place", place).join(before, "mix_rank").withColumn("mix_position", (F.col("_before") + F.col("_place") - 1).cast("long"))


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with their own columns, dealt to tasks by ranges of the mixed order and sorted in each.

    Slots order them; no global position is needed for that.
    """
    mixed = slots(docs, weights, block_bytes)
    return mixed.repartitionByRange("mix_slot", "_from", "_id").sortWithinPartitions("mix_slot", "_from", "_id").select("_row.*")
