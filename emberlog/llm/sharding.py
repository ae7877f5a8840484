"""Sharding by balanced label propagation.

Documents with equal texts are linked. Linked documents start dealt by a hash over the shards. In each
round every group that is not settled wishes to be where most of it is, among the shards that still
have room for the whole of it; if it has no document in one of these, it wishes for another of them.
Wishes are granted in full, larger groups first, while the shard has room. Only settled rows take
room, so departures and swaps need no free places. Refused groups ask again, also elsewhere, and
rounds go on until none is granted. Links are never listed as pairs.

A group that is larger than a shard is split over several, before the rounds. After them a group that
fits nowhere is split. Both kinds are fewer than the shards. At the end documents without links, which
cost nothing wherever they are, fill up the shards.

The law is ``rows``: counts of two shards are at most one apart, whatever the groups' sizes.

A group is named by the SHA-256 of its text. Rows meet their group's size and shard by ``skew``, so that
no group, however large, is one task's work.

Null texts are empty and equal to each other and to empty texts. Repeated rows are documents of their
own. Other columns do not pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.ranking import offset_by_bucket
from emberlog.llm.skew import by_weight
from emberlog.session import checkpointed

SHARDS = 24
BUCKETS = 1024
PARTS = 64  # hashed parts of the groups of about one size


def _ranked(rows: DataFrame, within: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... per ``within``, in ``BUCKETS`` hashed parts each."""
    tagged = rows.withColumn("_bucket", F.pmod(F.xxhash64("rid"), F.lit(BUCKETS)).cast("int"))
    offsets = offset_by_bucket(tagged, "_bucket", F.lit(1), within)
    place = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy("rid"))
    # BUCKETS rows a shard at most.
    return tagged.withColumn("_place", place).join(F.broadcast(offsets), [*within, "_bucket"]).withColumn(name, (F.col("bucket_offset") + F.col("_place") - 1).cast("long")).drop("_bucket", "_place", "bucket_offset")


def _split(size: int, room: list[int]) -> list[tuple[int, int]]:
    """(shard, rows) for a group that no shard can take: emptiest shards first, the rest where it fits best. Takes from ``room``."""
    out = []
    while size:
        fits = [s for s, r in enumerate(room) if r >= size]
        s = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
        n = min(size, room[s])
        out.append((s, n))
        room[s] -= n
        size -= n
    return out


def _wishes(groups: DataFrame, room: list[int]) -> DataFrame:
    """Adds ``best`` to groups (group, n_same, held): the shard with room for all that holds most of it, or null."""
    rooms = F.array(*[F.lit(r).cast("long") for r in room])
    wish = F.transform(rooms, lambda r, s: F.when(r >= F.col("n_same"), F.struct(F.coalesce(F.element_at("held", s), F.lit(0)).alias("n"), F.xxhash64("group", s).alias("tie"), s.alias("shard"))))
    return groups.withColumn("best", F.array_max(wish)["shard"])


def _granted(groups: DataFrame, room: list[int]) -> DataFrame:
    """Adds ``granted`` to groups with ``best``: larger ones first, as long as their sum is within the shard's room."""
    part = F.pmod(F.xxhash64("group", F.lit(7)), F.lit(PARTS))
    tagged = groups.withColumn("_bucket", ((64 - F.length(F.bin("n_same"))) * PARTS + part).cast("int"))
    # At most 64 x PARTS rows a shard.
    offsets = offset_by_bucket(tagged, "_bucket", F.col("n_same"), ["best"])
    upto = Window.partitionBy("best", "_bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = tagged.withColumn("_upto", F.sum("n_same").over(upto)).join(F.broadcast(offsets), ["best", "_bucket"])
    within = F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("best") + 1)
    return summed.withColumn("granted", F.col("bucket_offset") + F.col("_upto") <= within).drop("_bucket", "_upto", "bucket_offset")


def _propagated(groups: DataFrame, room: list[int]) -> tuple[DataFrame | None, DataFrame]:
    """Settled groups (group, n_same, shard), and those that fit nowhere. Takes from ``room``."""
    settled = None
    while True:
        asked = checkpointed(_granted(_wishes(groups, room).filter("best IS NOT NULL"), room))
        taken = asked.filter("granted").groupBy("best").agg(F.sum("n_same").alias("n")).collect()
        if not taken:
            return settled, groups
        for r in taken:
            room[r["best"]] -= r["n"]
        new = asked.filter("granted").select("group", "n_same", F.col("best").cast("int").alias("shard"))
        settled = new if settled is None else settled.unionByName(new)
        nowhere = _wishes(groups, [r + sum(x["n"] for x in taken if x["best"] == s) for s, r in enumerate(room)]).filter("best IS NULL").drop("best")
        groups = checkpointed(asked.filter("NOT granted").drop("best", "granted").unionByName(nowhere))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, n_same (documents of equal text), shard, slot (0, 1, ... in the shard)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("group"))
    # Numbered once and written, so numbers hold when a task runs again.
    base = checkpointed(narrow.withColumn("rid", F.monotonically_increasing_id()))
    total = base.count()
    room = [total // shards + (s < total % shards) for s in range(shards)]

    start = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard")
    held = base.groupBy("group", start).agg(F.count("*").alias("n"))
    # At most one entry a shard in each group's map.
    groups = checkpointed(held.groupBy("group").agg(F.sum("n").alias("n_same"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held")))
    known = checkpointed(by_weight(base, groups.select("group", "n_same"), ["group"], "n_same"))

    limit = total // shards
    linked = groups.filter("n_same > 1")
    parts = [(r["group"], _split(r["n_same"], room)) for r in linked.filter(F.col("n_same") > limit).select("group", "n_same").orderBy(F.desc("n_same"), "group").collect()]
    settled, rest = _propagated(linked.filter(F.col("n_same") <= limit), room)
    # The smallest of these is larger than any shard's room, and all rooms hold them all: fewer than the shards.
    parts += [(r["group"], _split(r["n_same"], room)) for r in rest.select("group", "n_same").orderBy(F.desc("n_same"), "group").collect()]

    labels = []
    if settled is not None:
        own = known.filter((F.col("n_same") > 1) & (F.col("n_same") <= limit)).select("rid", "group")
        labels.append(by_weight(own, settled, ["group"], "n_same").select("rid", "shard"))
    if parts:
        cuts = [(g, [s for s, _ in p], [sum(n for _, n in p[: i + 1]) for i in range(len(p))]) for g, p in parts]
        cut = F.broadcast(docs.sparkSession.createDataFrame(cuts, "group binary, shards array<int>, ends array<long>"))
        spots = _ranked(known.filter("n_same > 1").select("rid", "group").join(cut, "group"), ["group"], "spot")
        labels.append(spots.select("rid", F.get("shards", F.size(F.filter("ends", lambda e: e <= F.col("spot")))).alias("shard")))

    # Free documents by their place among them: shard s takes as many as it has places left.
    ends = [sum(room[: s + 1]) for s in range(shards)]
    free = _ranked(known.filter("n_same = 1").select("rid"), [], "place")
    chosen = reduce(lambda rest, s: F.when(F.col("place") < ends[s], s).otherwise(rest), range(shards - 2, -1, -1), F.lit(shards - 1))
    labels.append(free.select("rid", chosen.cast("int").alias("shard")))
    placed = checkpointed(known.drop("group").join(reduce(DataFrame.unionByName, labels), "rid"))
    return _ranked(placed, ["shard"], "slot").select("doc_id", "size", "text_crc32", "n_same", "shard", "slot")


def digest(assigned: DataFrame) -> DataFrame:
    return assigned.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_same")
