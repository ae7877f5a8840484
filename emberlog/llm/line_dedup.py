"""Removal of lines that many documents share, over an index that documents join and leave.

A line's key is the line without white space at both ends and with A-Z lower-cased; keys shorter than
``SHORTEST`` code points never count. A key that ``least`` documents hold loses all its lines except in
the largest doc_id that holds it.

The index is a set of tables in the shared folder. ``refs`` has a row per key and document; ``counts``
has, per key, the exact number of its documents and the largest id. ``filters`` holds a cuckoo filter
per shard of keys, with the keys that enough documents hold: keys that reach ``least`` are inserted,
keys that fall below it are deleted, and a shard whose filter is full is built anew from its counts. So
``insert`` and ``delete`` undo each other, and each gives a new index; the old one stays valid.

Lines that no filter knows stay, and most documents end there. Lines that one knows are compared with
the counts by their 128-bit names, so the filters decide nothing by themselves. Filters go to every task
while they have at most ``FILTER_BYTES`` together; beyond, all lines are compared with the counts.
Keys that more than 1 / ``SMALL`` of all these lines have are at most ``SMALL`` and are broadcast; the
others are spread over a shuffle. Only documents with lines to compare are moved.

Null and empty texts are one empty line. Rows of one id count as one document; null ids are one document
too, never the largest. Repeated rows give repeated results. An empty table gives an empty one.
Other columns pass through, unless they have the name of an added one. An id that is inserted again
adds the lines that are new to it; delete it first to replace it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.cuckoo import LOAD, Cuckoo
from emberlog.llm.pieces import runs
from emberlog.llm.words import sha256_utf8
from emberlog.session import stored

LEAST = 3
SHORTEST = 20
SHARDS = 64
SMALL = 1 << 16
FILTER_BYTES = 64 << 20
RUN_BYTES = 8 << 20
SPACE = " \t\n\x0b\x0c\r"
ADDED = ["n_lines", "n_dropped", "kept_text"]


def line_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First line of each text among all (one more at the end); number, and both halves of the name, of each line that counts."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=SPACE))
    long = pc.greater_equal(pc.utf8_length(keys), SHORTEST)
    coded = keys.filter(long).dictionary_encode()
    names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in coded.dictionary.to_pylist()), np.int64).reshape(-1, 2)
    own = names[coded.indices.to_numpy()]
    return offsets - offsets[0], np.flatnonzero(long.to_numpy(zero_copy_only=False)), own[:, 0], own[:, 1]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and their documents, each once a run of texts."""
    for b in batches:
        begin = 0
        for part in runs(b.column("text"), RUN_BYTES):
            offsets, line, hi, lo = line_keys(part)
            doc = np.searchsorted(offsets, line, "right") - 1
            order = np.lexsort((lo, hi, doc))
            doc, hi, lo = doc[order], hi[order], lo[order]
            new = np.concatenate([np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(hi[new]), pa.array(lo[new]), b.column("doc_id").take(pa.array(begin + doc[new]))], ["hi", "lo", "doc_id"])
            begin += len(part)


def references(docs: DataFrame) -> DataFrame:
    """hi, lo (the name of a key) and doc_id, each combination once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pairs, "hi long, lo long, doc_id long").distinct()


@dataclass(frozen=True)
class LineIndex:
    """``refs``: hi, lo, doc_id. ``counts``: hi, lo, n_docs, last_doc. ``filters``: shard, filter."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    least: int = LEAST
    shards: int = SHARDS


def empty_index(spark: SparkSession, least: int = LEAST, shards: int = SHARDS) -> LineIndex:
    """``shards`` of keys: the repeated keys of one must fit a task."""
    none = lambda schema: spark.createDataFrame([], schema)
    return LineIndex(none("hi long, lo long, doc_id long"), none("hi long, lo long, n_docs long, last_doc long"), none("shard int, filter binary"), least, shards)


def _changed(keys: pa.Table, old: pa.Table) -> pa.Table:
    """The filter of a shard after its changes."""
    if not keys.num_rows:
        return old
    h, add = keys["lo"].to_numpy().view(np.uint64), keys["add"].to_numpy(zero_copy_only=False)
    if keys["anew"][0].as_py():
        found = Cuckoo.sized(2 * int(add.sum()))
    else:
        found = Cuckoo.loads(old["filter"][0].as_py())
        found.delete(h[~add])
    found.insert(h[add])
    return pa.table({"shard": pa.array([keys["shard"][0].as_py()], pa.int32()), "filter": pa.array([found.dumps()], pa.binary())})


def _filters(index: LineIndex, changes: DataFrame) -> DataFrame:
    """New filters after ``changes``: hi, lo, n_docs and was (documents of the key before)."""
    tagged = changes.withColumn("shard", F.pmod("hi", F.lit(index.shards)).cast("int"))
    holds = F.col("n_docs") >= index.least
    need = tagged.groupBy("shard").agg(F.count_if(holds).alias("need"))
    slots = index.filters.select("shard", ((F.octet_length("filter") - 8) / 2).alias("slots"))
    plan = need.join(slots, "shard", "left").select("shard", (F.col("need") > F.coalesce(F.col("slots") * LOAD, F.lit(0))).alias("anew"))
    moved = holds != (F.col("was") >= index.least)
    keys = tagged.join(F.broadcast(plan), "shard").filter(F.when(F.col("anew"), holds).otherwise(moved))  # a row per shard
    keys = keys.select("shard", "lo", "anew", holds.alias("add"))
    return stored(keys.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(_changed, "shard int, filter binary"), "line-filters")


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the lines of ``docs`` (doc_id, text)."""
    own = references(docs)
    if not index.refs.isEmpty():
        r = index.refs.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("doc_id").alias("_doc"))
        own = own.join(r, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti")
    new = stored(own, "line-refs")
    delta = new.select("hi", "lo", F.lit(1).cast("long").alias("n_docs"), F.col("doc_id").alias("last_doc"), F.lit(0).cast("long").alias("was"))
    both = index.counts.select("hi", "lo", "n_docs", "last_doc", F.col("n_docs").alias("was")).unionByName(delta)
    counts = stored(both.groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.sum("was").alias("was")), "line-counts")
    return LineIndex(index.refs.unionByName(new), counts.drop("was"), _filters(index, counts), index.least, index.shards)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of ``ids`` (doc_id); ids that it does not hold change nothing."""
    gone = ids.select(F.col("doc_id").cast("long").alias("_doc")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc"))
    left = stored(index.refs.join(gone, same, "left_anti"), "line-refs")
    less = stored(index.refs.join(gone, same, "left_semi").groupBy("hi", "lo").agg(F.count("*").alias("less")), "line-less")
    last = left.join(less, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("doc_id").alias("now_last"))
    joined = index.counts.join(less, ["hi", "lo"], "left").join(last, ["hi", "lo"], "left")
    last_doc = F.when(F.col("less").isNull(), F.col("last_doc")).otherwise(F.col("now_last"))
    changes = stored(joined.select("hi", "lo", (F.col("n_docs") - F.coalesce("less", F.lit(0))).alias("n_docs"), last_doc.alias("last_doc"), F.col("n_docs").alias("was")), "line-counts")
    return LineIndex(left, changes.filter("n_docs > 0").drop("was"), _filters(index, changes), index.least, index.shards)


def _known(filters: dict[int, bytes] | None, shards: int):
    """Adds to texts: n_lines, and places and names of the lines that a filter knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {s: Cuckoo.loads(x) for s, x in filters.items()} if filters is not None else None
        for b in batches:
            begin = 0
            for part in runs(b.column("text"), RUN_BYTES):
                offsets, line, hi, lo = line_keys(part)
                if own is not None:
                    may = np.zeros(len(line), bool)
                    shard = hi % shards
                    order = np.argsort(shard, kind="stable")
                    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
                    for s in own:
                        at = order[bounds[s] : bounds[s + 1]]
                        may[at] = own[s].contains(lo[at].view(np.uint64))
                    line, hi, lo = line[may], hi[may], lo[may]
                bounds = np.searchsorted(line, offsets).astype(np.int32)
                ragged = lambda v, bounds=bounds: pa.ListArray.from_arrays(pa.array(bounds), pa.array(v))
                place = (line - np.repeat(offsets[:-1], np.diff(bounds))).astype(np.int32)
                columns = [c.slice(begin, len(part)) for c in b.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets)), ragged(place), ragged(hi), ragged(lo)], [*b.schema.names, "n_lines", "place", "hi", "lo"])
                begin += len(part)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of ``drop``."""
    for b in batches:
        kept = []
        for text, drop in zip(b.column("text").to_pylist(), b.column("drop").to_pylist(), strict=True):
            if drop:
                gone = set(drop)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            kept.append(text)
        yield b.set_column(b.schema.names.index("text"), "text", pa.array(kept, pa.string()))


def without_repeated_lines(index: LineIndex, docs: DataFrame, shape: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The documents with n_lines, n_dropped and kept_text: the lines that stay, or what ``shape`` makes of this column.

    ``columns`` names the own columns to carry, all without it.
    """
    filters = None
    if (index.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= FILTER_BYTES:
        filters = {r["shard"]: bytes(r["filter"]) for r in index.filters.toLocalIterator()}
    shape = F.col("kept_text") if shape is None else shape
    own = [c for c in columns or docs.columns if c.lower() not in ADDED]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    extra = [T.StructField("n_lines", T.LongType()), T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("hi", T.ArrayType(T.LongType())), T.StructField("lo", T.ArrayType(T.LongType()))]
    scanned = rows.mapInArrow(_known(filters, index.shards), T.StructType([*rows.schema.fields, *extra]))
    known = F.size("place") > 0
    # Written once: of a document whose lines no filter knows, only what is wanted of it.
    scanned = stored(
        scanned.withColumn("known", known)
        .withColumn("kept_text", F.when(~F.col("known"), F.col("text")))
        .select("_row", "doc_id", "n_lines", "known", F.when(F.col("known"), F.col("text")).alias("text"), F.when(~F.col("known"), shape).alias("shaped"), F.arrays_zip("place", "hi", "lo").alias("lines"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "line-scan",
    )
    lines = scanned.filter("known").select("rid", "doc_id", F.inline("lines"))
    held = index.counts.filter(F.col("n_docs") >= index.least)
    every = held.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.broadcast(held.filter(F.col("n_docs") > every // SMALL).select("hi", "lo", "last_doc"))
    rare = held.filter(F.col("n_docs") <= every // SMALL).select("hi", "lo", "last_doc")
    met = lines.join(hot, ["hi", "lo"]).unionByName(lines.join(hot, ["hi", "lo"], "left_anti").join(rare, ["hi", "lo"]))
    drops = met.filter(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).groupBy("rid").agg(F.collect_list("place").alias("drop"))

    some = scanned.filter("known").join(drops, "rid", "left").select("_row", "n_lines", F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"), "text", "drop")
    cut = some.mapInArrow(_cut, some.schema).withColumn("kept_text", F.col("text")).select("_row", "n_lines", "n_dropped", shape.alias("kept_text"))
    rest = scanned.filter("NOT known").select("_row", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("shaped").alias("kept_text"))
    return rest.unionByName(cut).select("_row.*", *ADDED)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of a corpus that is its own index."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = insert(empty_index(docs.sparkSession), narrow)
    out = without_repeated_lines(index, narrow, sha256_utf8(F.col("kept_text")), ["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.col("kept_text").alias("kept_sha256"))


DEDUP_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
flat AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM split),
keyed AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM flat),
often AS (SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, i, line, coalesce(doc_id <> last_doc, false) AS dropped FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
