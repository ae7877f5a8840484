"""Merkle manifest of a table, with proofs by coordinate lookup.

Rows are leaves of one tree per group; the roots of the groups are the leaves of one more tree. A node
has the coordinates (tree, level, idx); every ``FANOUT`` consecutive nodes of a level have one parent,
until one node remains. Nodes are made ``STEP`` levels a shuffle and written as a table.

A leaf's proof needs only its index and the size of its group: they say which siblings exist on the way
to the root. Leaves explode these coordinates, join the node table, and put what they find in order.
Nodes near a root are asked for by many leaves: whole levels, from the roots down, are broadcast as long
as they hold at most ``SMALL`` nodes together; a node of any level below is asked for by at most every
``SMALL / FANOUT``-th leaf or so, in a join that shuffles. Proofs of groups are found once a group.

Leaves are ordered by range, so a group that holds most rows lies in many tasks. A null group is a group
of its own and comes first, as do null ids. Rows of equal ids follow their digests; rows that are equal
throughout are leaves of their own. An empty table has no leaves and no root. Columns that are carried
may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import stored

FANOUT = 3
STEP = 3
SMALL = 1 << 17
LEVELS = 40  # powers of FANOUT that a long can hold


def _power(k: Column) -> Column:
    return F.get(F.array(*[F.lit(FANOUT**i).cast("long") for i in range(LEVELS)]), k)


def _height(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(FANOUT**i).cast("long") for i in range(LEVELS)]), lambda p: p < n))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs, exact also beyond what a double holds."""
    return F.call_function("div", a, b)


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Digest of a row's values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, hexed), "")


def _parents(digests: Column) -> Column:
    """Digests of the parents of consecutive siblings, the first of which is the first of its run."""
    run = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FANOUT).cast("int"))
    return F.transform(run, lambda i: F.unhex(F.sha2(_joined(F.slice(digests, i * FANOUT + 1, FANOUT)), 256)))


def _placed(digests: Column, level: int, first: Column) -> Column:
    """Consecutive nodes of a level with their coordinates."""
    return F.transform(digests, lambda d, i: F.struct(F.lit(level).alias("level"), (first + i).alias("idx"), d.alias("digest")))


def _numbered(rows: DataFrame, within: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in order and with ``part``, and per (within, part): n (rows of the group), first, before.

    A row's index is its mark - first + before. Written once, so marks hold when a task runs again. The
    draw lets equal rows lie in several ranges; their order among each other is all the same.
    """
    drawn = rows.withColumn("_draw", F.rand(0))
    laid = drawn.repartitionByRange(within, *order, "_draw").sortWithinPartitions(within, *order).drop("_draw")
    laid = stored(laid.withColumn("_mark", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("_mark", 33).cast("int"))
    ends = laid.groupBy(within, "part").agg(F.min("_mark").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy(within)  # a row per part
    upto = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = ends.select(within, "part", "first", F.sum("rows").over(group).alias("n"), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"))
    return laid, stored(spans, f"{name}-spans")


def _indexed(laid: DataFrame, spans: DataFrame, within: str) -> DataFrame:
    """Adds idx and what else ``spans`` has; a group that holds most rows meets it in as many keys as it has parts."""
    joined = laid.join(F.broadcast(spans) if spans.count() <= SMALL else spans, [within, "part"])
    return joined.withColumn("idx", F.col("_mark") - F.col("first") + F.col("before")).drop("_mark", "first", "before")


def _nodes(leaves: DataFrame, name: str) -> DataFrame:
    """tree, level, idx, digest of all nodes, leaves included; ``leaves``: tree, idx, height, digest."""
    tallest = leaves.agg(F.max("height")).first()[0] or 0
    made = [leaves.select("tree", F.lit(0).alias("level"), "idx", "digest")]
    base = leaves.select("tree", "idx", "height", "digest")
    for low in range(0, tallest, STEP):
        block = F.expr(f"idx div {FANOUT**STEP}")
        level = base.filter(F.col("height") > low).groupBy("tree", "height", block.alias("block"))
        rows = level.agg(F.array_sort(F.collect_list(F.struct("idx", "digest")))["digest"].alias("up0"))  # FANOUT ** STEP at most
        for k in range(1, STEP + 1):
            rows = rows.withColumn(f"up{k}", _parents(F.col(f"up{k - 1}")))
        found = [_placed(F.col(f"up{k}"), low + k, F.col("block") * FANOUT ** (STEP - k)) for k in range(1, STEP + 1)]
        step = stored(rows.select("tree", "height", F.inline(F.flatten(F.array(*found)))).filter("level <= height"), name)
        made.append(step.select("tree", "level", "idx", "digest"))
        base = step.filter(F.col("level") == low + STEP).drop("level")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def coordinates(idx: Column, n: Column, height: Column) -> Column:
    """Array of the siblings that the proof of leaf ``idx`` of ``n`` needs: level, idx, right (of the own node)."""

    def of(level: Column) -> Column:
        own, count = _div(idx, _power(level)), _div(n + _power(level) - 1, _power(level))
        first = own - F.pmod(own, F.lit(FANOUT))
        run = F.array(*[F.struct(level.alias("level"), (first + r).alias("idx"), (first + r > own).alias("right")) for r in range(FANOUT)])
        return F.filter(run, lambda c: (c["idx"] != own) & (c["idx"] < count))

    levels = F.filter(F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0))), lambda k: k < height)
    return F.flatten(F.transform(levels, of))


def proofs(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``siblings`` to leaves (tree, idx, n, height): level, idx, right, digest, in the order of (level, idx)."""
    sizes = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}  # a row per level
    low, held = max(sizes, default=-1) + 1, 0
    while low and held + sizes[low - 1] <= SMALL:
        held += sizes[low - 1]
        low -= 1
    dealt = leaves.repartition("tree", "idx")

    def found(wanted, table: DataFrame, name: str) -> DataFrame:
        asked = dealt.select("tree", F.col("idx").alias("leaf"), F.inline(F.filter(coordinates(F.col("idx"), F.col("n"), F.col("height")), wanted)))
        met = asked.join(table, ["tree", "level", "idx"])
        return met.groupBy("tree", F.col("leaf").alias("idx")).agg(F.collect_list(F.struct("level", "idx", "right", "digest")).alias(name))

    out = dealt.join(found(lambda c: c["level"] >= low, F.broadcast(nodes.filter(F.col("level") >= low)), "_high"), ["tree", "idx"], "left")
    parts = [F.col("_high")]
    if low:
        out = out.join(found(lambda c: c["level"] < low, nodes.filter(F.col("level") < low), "_low"), ["tree", "idx"], "left")
        parts.append(F.col("_low"))
    none = F.array().cast("array<struct<level:int,idx:bigint,right:boolean,digest:binary>>")
    return out.withColumn("siblings", F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts]))).drop("_high", "_low")


def folded(digest: Column, height: Column, siblings: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""

    def side(level: Column, right: bool) -> Column:
        return _joined(F.transform(F.filter(siblings, lambda s: (s["level"] == level) & (s["right"] == right)), lambda s: s["digest"]))

    up = lambda acc, level: F.unhex(F.sha2(F.concat(side(level, False), hexed(acc), side(level, True)), 256))
    levels = F.filter(F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0))), lambda k: k < height)
    return F.aggregate(levels, digest, up)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: _row, tree, part, idx, n, height, digest. ``nodes``, ``top_nodes``: tree, level, idx, digest.

    ``groups``, a row per (tree, part): subroot, top_idx, top_height, top_siblings, root.
    """

    leaves: DataFrame
    nodes: DataFrame
    top_nodes: DataFrame
    groups: DataFrame


def manifest(rows: DataFrame, group: Column, order: list[Column], digest: Column, carry: list[Column]) -> Manifest:
    """The trees of ``rows``: a tree per ``group`` (compared as text), its leaves by ``order``, then digest."""
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    key = F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit(""))
    narrow = rows.select(F.struct(*carry).alias("_row"), key.alias("_group"), *named, digest.alias("digest"))
    laid, spans = _numbered(narrow, "_group", [f"_o{i}" for i in range(len(order))] + ["digest"], "leaves")

    groups, top_spans = _numbered(spans.groupBy("_group").agg(F.max("n").alias("n_leaves")).withColumn("all", F.lit(0).cast("long")), "all", ["_group"], "groups")
    trees = stored(_indexed(groups, top_spans, "all").select("_group", F.col("idx").alias("tree"), "n_leaves", F.col("n").alias("n_trees")), "trees")
    leaves = stored(_indexed(laid, spans.join(trees, "_group"), "_group").withColumn("height", _height(F.col("n"))).select("_row", "tree", "part", "idx", "n", "height", "digest"), "leaves")
    nodes = _nodes(leaves, "nodes")

    tops = trees.select("tree", _height(F.col("n_leaves")).alias("level"), F.col("n_trees").alias("n"))
    tops = tops.join(nodes.filter("idx = 0"), ["tree", "level"]).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "n", _height(F.col("n")).alias("height"), "digest")
    tops = stored(tops, "tops")
    top_nodes = _nodes(tops, "top-nodes")
    root = top_nodes.groupBy().agg(F.max_by("digest", "level").alias("root"))  # the highest level is one node
    proven = proofs(tops, top_nodes).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), F.col("idx").alias("top_idx"), F.col("height").alias("top_height"), F.col("siblings").alias("top_siblings"))
    per_part = spans.join(trees, "_group").select("tree", "part").join(proven, "tree").crossJoin(F.broadcast(root))  # one row
    return Manifest(leaves, nodes, top_nodes, stored(per_part, "groups"))


def proven(m: Manifest) -> DataFrame:
    """Leaves with siblings, and with their group's subroot, top_siblings, top_height and root."""
    groups = m.groups.drop("top_idx")
    return proofs(m.leaves, m.nodes).join(F.broadcast(groups) if groups.count() <= SMALL >> 4 else groups, ["tree", "part"])


def verified(m: Manifest, other: Column) -> DataFrame:
    """Per leaf its proof's digest, and the root folded from ``other`` (a digest of ``_row``; null: the leaf itself)."""
    start = F.coalesce(other, F.col("digest"))
    rows = proven(m).withColumn("folded", folded(folded(start, F.col("height"), F.col("siblings")), F.col("top_height"), F.col("top_siblings")))
    way = F.transform(F.concat("siblings", "top_siblings"), lambda s: s["digest"])
    return rows.select(
        "_row",
        hexed(F.col("digest")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        F.sha2(_joined(way), 256).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def tamper_check(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for ``documents``, some of them tampered with.

    Where 2 divides the CRC of the id's digits, line breaks are deleted from the text. A null id is not tampered with.
    """
    named = ["doc_id", "source", "lang", "n_chars", "text"]
    values = [F.col(c) for c in named]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = F.when(chosen & F.contains("text", F.lit("\n")), leaf([*values[:-1], F.replace("text", F.lit("\n"), F.lit(""))]))
    m = manifest(docs.select(*named), F.col("source"), [F.col("doc_id")], leaf(values), [F.col("doc_id").cast("long").alias("doc_id"), other.alias("other")])
    return verified(m, F.col("_row.other")).select("_row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# The polynomial of CRC-32 is a fixed value; ``crcs`` takes one bit a step.
TAMPER_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    replace(text, chr(10), '') AS cut FROM documents),
keys AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER () AS trees FROM (SELECT DISTINCT source FROM documents)),
base AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY s) AS n, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS other
  FROM fields f JOIN keys k ON f.source IS NOT DISTINCT FROM k.source),
nodes(s, level, i, n, d) AS (
  SELECT s, 0, i, n, leaf FROM base
  UNION ALL
  SELECT s, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY s, level, i // 3, n),
tops AS (SELECT s, level AS height, d AS subroot FROM nodes WHERE n = 1),
upper(level, i, n, d) AS (
  SELECT 0, s, (SELECT count(*) FROM tops), subroot FROM tops
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 3, n),
own(doc_id, s, level, i, n) AS (
  SELECT doc_id, s, 0, i, n FROM base
  UNION ALL
  SELECT doc_id, s, level + 1, i // 3, (n + 2) // 3 FROM own WHERE n > 1),
climb(s, level, i, n) AS (
  SELECT s, 0, s, (SELECT count(*) FROM tops) FROM tops
  UNION ALL
  SELECT s, level + 1, i // 3, (n + 2) // 3 FROM climb WHERE n > 1),
low AS (
  SELECT o.doc_id, o.level, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (WHERE x.i < o.i), '') AS l, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (WHERE x.i > o.i), '') AS r
  FROM own o JOIN nodes x ON x.s = o.s AND x.level = o.level AND x.i // 3 = o.i // 3 WHERE o.n > 1 GROUP BY o.doc_id, o.level),
high AS (
  SELECT c.s, c.level, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (WHERE x.i < c.i), '') AS l, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (WHERE x.i > c.i), '') AS r
  FROM climb c JOIN upper x ON x.level = c.level AND x.i // 3 = c.i // 3 WHERE c.n > 1 GROUP BY c.s, c.level),
sides AS (
  SELECT doc_id, level, l, r FROM low
  UNION ALL
  SELECT b.doc_id, t.height + h.level, h.l, h.r FROM base b JOIN tops t ON t.s = b.s JOIN high h ON h.s = b.s),
crcs(doc_id, k, crc) AS (
  SELECT doc_id, 0, CAST(4294967295 AS BIGINT) FROM base
  UNION ALL
  SELECT doc_id, k + 1, xor(x >> 1, 3988292384 * (x & 1))
  FROM (SELECT doc_id, k, CASE WHEN k % 8 = 0 THEN xor(crc, CAST(ascii(substr(CAST(doc_id AS VARCHAR), k // 8 + 1, 1)) AS BIGINT)) ELSE crc END AS x FROM crcs WHERE k < 8 * strlen(CAST(doc_id AS VARCHAR)))),
fold(doc_id, level, acc) AS (
  SELECT doc_id, 0, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN other ELSE leaf END FROM base JOIN crcs USING (doc_id) WHERE k = 8 * strlen(CAST(doc_id AS VARCHAR))
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(l || acc || r) FROM fold f JOIN sides x ON x.doc_id = f.doc_id AND x.level = f.level),
way AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256 FROM sides GROUP BY doc_id),
last AS (SELECT doc_id, arg_max(acc, level) AS folded_root FROM fold GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM base JOIN tops USING (s) JOIN last USING (doc_id) LEFT JOIN way USING (doc_id) CROSS JOIN (SELECT d AS root FROM upper WHERE n = 1)"""
