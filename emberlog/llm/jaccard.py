"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles. Equal texts form one class, and classes are
joined. Let o(n) = ceil(3n / 4): two linked sets of at most n shingles share at least o(n). In any
order of all shingles (here: of their hashes), the first n - o(n) + k shingles of each of two linked
sets then share at least k.

1. A scan writes for every class the longest prefix that it may need (``_longest``). Postings are counted
   per shingle, combined before they move, and the counts are joined back (``skew``). A shingle that more than ``FREQUENT`` classes hold is frequent: it costs too
   many candidates and is not indexed. A task that meets such a shingle often enough says so once and
   sends no postings of it, so no list in the shuffle grows with a common passage.
2. Every class lengthens its prefix by its cost: with c frequent shingles in it, k is c + 1, so that of
   any k shared shingles one is infrequent and is in both classes' lists. A class that would lengthen
   it by more than 1 / ``LONGER`` of its set is long.
3. Lists, of at most ``FREQUENT`` classes, give pairs with the number of shared postings. For two sets of
   a and b shingles, linked ones share at least ceil(3 (a + b) / 7), of which at most a - p lie behind
   a's prefix of p; with frequent ones taken off, this many shared postings are required before
   verification.
4. Long classes meet each other over whole sets, in order of frequency among them: the n - o(n) + 1
   rarest shingles are indexed. Pairs inside a component change nothing, so each list is joined by hubs
   from outside its largest component until no two components of a list are left: two turns with the
   class of fewest lonely shingles, then turns of up to ``HUBS`` hubs. There a pair is written once, by
   its first shared shingle, and only if it shares enough of the index, so groups of copies never
   expand into all pairs.
5. Verification intersects whole sets, gathered for the classes with candidates only: first a star per
   class, then the candidates that are still in different components.

Only shuffle keys are hashes of texts: a class is identified by the 64-bit hash of its text and its
number of shingles, in graphs as one number that holds both (``_node``). Null texts and texts without words have an empty set and no link. Repeated rows
and equal ids are documents of their own, with the smallest id of the component. A null id stays
null as its own component unless it is linked. Other columns do not pass through.

Tables between the steps stay in the shared checkpoint folder, as the result reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.graph import SMALL, connected_components
from emberlog.llm.pieces import runs
from emberlog.llm.skew import by_weight
from emberlog.llm.words import let, unused
from emberlog.session import checkpointed, discard, stored

SHINGLE = 5
FREQUENT = 16
LONGER = 20
HUBS = 1024
HEAD = 32  # index shingles of a long class that its postings carry in the later turns
#: Bits of the array that tells a scan which texts may be candidates: 16 a class, at most so many. Beyond, more texts pass and the join decides.
MOST_BITS = 1 << 27
#: Rows that are broadcast at most when documents are dropped; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
NODE = "decimal(38,0)"
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def needed(n: Column) -> Column:
    """o(n): what two linked sets share at least, if the larger one has n."""
    return F.ceil(n * 3 / 4)


def most_matches(n: Column) -> Column:
    """The largest k of a class that is not long."""
    return F.greatest(F.floor(n / LONGER), F.lit(1))


def _longest(n: int) -> int:
    """Length of the prefix that suffices for the largest k of any partner, of up to 4n / 3 shingles."""
    return n - -(-3 * n // 4) + max(4 * n // 3 // LONGER, 1)


def longest(n: Column) -> Column:
    return n - needed(n) + F.greatest(F.floor(F.floor(n * 4 / 3) / LONGER), F.lit(1))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, of 63 bits; a text of fewer than k words is one shingle."""
    flat = pc.ascii_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\x09-\x0D ]+", " "))
    lists = pc.split_pattern(pc.utf8_trim(flat, " "), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    empty = names.index("") if "" in names else -1
    codes = coded.indices.to_numpy()
    h = own[codes] if len(names) else np.zeros(0, np.uint64)
    rows = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            rows = _finish(rows * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(rows)] + np.uint64(i))
        rows = (rows >> np.uint64(1)).view(np.int64)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(rows[a : b - k + 1])
            elif b == a or b - a == 1 and codes[a] == empty:
                yield np.zeros(0, np.int64)
            else:
                x = np.uint64(b - a)
                for w in h[a:b]:
                    x = _finish(x * np.uint64(0x9E3779B97F4A7C15) + w)
                yield np.array([x >> np.uint64(1)], np.uint64).view(np.int64)


def _ids(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def _new_keys(keys: list[int], seen: set[int]) -> np.ndarray:
    """Which keys a task meets for the first time."""
    return np.array([k not in seen and not seen.add(k) for k in keys], dtype=bool)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, n of every text. The first one of a class in the task has its prefix, with -1 - token for what is frequent in the run of texts; ``told`` has each such token once."""
    seen: set[int] = set()
    for b in batches:
        new = _new_keys(b.column("key").to_pylist(), seen)
        begin = 0
        for part in runs(b.column("text")):
            sets = list(shingle_sets(part))
            heads = [s[: _longest(len(s))] if own else s[:0] for s, own in zip(sets, new[begin : begin + len(part)].tolist(), strict=True)]
            lists = _lists(heads)
            flat = lists.values.to_numpy()
            names, first, place, count = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            often = count > FREQUENT
            tokens = np.where(often[place], -1 - flat, flat)
            order = np.argsort(first[often])
            told_at = np.searchsorted(first[often][order], lists.offsets.to_numpy(), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").slice(begin, len(part)),
                    b.column("key").slice(begin, len(part)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(lists.offsets, pa.array(tokens)),
                    pa.ListArray.from_arrays(pa.array(told_at), pa.array(names[often][order])),
                ],
                ["doc_id", "key", "n", "tokens", "told"],
            )
            begin += len(part)


def _set_rows(bits: np.ndarray):
    """Rows key, n, tokens (the whole set) of each text that is new to the task and may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys = b.column("key").to_numpy()
            slot = keys.view(np.uint64) & np.uint64(8 * len(bits) - 1)
            keep = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            keep[keep] = _new_keys(keys[keep].tolist(), seen)
            b = b.filter(pa.array(keep))
            begin = 0
            for part in runs(b.column("text")):
                sets = list(shingle_sets(part))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(begin, len(part)), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["key", "n", "tokens"])
                begin += len(part)

    return run


def _active(rows: DataFrame) -> DataFrame:
    """Postings that may meet others: token, rid, pos (in the set), frequent."""
    own = rows.select(F.posexplode("tokens").alias("pos", "token"), "rid").filter("token >= 0").select("token", "rid", "pos")
    told = rows.select(F.explode("told").alias("token"), F.lit(True).alias("told"))
    counted = own.select("token", F.lit(False).alias("told")).unionByName(told).groupBy("token").agg(F.count("*").alias("df"), F.bool_or("told").alias("told"))
    shared = stored(counted.filter("df > 1 OR told").select("token", "df", (F.col("told") | (F.col("df") > FREQUENT)).alias("frequent")), "shared")
    active = stored(by_weight(own, shared, ["token"], "df").select("token", "rid", "pos", "frequent"), "active")
    discard(shared)
    return active


def _classes(rows: DataFrame, active: DataFrame) -> DataFrame:
    """rid, key, n, p (length of the prefix), c (frequent shingles in it), long; rid is one row of the class."""
    own = F.filter(F.transform("tokens", lambda t, i: F.when(t < 0, i)), lambda i: i.isNotNull())
    first = rows.filter(F.size("tokens") > 0).select("key", "n", F.struct("rid", own.alias("often")).alias("row"))
    one = first.groupBy("key", "n").agg(F.min_by("row", "row.rid").alias("row")).select("key", "n", "row.*")
    met = active.filter("frequent").groupBy("rid").agg(F.collect_list("pos").alias("met"))  # within one prefix
    places = F.array_sort(F.concat("often", F.coalesce("met", F.array().cast("array<int>"))))
    spare = F.col("n") - needed(F.col("n"))
    # A frequent shingle is in the prefix if at most n - o(n) infrequent ones come before it.
    known = one.join(met, "rid", "left").withColumn("places", places).withColumn("c", F.size(F.filter("places", lambda x, i: x - i <= spare)))
    long = F.col("c") + 1 > most_matches(F.col("n"))
    return known.select("rid", "key", "n", F.when(long, longest(F.col("n"))).otherwise(spare + F.col("c") + 1).cast("long").alias("p"), F.when(long, F.size("places")).otherwise(F.col("c")).alias("c"), long.alias("long"))


def _sized(a: Column, b: Column) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def _ordered(ka: str, na: str, kb: str, nb: str) -> Column:
    return (F.col(ka) < F.col(kb)) | ((F.col(ka) == F.col(kb)) & (F.col(na) < F.col(nb)))


def _candidates(active: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ka, na, kb, nb, not both long, that share enough postings."""
    index = active.filter("NOT frequent").join(classes, "rid").filter("pos < p")
    side = lambda s: index.select("token", *[F.col(c).alias(f"{c[0]}{s}") for c in ("key", "n", "p", "c", "long")])
    met = side("a").join(side("b"), "token").filter(_ordered("ka", "na", "kb", "nb") & _sized(F.col("na"), F.col("nb")) & ~(F.col("la") & F.col("lb")))
    names = ["ka", "na", "kb", "nb"]
    counted = met.groupBy(*names).agg(F.count("*").alias("shared"), *[F.first(x).alias(x) for x in ("pa", "pb", "ca", "cb")])
    least = F.ceil((F.col("na") + F.col("nb")) * 3 / 7)
    known = F.least(least - F.col("na") + F.col("pa"), least - F.col("nb") + F.col("pb")) - F.least("ca", "cb")
    return counted.filter(F.col("shared") >= known).select(*names)


def _bits(keys: DataFrame, n: int) -> np.ndarray:
    """A bit array with the bits of ``n`` keys set."""
    size = min(max(1 << 16, 1 << (16 * n).bit_length()), MOST_BITS)
    slots = keys.select(F.col("key").bitwiseAND(F.lit(size - 1)).alias("slot"))
    words = slots.groupBy(F.expr("cast(slot div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n, tokens of the classes in ``wanted`` (key, n)."""
    wanted = checkpointed(wanted.distinct())
    rows = _ids(docs).filter(F.col("text").isNotNull()).select("key", "text").mapInArrow(_set_rows(_bits(wanted, wanted.count())), "key long, n long, tokens array<long>")
    return stored(rows.join(wanted, ["key", "n"], "left_semi").dropDuplicates(["key", "n"]), "sets")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are linked; ``pairs`` is read several times, so it is written before.

    Few pairs are broadcast, so that only sets that have a pair move, and move once.
    """
    few = pairs.count() <= BROADCAST_ROWS
    sent = F.broadcast if few else lambda df: df
    left = sets.select(F.col("key").alias("ka"), F.col("n").alias("na"), F.col("tokens").alias("ta")).join(sent(pairs), ["ka", "na"])
    right = sets.select(F.col("key").alias("kb"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    if few:
        right = right.join(F.broadcast(pairs.select("kb", "nb").distinct()), ["kb", "nb"], "left_semi")
    shared = F.size(F.array_intersect("ta", "tb"))
    both = left.join(right, ["kb", "nb"]).filter(100 * shared >= 75 * (F.col("na") + F.col("nb") - shared))
    return checkpointed(both.select("ka", "na", "kb", "nb"))


def _node(key: str, n: str) -> Column:
    """A class as one number, which no other class has: the hash of its text, then 32 bits for its number of shingles."""
    return (F.col(key).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(n).cast("decimal(10,0)")).cast(NODE)


def _nodes(links: DataFrame) -> DataFrame:
    return links.select(_node("ka", "na").alias("u"), _node("kb", "nb").alias("v"))


def _grown(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links; only labels of components meet, not the links found before."""
    few = links.count() <= SMALL
    ends = _nodes(links).coalesce(1) if few else _nodes(links)
    if parts is None:
        return checkpointed(connected_components(ends))
    if links.isEmpty():
        return parts
    if few and parts.count() <= SMALL:
        parts = parts.coalesce(1)
    new = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(parts, "node", "left_anti")
    every = checkpointed(parts.unionByName(new.withColumn("component", F.col("node"))))
    label = lambda c: every.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
    met = ends.join(label("u"), "u").join(label("v"), "v").filter("u_ <> v_").select(F.col("u_").alias("u"), F.col("v_").alias("v"))
    merged = connected_components(met).select(F.col("node").alias("component"), F.col("component").alias("into"))
    if few:  # at most two labels a link
        joined = every.join(F.broadcast(merged), "component", "left")
    else:
        joined = by_weight(every, checkpointed(merged.join(every.groupBy("component").agg(F.count("*").alias("rows")), "component")), ["component"], "rows", "left")
    return checkpointed(joined.select("node", F.coalesce("into", "component").alias("component")))


def _labelled(df: DataFrame, parts: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """Adds the component of (key, n) as ``name``."""
    own = parts.select(F.col("node").alias("_node"), F.col("component").alias("_part"))
    return df.withColumn("_node", _node(key, n)).join(own, "_node", "left").withColumn(name, F.coalesce("_part", "_node")).drop("_node", "_part")


def _stars(pairs: DataFrame) -> DataFrame:
    """Of each class the pair (class, partner) with its partner of the smallest hash."""
    back = pairs.select(F.col("kb").alias("ka"), F.col("nb").alias("na"), F.col("ka").alias("kb"), F.col("na").alias("nb"))
    picked = pairs.unionByName(back).groupBy("ka", "na").agg(F.min_by(F.struct("kb", "nb"), F.xxhash64("kb", "nb")).alias("o"))
    return picked.select("ka", "na", "o.kb", "o.nb")


def _long_index(sets: DataFrame) -> DataFrame:
    """token, key, n, rank, index, alone: the rarest shingles of each set that other sets hold, rarest first n - o(n) + 1.

    ``index`` is their number in the set, ``alone`` the share in a thousand of shingles in no other set.
    """
    each = sets.select("key", "n", F.explode("tokens").alias("token"))
    shared = checkpointed(each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    own = Window.partitionBy("key", "n")
    ranked = by_weight(each, shared, ["token"], "df").withColumn("met", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "token")))
    # Those in no other set are rarest of all.
    index = F.col("met") - needed(F.col("n")) + 1
    alone = F.floor((F.col("n") - F.col("met")) * 1000 / F.col("n"))
    return ranked.filter(F.col("rank") <= index).select("token", "key", "n", "rank", index.alias("index"), alone.alias("alone"))


def _long_links(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` after the links among long classes."""
    index = stored(_long_index(sets), "index")
    heads = index.filter(F.col("rank") <= HEAD).groupBy("key", "n").agg(F.first("index").alias("index"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("head"))
    postings = stored(index.select("token", "key", "n", "alone", F.lit(False).alias("was")), "postings")
    turn = 0
    while not postings.isEmpty():
        mark = F.pmod(F.xxhash64("key", "n", F.lit(turn)), F.lit(1 << 30))
        mark = mark + F.col("alone") * (1 << 30) if turn < 2 else mark
        placed = _labelled(postings, parts, "key", "n", "component").withColumn("mark", mark)
        free = F.when(~F.col("was"), F.col("mark"))
        sizes = placed.groupBy("token", "component").agg(F.count("*").alias("size"), F.count(free).alias("free"), F.min(free).alias("first"))
        largest = F.struct("size", "component")
        per_list = sizes.groupBy("token").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.max_by("component", largest).alias("main"), (F.sum("free") - F.max_by("free", largest)).alias("waiting"), F.min("first").alias("first"))
        mixed = checkpointed(per_list.filter("parts > 1 AND waiting > 0").select("token", "size", "main", "waiting", "first"))
        hub = F.col("mark") == F.col("first") if turn < 2 else (F.col("component") != F.col("main")) & (F.col("mark") * F.col("waiting") <= HUBS << 30)
        open_ = stored(by_weight(placed, mixed, ["token"], "size").withColumn("hub", ~F.col("was") & hub).select("token", "key", "n", "alone", "component", "was", "hub"), "turn")
        found = checkpointed(_hub_pairs(open_, heads if turn >= 2 else None))
        parts = _grown(parts, _linked(found, sets))
        discard(postings)
        postings = stored(open_.select("token", "key", "n", "alone", (F.col("was") | F.col("hub")).alias("was")), "postings")
        discard(open_)
        turn += 1
    for table in (postings, index):
        discard(table)
    return parts


def _hub_pairs(postings: DataFrame, heads: DataFrame | None) -> DataFrame:
    """Pairs (member, hub) of one list and two components that may be linked."""
    carried = ["key", "n", "component"]
    if heads is not None:
        postings = postings.join(heads, ["key", "n"])
        carried += ["index", "head"]
    hubs = postings.filter("hub").select("token", *[F.col(c).alias(f"hub_{c}") for c in carried])
    a, b = F.col("n"), F.col("hub_n")
    may = (F.col("component") != F.col("hub_component")) & _sized(a, b)
    if heads is not None:
        # Behind the shorter prefix, of n - o(n) + 1, at most o(n) - 1 can be shared.
        need = F.ceil((a + b) * 3 / 7) - F.greatest(needed(a), needed(b)) + 1
        whole = (F.col("index") <= HEAD) & (F.col("hub_index") <= HEAD)
        first = lambda both: F.coalesce(F.get(both, F.lit(0)) == F.col("token"), F.lit(True)) & (~whole | (F.size(both) >= need))
        may = may & (need <= F.least("index", "hub_index")) & let(F.array_intersect("hub_head", "head"), first)
    return postings.join(hubs, "token").filter(may).select(F.col("key").alias("ka"), F.col("n").alias("na"), F.col("hub_key").alias("kb"), F.col("hub_n").alias("nb")).distinct()


def prefixes(docs: DataFrame) -> DataFrame:
    """The first scan: doc_id, key, n, tokens, told (see ``_prefix_rows``), rid."""
    rows = _ids(docs).mapInArrow(_prefix_rows, "doc_id long, key long, n long, tokens array<long>, told array<long>")
    return stored(rows.withColumn("rid", F.monotonically_increasing_id()), "prefixes")


def components(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node (a class, see ``_node``) and component, for classes with a link."""
    active = _active(rows)
    classes = stored(_classes(rows, active), "classes")
    pairs = stored(_candidates(active, classes), "pairs")
    discard(active)
    long = classes.filter("long").select("key", "n")
    ends = pairs.select(F.col("ka").alias("key"), F.col("na").alias("n")).unionByName(pairs.select(F.col("kb").alias("key"), F.col("nb").alias("n")))
    sets = _sets(docs, ends.unionByName(long))
    parts = _grown(None, _linked(checkpointed(_stars(pairs)), sets))
    chosen = stored(sets.join(long, ["key", "n"], "left_semi"), "long")
    parts = _long_links(chosen, parts)
    discard(chosen)
    # A star's own pair that failed is tried again here: it costs less than telling them apart.
    rest = _labelled(_labelled(pairs, parts, "ka", "na", "u"), parts, "kb", "nb", "v").filter("u <> v").select("ka", "na", "kb", "nb")
    parts = _grown(parts, _linked(checkpointed(rest), sets))
    for table in (pairs, classes, sets):
        discard(table)
    return parts


def _membership(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, component (its name; null without words), component_id of every row."""
    rows = prefixes(docs)
    counted = stored(rows.select("doc_id", "key", "n"), "counted")
    parts = components(docs, rows)
    discard(rows)
    full = counted.filter("n > 0")
    classes = full.groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    named = stored(_labelled(classes, parts, "key", "n", "component"), "named")
    lowest = checkpointed(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes")))
    resolved = stored(by_weight(named, lowest, ["component"], "classes").select("key", "n", "rows", "component", "component_id"), "resolved")
    joined = by_weight(full, resolved, ["key", "n"], "rows").select("doc_id", "key", "n", "component", "component_id")
    return joined.unionByName(counted.filter("n = 0").select("doc_id", "key", "n", F.lit(None).cast(NODE).alias("component"), F.col("doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    return _membership(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns: of the smallest id (null ids last), of several of that id the one whose text has the smallest hash, of equal rows any one.

    Every row is judged by itself, so unlike texts of one id each have their own component. Documents
    without words are linked with nothing and stay, repeated rows among them too.
    """
    members = stored(_membership(docs).filter("component IS NOT NULL").groupBy("component", "doc_id", "key").agg(F.count("*").alias("rows")), "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = checkpointed(members.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("members")))
    judged = by_weight(members, best, ["component"], "members").select("doc_id", "key", "rows", F.col("best").eqNullSafe(order).alias("kept"))
    judged = stored(judged.filter("NOT kept OR rows > 1"), "judged")
    own = unused("_key", docs.columns)
    keyed = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))

    def joined(rows: DataFrame, to: DataFrame, how: str) -> DataFrame:
        to = to.select(F.col("doc_id").alias("_id"), F.col("key").alias("_mark"))
        if to.count() <= BROADCAST_ROWS:
            to = F.broadcast(to)
        return rows.join(to, rows["doc_id"].cast("long").eqNullSafe(to["_id"]) & (rows[own] == to["_mark"]), how)

    out = joined(keyed, judged.filter("NOT kept"), "left_anti")
    repeated = judged.filter("kept")
    if not repeated.isEmpty():
        out = joined(out, repeated, "left_anti").unionByName(joined(out, repeated, "left_semi").dropDuplicates(["doc_id", own]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


COMPONENTS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, e.v FROM reach JOIN e ON reach.r = e.u),
lowest AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN sizes USING (doc_id) JOIN lowest USING (doc_id)"""
