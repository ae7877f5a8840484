"""Removal of repeated passages by recompression.

A text is a sequence of word names (hashes). In each round maximal runs of one name, then pairs of a
left and a right name, get new names; sides and new names are hashes, so equal sequences get equal
names everywhere without a table. Every symbol knows its support: the words that decided that it
exists. A symbol whose support lies inside a window occurs in every copy of this window.

Each window of ``WINDOW`` words is filed under one symbol inside it: the highest level first, then the
smallest name. Three steps follow.

1. Symbols are counted. A window can only repeat if its symbol occurs twice.
2. Windows filed under such symbols are compared by the hash of all their words, 128 bits with the
   symbol; all but the first, by (doc_id, start), are repeats. A run of texts compares its own windows
   first: all but the first of each are repeats for sure and are dealt by their document, and only the
   first goes to the shuffle by symbol. So a passage that stands in many documents meets there once a
   run of ``RUN_BYTES``. Windows of symbols that most runs hold are dealt by their hash besides.
3. Words covered by repeats are removed.

A bit array of 16 bits a counted symbol carries them to the second scan, of ``MOST_BITS`` at most;
when they outnumber its bits it passes more windows, and the comparison decides as before.

Rows of one id count as one document, in which equal windows of equal start are the same. Null texts
have no words; null ids come first. Empty tables give empty results. Other columns do not pass
through ``dedup``; ``without_repeats`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.pieces import runs
from emberlog.llm.words import let, sha256_utf8, words
from emberlog.session import discard, stored

WINDOW = 20
ROUNDS = 3
MOST_BITS = 1 << 28
HOT_RUNS = 16  # runs that hold a symbol before its windows are dealt by hash
HOT_SYMBOLS = 1 << 16
PARTS = 64
RUN_BYTES = 3 << 20  # texts worked on together
STRETCH = 1 << 16  # bytes whose words are named together; only these have arrays of eight bytes a byte
LONG = 256  # bytes of a word, at most STRETCH; polynomials modulo 2^64 are equal for some unlike words of 1,024 bytes
_U = np.uint64
_LEVEL = _U(62)


def _mix(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit name of an ordered pair."""
    with np.errstate(over="ignore"):
        z = x * _U(0x9E3779B97F4A7C15) + y
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]  # odd, so they have inverses
_AHEAD, _BACK = ([np.concatenate([np.ones(1, _U), np.cumprod(np.full(STRETCH - 1, x, _U))]) for x in bases] for bases in (_BASES, [pow(x, -1, 1 << 64) for x in _BASES]))
_BYTES = [_mix(np.arange(256, dtype=_U), _U(k)) for k in (1, 2)]


def _halves(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Values of both polynomials of the words at first..last, over a stretch of whole words at a time; of words over LONG bytes, their digest."""
    halves, i = [np.empty(len(first), _U) for _ in _BASES], 0
    while i < len(first):
        begin = int(first[i])
        j = int(np.searchsorted(last, begin + STRETCH))
        if j > i:  # else a word longer than a stretch
            part = data[begin : int(last[j - 1]) + 1]
            for k, half in enumerate(halves):
                sums = np.cumsum(_BYTES[k][part] * _AHEAD[k][: len(part)])
                half[i:j] = sums[last[i:j] - begin]
                half[i + 1 : j] -= sums[first[i + 1 : j] - begin - 1]
                half[i:j] *= _BACK[k][first[i:j] - begin]
        i = max(j, i + 1)
    for i in np.flatnonzero(last - first >= LONG):
        halves[0][i], halves[1][i] = np.frombuffer(hashlib.blake2b(data[first[i] : last[i] + 1], digest_size=16).digest(), "<u8")
    return halves


def word_names(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of the texts, one text after another, and where each text begins (one more at the end).

    A word's bytes are digits of two polynomials; sums over the bytes of many words give those of a word as a difference. Long words are digested.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    size, offsets = int(at[-1] - at[0]), at - at[0]
    if not size:
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(at[0]))
    space = data - np.uint8(9) <= 4
    space |= data == 32
    edge = np.zeros(size + 1, bool)
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    edge[offsets] = True
    word = np.logical_not(space, out=space)
    first, last = np.flatnonzero(word & edge[:-1]), np.flatnonzero(word & edge[1:])
    halves = _halves(data, first, last)
    names = _mix(_mix(halves[0], (last - first).astype(_U)), halves[1])
    return names, np.searchsorted(first, offsets)


def _window_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the 20 names from each place on, as 16 and 4; the last 19 places have none."""
    h2 = _mix(h[:-1], h[1:])
    h4 = _mix(h2[:-2], h2[2:])
    h8 = _mix(h4[:-4], h4[4:])
    h16 = _mix(h8[:-8], h8[8:])
    return _mix(h16[:-4], h4[16 : 16 + len(h16) - 4])


def _symbols(h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per round: level, and name, first and end of the support of every pair made."""
    n = len(h)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begin, end = bounds[:-1][doc], bounds[1:][doc]
    name, lo, hi = h, np.arange(n), np.arange(1, n + 1)

    def widened(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Support with the neighbours of symbols first..last; beyond a text's ends there is none that a window could hold."""
        p, q = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
        left = np.where((first > 0) & (doc[p] == doc[first]), lo[p], begin[first] - 1)
        right = np.where((last < len(name) - 1) & (doc[q] == doc[last]), hi[q], end[last] + 1)
        return left, right

    for level in range(1, ROUNDS + 1):
        if len(name) < 2:
            return
        first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.concatenate([first[1:], [len(name)]]) - 1
        k = (last - first + 1).astype(_U)
        left, right = widened(first, last)
        name, doc, begin, end, lo, hi = np.where(k > 1, _mix(name[first], k), name[first]), doc[first], begin[first], end[first], left, right
        side = (_mix(name, _U(level)) & _U(1)).astype(bool)
        pair = np.concatenate([~side[:-1] & side[1:] & (doc[:-1] == doc[1:]), [False]])
        second = np.concatenate([[False], pair[:-1]])
        keep = np.flatnonzero(~second)
        paired = pair[keep]
        after = keep + paired
        left, right = widened(keep, keep)
        left, right = np.where(paired, lo[keep], left), np.where(paired, hi[after], right)
        new = np.where(paired, _mix(name[keep], _mix(name[after], _U(level))), name[keep])
        name, doc, begin, end, lo, hi = new, doc[keep], begin[keep], end[keep], left, right
        yield level, name[paired], lo[paired], hi[paired]


def filed(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a batch: start (place in h), symbol, hash."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    hashes = _window_hashes(h)
    top = _U(0xFFFFFFFFFFFFFFFF)
    tables = [np.full(n, top, _U) for _ in range(5)]  # tables[k][i]: over windows i to i + 2^k - 1
    for level, name, lo, hi in _symbols(h, bounds):
        a, b = np.maximum(hi - WINDOW, 0), np.minimum(lo, n - 1)
        fits = a <= b
        a, b, key = a[fits], b[fits], (_U(ROUNDS - level) << _LEVEL) | (name[fits] >> _U(2))
        size = b - a + 1
        power = np.frexp(size)[1] - 1
        for k, table in enumerate(tables):
            own = power == k
            np.minimum.at(table, a[own], key[own])
            np.minimum.at(table, b[own] - (1 << k) + 1, key[own])
    for k in range(4, 0, -1):
        half = 1 << (k - 1)
        np.minimum(tables[k - 1], tables[k], out=tables[k - 1])
        np.minimum(tables[k - 1][half:], tables[k][:-half], out=tables[k - 1][half:])
    key = np.where(tables[0] == top, (_U(ROUNDS) << _LEVEL) | (hashes >> _U(2)), tables[0])
    left = np.repeat(bounds[1:], np.diff(bounds))[:n] - np.arange(n)
    whole = np.flatnonzero(left >= WINDOW)
    return whole, key[whole], hashes[whole]


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    return (key ^ (key >> _U(31))) & _U(size - 1)


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(some, values), len(some) - 1)
    return some[at] == values


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and symbol: 1, or 2 if two texts or two places of a text hold it."""
    for b in batches:
        for part in runs(b.column("text"), RUN_BYTES):
            h, bounds = word_names(part)
            start, key, value = filed(h, bounds)
            if not len(key):
                continue
            doc = np.searchsorted(bounds, start, "right")
            order = np.argsort(key)
            one, own = key[order], doc[order]
            at = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
            often = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
            # Windows that a text holds twice.
            pair = _mix(key, value)
            twice = np.sort(pair)
            twice = np.unique(twice[1:][twice[1:] == twice[:-1]])
            often[np.searchsorted(one[at], key[_among(pair, twice)])] = True
            key, n = one[at], 1 + often
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int32())], ["symbol", "n"])


def _ragged(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(values)]]), pa.int32()), pa.array(values))


def _ranks(ids: pa.Array) -> np.ndarray:
    """Places of ids in order, nulls first; equal ids have equal places."""
    filled = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    order = np.lexsort((filled, ids.is_valid().to_numpy(zero_copy_only=False)))
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    new = np.concatenate([[False], (filled[order][1:] != filled[order][:-1]) | (valid[order][1:] != valid[order][:-1])])
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def _tied(rank: np.ndarray, doc: np.ndarray) -> bool:
    """Whether texts have equal ids."""
    return bool(((rank[1:] == rank[:-1]) & (doc[1:] != doc[:-1])).any())


def _file(bits: np.ndarray, hot: np.ndarray):
    def grouped(b: pa.RecordBatch, begin: int, doc: np.ndarray, symbol: np.ndarray, start: np.ndarray, value: np.ndarray, late: bool) -> pa.RecordBatch:
        """A row per text, symbol and part, for each stretch of windows in the order of their starts."""
        part = np.where(_among(symbol, hot), (value >> _U(5)) % _U(PARTS), _U(0)).astype(np.int32)
        new = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(np.concatenate([[True], new])) if len(symbol) else np.zeros(0, np.int64)
        rows = pa.array(begin + doc[at])
        columns = [b.column("doc_id").take(rows), b.column("mark").take(rows), pa.array(symbol[at].view(np.int64)), pa.array(part[at]), _ragged(start.astype(np.int32), at), _ragged(value.view(np.int64), at), pa.array(np.full(len(at), late))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "symbol", "part", "starts", "hashes", "late"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text and symbol that may repeat: starts and hashes of its windows. ``late``: the run has an earlier equal one; these are dealt by document, not by text, of which there may be many copies."""
        for b in batches:
            begin = 0
            for part in runs(b.column("text"), RUN_BYTES):
                h, bounds = word_names(part)
                start, key, value = filed(h, bounds)
                slot = _slots(key, 8 * len(bits))
                may = (bits[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1 == 1
                start, key, value = start[may], key[may], value[may]
                doc = np.searchsorted(bounds, start, "right") - 1
                start -= bounds[doc]
                ids = b.column("doc_id").slice(begin, len(part))
                rank = _ranks(ids)[doc]
                if len(key):
                    # Equal windows side by side, the first by (id, start) in front: as they are if ids ascend, else by sorting.
                    pair = _mix(key, value)
                    order = np.argsort(pair, kind="stable") if (rank[1:] >= rank[:-1]).all() and not _tied(rank, doc) else np.lexsort((start, rank, pair))
                    k, v = key[order], value[order]
                    new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
                    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                    late = np.empty(len(key), bool)
                    late[order] = (rank[order] != rank[lead]) | (start[order] != start[lead])
                    yield grouped(b, begin, doc[~late], key[~late], start[~late], value[~late], False)
                    mark = b.column("mark").slice(begin, len(part)).to_numpy().view(_U)
                    own = _mix(mark, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).view(_U))
                    yield grouped(b, begin, doc[late], own[doc[late]], start[late], np.zeros(int(late.sum()), _U), True)
                begin += len(part)

    return run


def _repeated_bits(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the symbols that occur twice or more, collected as at most MOST_BITS / 64 rows; and those that most runs hold, at most HOT_SYMBOLS."""
    often = stored(counts.groupBy("symbol").agg(F.sum("n").alias("n")).filter("n > 1").select("symbol", "n"), "symbols")
    n, total = often.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = min(max(1 << 16, 1 << (16 * n).bit_length()), MOST_BITS)
    slot = F.expr(f"(symbol ^ shiftrightunsigned(symbol, 31)) & {size - 1}")
    words_ = often.select(slot.alias("slot")).groupBy(F.expr("cast(slot div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words_.column("word").to_numpy()] = words_.column("bits").to_numpy()
    hot = often.filter(F.col("n") > max(HOT_RUNS, total // HOT_SYMBOLS)).select("symbol").toArrow().column("symbol").to_numpy()
    discard(often)
    return out.view(np.uint8), np.sort(hot).view(_U)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), starts: where the document's repeated windows begin, in order."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).filter(F.col("text").isNotNull())
    bits, hot = _repeated_bits(rows.select("text").mapInArrow(_count, "symbol long, n int"))
    windows = rows.mapInArrow(_file(bits, hot), "doc_id long, mark long, symbol long, part int, starts array<int>, hashes array<long>, late boolean")
    each = windows.repartition("symbol", "part").select("doc_id", "mark", "symbol", "part", "late", F.explode(F.arrays_zip("starts", "hashes")).alias("w"))
    flat = each.select("doc_id", "mark", "symbol", "part", "late", F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash"))
    place = F.rank().over(Window.partitionBy("symbol", "part", "late", "hash").orderBy("doc_id", "start"))
    late = flat.withColumn("place", place).filter("late OR place > 1")
    return late.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def _kept(w, starts):
    """Words that no window of ``starts`` covers: the pieces between the covered stretches."""
    opens = lambda s, i: (i == 0) | (s > F.get(starts, i - 1) + WINDOW)
    closes = lambda s, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) > s + WINDOW)
    begins = F.concat(F.filter(starts, opens), F.array(F.size(w)))
    ends = F.concat(F.array(F.lit(0)), F.transform(F.filter(starts, closes), lambda s: s + WINDOW))
    return F.when(F.size(starts) == 0, w).otherwise(F.flatten(F.zip_with(ends, begins, lambda e, b: F.slice(w, e + 1, b - e))))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with n_words, n_removed and kept_text (kept words joined by one space)."""
    kept = docs.drop("n_words", "n_removed", "kept_text")
    text = F.col("text").cast("string")
    others = [c for c in kept.columns if c.lower() != "text"]
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = repeats(rows).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "starts")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark")), "left")
    none = F.array().cast("array<int>")
    result = let(words(F.col("text")), lambda w: let(let(F.coalesce("starts", none), lambda s: _kept(w, s)), lambda k: F.struct(F.size(w).cast("long").alias("n_words"), (F.size(w) - F.size(k)).cast("long").alias("n_removed"), F.array_join(k, " ").alias("kept_text"))))
    own = [F.col("text").alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`") for c in kept.columns]
    return joined.withColumn("_r", result).select(*own, "_r.n_words", "_r.n_removed", "_r.kept_text")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    out = without_repeats(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", sha256_utf8(F.col("kept_text")).alias("kept_sha256"))


DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i+19], ' ')))) AS k FROM d WHERE len(w) >= 20),
late AS (SELECT doc_id, i FROM (SELECT *, rank() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
flat AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM flat ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
