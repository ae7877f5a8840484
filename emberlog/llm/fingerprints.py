"""Document fingerprints by I-Match.

The lexicon holds the terms (lower-cased words, as 64-bit hashes) whose document frequency lies in a
band: not so rare that a few documents share them (``LOW`` of the documents, 2 at least), not so
common that most do (``HIGH``). A fingerprint sorts the distinct lexicon terms of a text and hashes
them within several random subsets of the lexicon, each drawn by a hash of its own. Subsets come in
sizes from a quarter to 1/1024 of it, so that short and long texts both have some that a change
leaves alone.

Texts of m distinct terms on average give at most m / ``LOW`` lexicon terms, however many documents
there are. A scalar subquery hands them to every task, in an array of ``BUCKETS`` small lists by hash,
so membership is exact and takes one look. Native expressions only.

Null texts are empty. A text without lexicon terms has the hash of the whole text in each place, so it
equals its copies only. Equal texts have equal fingerprints. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.words import let, sha256_utf8, unused, words
from emberlog.session import stored

LOW = 1 / 500
HIGH = 0.5
BUCKETS = 1 << 16
# Each subset holds a term with probability 2^-r; several independent ones of each size.
SUBSETS = [(i, r) for i, r in enumerate([2] * 2 + [4] * 4 + [6] * 6 + [8] * 6 + [10] * 6)]
RANGE_CHARS = 16 << 20  # characters of a range of documents


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def terms(text: Column) -> Column:
    """Distinct terms of a text as 64-bit hashes."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def band(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The lexicon: term and df of the terms in the band."""
    total = docs.count()
    df = docs.select(F.explode(terms(_text())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.filter((F.col("df") >= 2) & (F.col("df") >= low * total) & (F.col("df") <= high * total))


def lexicon(band: DataFrame) -> DataFrame:
    """One row: ``lists``, array of ``BUCKETS`` arrays with the band's terms."""
    full = band.groupBy(F.pmod("term", F.lit(BUCKETS)).alias("id")).agg(F.collect_list("term").alias("own"))
    every = band.sparkSession.range(BUCKETS).join(full, "id", "left")
    # BUCKETS rows, whatever the input.
    each = F.struct("id", F.coalesce("own", F.array().cast("array<bigint>")).alias("own"))
    return every.agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["own"]).alias("lists"))


def hashes(text: Column, lists: Column) -> Column:
    """The fingerprint as array<long>, null where a subset has none of the text's terms."""

    def inside(t: Column) -> Column:
        return F.array_contains(F.get(lists, F.pmod(t, F.lit(BUCKETS)).cast("int")), t)

    def subset(ts: Column, i: int, r: int) -> Column:
        own = F.filter(ts, lambda t: F.xxhash64(t, F.lit(i)).bitwiseAND(F.lit((1 << r) - 1)) == 0)
        return let(own, lambda o: F.when(F.size(o) > 0, F.xxhash64(o)))

    sets = lambda ts: F.array(*[subset(ts, *s) for s in SUBSETS])
    whole = F.array(*[F.xxhash64(text, F.lit(i)) for i in range(len(SUBSETS))])
    return let(F.sort_array(F.filter(terms(text), inside)), lambda ts: F.when(F.size(ts) > 0, sets(ts)).otherwise(whole))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places among those that either fingerprint has."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda x: x))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.when(used > 0, same / used).otherwise(0.0)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.coalesce(F.hex(h), F.lit("-"))), ":")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The documents with ``fingerprint`` (string); other columns pass through, one of that name is replaced."""
    lists = lexicon(stored(band(docs, low, high), "lexicon"))
    kept = docs.drop("fingerprint")
    own = unused("_lists", kept.columns)
    return kept.withColumn(own, lists.scalar()).select(*kept.columns, as_text(let(_text(), lambda t: hashes(t, F.col(own)))).alias("fingerprint"))


def _ranges(keyed: DataFrame) -> tuple[DataFrame, int]:
    """One row: ``firsts``, the sorted first keys of ranges of documents; and the number of steps that find a range."""
    spark = keyed.sparkSession
    chars = keyed.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    wanted = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS))
    dealt = keyed.select("k").repartitionByRange(wanted, "k").withColumn("part", F.spark_partition_id())
    # A row per range.
    firsts = dealt.groupBy("part").agg(F.min("k").alias("k")).agg(F.sort_array(F.collect_list("k")).alias("firsts"))
    return stored(firsts, "ranges"), wanted.bit_length() + 1


def _place(k: Column, firsts: Column, steps: int) -> Column:
    """Where a key belongs: the last range whose first key is not greater, by halving; whether it is this first key; the range before it, cyclically."""
    start = F.struct(F.lit(0).alias("low"), F.size(firsts).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        up = (at["low"] < at["high"]) & (F.get(firsts, middle) <= k)
        return F.struct(F.when(up, middle + 1).otherwise(at["low"]).alias("low"), F.when(up | (at["low"] >= at["high"]), at["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["low"] - 1
    return let(found, lambda p: F.struct(p.alias("part"), (F.get(firsts, p) == k).alias("first"), F.pmod(p - 1, F.size(firsts)).alias("before")))


def with_next(docs: DataFrame, own: Column | None = None) -> DataFrame:
    """doc_id, text (null as empty), own, next_text, next_own: each document beside the next one; ``own`` is computed before rows move.

    The order is by doc_id, descending, nulls last, and by the hash of the text among rows of one id; after
    the last row comes the first. Texts move once, to ranges of this order; the first row of a range also
    goes to the range before. Rows equal in id and text meet in one task.
    """
    ident = F.col("doc_id").cast("long")
    key = F.struct(ident.isNull().alias("none"), F.coalesce(F.bitwise_not(ident), F.lit(0)).alias("down"), F.xxhash64(_text()).alias("mark"))
    plain = docs.select(ident.alias("doc_id"), _text().alias("text"), key.alias("k"))
    firsts, steps = _ranges(plain)
    extra = (F.lit(None) if own is None else own).alias("own")
    # Both arrays are used once and in one projection over the scan, so no row carries them.
    at = let(F.col("_firsts"), lambda f: let(key, lambda k: _place(k, f, steps)))
    placed = docs.withColumn("_firsts", firsts.scalar()).select(ident.alias("doc_id"), _text().alias("text"), key.alias("k"), extra, at.alias("at"))
    home = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("at.before").alias("part"), F.lit(True).alias("guest"))
    dealt = placed.select("doc_id", "text", "k", "own", F.explode(F.when(F.col("at.first"), F.array(home, guest)).otherwise(F.array(home))).alias("to"))
    order = Window.partitionBy("part").orderBy("guest", "k")
    rows = dealt.select("doc_id", "text", "k", "own", "to.part", "to.guest")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order))
    return rows.filter("NOT guest").select("doc_id", "text", "own", "next_text", "next_own")


def edited(text: Column, after: Column) -> Column:
    """The text with its last floor(n / 3) code points replaced by the first as many, or all, of ``after``."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(after, F.lit(1), third))


def robustness(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per document.

    ``near_*`` compare the document's fingerprint with that of its edited text and of the next document
    (see ``with_next``). Repeated rows are documents of their own.
    """
    lists = lexicon(stored(band(docs, low, high), "lexicon"))
    source = docs.select("doc_id", "text").withColumn("_lists", lists.scalar())
    pairs = with_next(source, let(_text(), lambda t: hashes(t, F.col("_lists"))))
    changed = pairs.select("doc_id", "own", "next_own", F.char_length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited")).withColumn("_lists", lists.scalar())
    both = changed.select("doc_id", "own", "next_own", "n_chars", let(F.col("edited"), lambda t: F.struct(sha256_utf8(t).alias("sha"), hashes(t, F.col("_lists")).alias("own"))).alias("e"))
    return both.select(
        "doc_id",
        "n_chars",
        F.col("e.sha").alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("e.own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("e.own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
