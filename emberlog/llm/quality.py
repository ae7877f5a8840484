"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger keeps the measurements and one failure bit per
rule. A policy is a versioned list of rules, applied as a mask; ablations come from the counts of
distinct bitmasks, without looking at a text again. Native expressions only.

Null texts count as empty and fail the length rule. Repeated rows are judged once each. Other columns
pass through unless a measurement, ``fail_bits``, ``base_failed`` or ``kept`` has their name, which
then replaces them. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.words import SPACE, let, unused, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements, null-free, in whole numbers."""

    name: str
    failed: str


# A rule's bit is its place; new rules go to the end.
RULES = [
    Rule("too_short", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "2 * n_upper > n_letters AND n_letters > 0"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 16 * n_words"),
    Rule("exclamations", "2 * n_exclaim > n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
    Rule("stutter", "4 * n_stutter > n_words"),
]
BASE = ["too_short", "repeated_windows"]
POLICIES = {
    "v1": BASE,
    "v2": [*BASE, "symbols", "duplicate_lines", "capitals", "word_length"],
    "v3": [r.name for r in RULES],
}
MEASUREMENTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_exclaim", "n_stutter"]


def mask(names: list[str]) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[n] for n in set(names))


def _repeated(keyed: Column) -> Column:
    """Places of the elements of array<struct<key, place>> whose key occurs twice or more, in order of key."""
    same = lambda s, e, i: F.coalesce(F.get(s, i)["key"] == e["key"], F.lit(False))
    return let(F.sort_array(keyed), lambda s: F.transform(F.filter(s, lambda e, i: same(s, e, i - 1) | same(s, e, i + 1)), lambda e: e["place"]))


def repeat_words(array: Column, k: int = WINDOW) -> Column:
    """Words inside windows of k words that occur twice or more in the array, the first time included.

    Hashes find the windows that may repeat; the words themselves decide.
    """

    at = lambda w, i: [F.get(w, i + j) for j in range(k)]

    def exact(w: Column, hashes: Column) -> Column:
        maybe = _repeated(F.transform(hashes, lambda h, i: F.struct(h.alias("key"), i.alias("place"))))
        real = _repeated(F.transform(maybe, lambda i: F.struct(F.concat_ws(" ", *at(w, i)).alias("key"), i.alias("place"))))
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("total"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(k), i - acc["last"])).alias("total"))
        return F.aggregate(F.sort_array(real), start, step)["total"]

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*at(w, i)))
        return F.when(F.size(w) <= k, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(w, h))))

    return let(array, of)


def measure(docs: DataFrame) -> DataFrame:
    """Adds the measurements, all long."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chars = lambda c: F.char_length(c).cast("long")
    without = lambda pattern: chars(F.regexp_replace(text, pattern, ""))
    full_lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = let(full_lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    stutter = lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1)))
    counted = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeated"), stutter(w).alias("stutter")))
    kept = docs.drop(*MEASUREMENTS)
    w, of_lines = unused("_words", kept.columns), unused("_lines", kept.columns)
    out = kept.withColumn(w, counted).withColumn(of_lines, lines)
    field = lambda c, name: F.col(c).getField(name).cast("long")
    return out.select(
        *kept.columns,
        field(w, "n").alias("n_words"),
        without(SPACE).alias("word_chars"),
        (chars(text) - without(r"[#*$%&|<>]")).alias("n_symbols"),
        (field(of_lines, "n") - field(of_lines, "distinct")).alias("n_dup_lines"),
        field(w, "repeated").alias("n_repeat_words"),
        field(of_lines, "n").alias("n_lines"),
        without(r"\P{L}").alias("n_letters"),
        without(r"\P{Lu}").alias("n_upper"),
        without(r"[^!]").alias("n_exclaim"),
        field(w, "stutter").alias("n_stutter"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set where rule i fails."""
    bits = sum((F.when(F.expr(r.failed), 1 << i).otherwise(0) for i, r in enumerate(RULES)), F.lit(0))
    return measure(docs).withColumn("fail_bits", bits.cast("long"))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` by a policy's version."""
    failed = lambda names: F.col("fail_bits").bitwiseAND(F.lit(mask(names))) != 0
    return rows.withColumn("base_failed", failed(BASE)).withColumn("kept", ~failed([*BASE, *POLICIES[policy]]))


def ablation(rows: DataFrame) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that fail only it, and that are kept with and without it.

    Works on at most 2^rules rows of counts.
    """
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit"), F.lit(mask(rs)).cast("long").alias("mask")) for p, rs in POLICIES.items() for r in rs]
    each = counts.select("fail_bits", "n", F.explode(F.array(*cases)).alias("c")).select("fail_bits", "n", "c.*")
    inside = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(inside == F.col("bit")).alias("n_failed_only_here"),
        total(inside == 0).alias("n_kept"),
        total(inside.bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


_MEASURED_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM d),
windows AS (
  SELECT rid, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i+7], ' '))) AS k
  FROM w WHERE len(words) > 8),
keyed AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM windows),
spread AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM keyed WHERE c > 1) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(spread.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(full_lines) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '\P{L}', '', 'g')) AS BIGINT) AS n_letters,
    CAST(length(regexp_replace(text, '\P{Lu}', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclaim,
    CAST(len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS BIGINT) AS n_stutter
  FROM w LEFT JOIN spread ON spread.rid = w.rid)"""


def ledger_sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.failed} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    return f"WITH {_MEASURED_SQL.strip()},\nledger AS (SELECT * EXCLUDE (rid), CAST({bits} AS BIGINT) AS fail_bits FROM m)"


def policy_sql(policy: str) -> str:
    both = mask([*BASE, *POLICIES[policy]])
    return f"{ledger_sql()}\nSELECT *, (fail_bits & {mask(BASE)}) <> 0 AS base_failed, (fail_bits & {both}) = 0 AS kept FROM ledger"


def ablation_sql() -> str:
    cases = ", ".join(f"('{p}', '{r}', {mask([r])}, {mask(rs)})" for p, rs in POLICIES.items() for r in rs)
    total = lambda condition: f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"
    return f"""{ledger_sql()}
SELECT policy, rule, {total("(fail_bits & bit) <> 0")} AS n_failed, {total("(fail_bits & mask) = bit")} AS n_failed_only_here,
  {total("(fail_bits & mask) = 0")} AS n_kept, {total("(fail_bits & mask & ~bit) = 0")} AS n_kept_without
FROM ledger CROSS JOIN (VALUES {cases}) c(policy, rule, bit, mask) GROUP BY policy, rule"""
