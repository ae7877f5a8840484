"""Fingerprints and sharding against plain Python, odd cases included."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from emberlog.llm import fingerprints, sharding
from tests.llm.cases import ROWS, clashing, documents


@pytest.fixture(params=["plain", "clashing", "table"])
def docs(request, spark, sf_dir):
    return {"plain": documents, "clashing": clashing}.get(request.param, lambda s: s.read.parquet(f"{sf_dir}/documents.parquet"))(spark)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def name(text: str) -> int:
    return signed(xxhash.xxh64_intdigest(text.encode(), seed=42))


def chained(numbers, seed: int = 42) -> int:
    """The hash of several columns or of an array: each value with the hash so far as the seed; longs in eight bytes, ints in four."""
    for size, x in numbers:
        seed = xxhash.xxh64_intdigest((x % (1 << 8 * size)).to_bytes(size, "little"), seed=seed)
    return signed(seed)


def brute(rows) -> list[tuple]:
    """The rows of ``robustness`` by plain Python, for (doc_id, text) pairs."""
    own_terms = lambda t: {name(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())}
    df = Counter(x for _, t in rows for x in own_terms(t))
    lexicon = {x for x, n in df.items() if n >= 2 and fingerprints.LOW * len(rows) <= n <= fingerprints.HIGH * len(rows)}

    def of(t: str) -> list:
        found = sorted(own_terms(t) & lexicon)
        if not found:
            whole = xxhash.xxh64_intdigest(t.encode(), seed=42)
            return [chained([(4, i)], whole) for i, _ in fingerprints.SUBSETS]
        subsets = [[x for x in found if chained([(8, x), (4, i)]) % (1 << r) == 0] for i, r in fingerprints.SUBSETS]
        return [chained([(8, x) for x in s]) if s else None for s in subsets]

    def near(a: list, b: list) -> float:
        used = sum(x is not None or y is not None for x, y in zip(a, b, strict=True))
        return sum(x is not None and x == y for x, y in zip(a, b, strict=True)) / used if used else 0.0

    text = lambda f: ":".join("-" if x is None else f"{x % (1 << 64):X}" for x in f)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), name(r[1])))
    out = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        f, g, h = of(t), of(e), of(after)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), text(f), text(g), near(f, g), near(f, h)))
    return out


def test_fingerprints(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = fingerprints.robustness(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))
    if len(rows) >= 200:
        mean = lambda k: sum(r[k] for r in got) / len(got)
        assert mean("near_edited") > mean("near_next") + 0.1


def test_fingerprints_without_ids(spark):
    rows = [(None, "alpha beta gamma delta"), (None, "beta gamma"), (3, "gamma delta beta"), (-5, "alpha"), (-(1 << 63), "x y beta"), ((1 << 63) - 1, "beta delta")]
    got = fingerprints.robustness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))


def test_sharding(docs):
    rows = docs.collect()
    got = sharding.digest(sharding.assign(docs.repartition(3))).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    slots = defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]), "rows")
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_keeps_groups_together(spark):
    rows = [(i, f"text {i // 4}" if i < 400 else f"single {i}") for i in range(2400)] + [(5000 + i, "hot") for i in range(1200)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    text, at = dict(rows), defaultdict(set)
    for r in got:
        at[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(x) == 1 for t, x in at.items() if t.startswith("text")) >= 95


def test_sharding_without_free_rows(spark):
    """Every text has a copy, and two groups are larger than a shard: nothing but these and a few others is split."""
    texts = [f"text {i // 3}" for i in range(1200)] + [f"pair {i // 2}" for i in range(600)] + ["hot"] * 900 + ["warm"] * 300
    got = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    at, sizes = defaultdict(set), Counter(r["shard"] for r in got)
    for r in got:
        at[texts[r["doc_id"]]].add(r["shard"])
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    assert sum(len(x) > 1 for t, x in at.items() if t not in ("hot", "warm")) < 24
    assert len(at["hot"]) <= 9 and len(at["warm"]) <= 4


def test_empty_tables(spark):
    none = documents(spark, [])
    assert fingerprints.robustness(none).count() == 0
    assert fingerprints.fingerprints(none).count() == 0
    assert sharding.assign(none).count() == 0
    assert len(ROWS) == sharding.assign(documents(spark)).count()
