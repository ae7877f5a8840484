"""Line dedup and its filters against plain Python, odd cases included."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from emberlog.llm import line_dedup
from emberlog.llm.cuckoo import Cuckoo
from tests.llm.cases import CLASHES, clashing, documents


def key(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, corpus=None) -> Counter:
    """(doc_id, n_lines, n_dropped, kept text) of ``rows`` by the lines of ``corpus``."""
    holders = defaultdict(set)
    for doc, text in corpus or rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(doc)
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or max(d for d in holders[key(x)] if d is not None) == doc]
        out[(doc, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


def shown(index, docs) -> Counter:
    got = line_dedup.without_repeated_lines(index, docs)
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect())


LINES = ["A line that many documents hold", "  a LINE that many documents hold\t", "exactly twenty chars", "nineteen characters", "", "Ärger über zwanzig Zeichen", "ärger über zwanzig Zeichen", "another line for these tests\r"]


def corpus(n: int, seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    pool = LINES + [f"pool line number {i} of the corpus" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"a line of its own {i} {rng.random()}" for _ in range(rng.randrange(0, 9)))) for i in range(n)]
    return [*rows, (None, LINES[0]), (None, LINES[2]), (n, None), (3, LINES[0]), (3, LINES[0])]


def test_digest(spark, sf_dir):
    for docs in (clashing(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), documents(spark, [])):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = Counter((d, n, x, hashlib.sha256(t.encode()).hexdigest()) for (d, n, x, t), c in brute(rows).items() for _ in range(c))
        assert Counter(map(tuple, line_dedup.dedup(docs.repartition(3)).collect())) == want


@pytest.mark.parametrize(("small", "room"), [(1 << 16, 1 << 26), (4, -1)])
def test_insertions_and_deletions_undo_each_other(spark, small, room, monkeypatch):
    """After each step as a corpus that was there from the start; also without filters and with few hot keys."""
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", room)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    a, b = corpus(60, 1), [(100 + i if i is not None else None, t) for i, t in corpus(60, 2)]
    first = line_dedup.insert(line_dedup.empty_index(spark, shards=5), frame(a))
    both = line_dedup.insert(first, frame(b))
    assert shown(first, frame(a)) == brute(a)
    assert shown(both, frame(a + b)) == brute(a + b)
    again = line_dedup.delete(both, frame(a))  # the null document goes too
    assert shown(again, frame(a + b)) == brute(a + b, [x for x in b if x[0] is not None])
    back = line_dedup.insert(again, frame(a))
    if room < 0:
        return
    line = lambda t: sorted(map(tuple, t.collect()))
    assert line(back.counts) == line(both.counts)
    held = back.counts.filter("n_docs >= 3").collect()
    filters = {r["shard"]: Cuckoo.loads(bytes(r["filter"])) for r in back.filters.collect()}
    assert held and all(filters[r["hi"] % 5].contains(np.array([r["lo"]]).view(np.uint64))[0] for r in held)
    assert sum(int((f.table > 0).sum()) + len(f.stash) for f in filters.values()) == len(held)


def test_other_columns_stay(spark):
    docs = clashing(spark)
    got = line_dedup.without_repeated_lines(line_dedup.insert(line_dedup.empty_index(spark), docs), docs)
    assert got.columns == [*docs.columns, *line_dedup.ADDED]
    assert all(r[c] == "other" for r in got.collect() for c in CLASHES)


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 64, 30_000, dtype=np.uint64)
    f = Cuckoo.sized(20_000)
    f.insert(h[:12_000])
    f.insert(np.concatenate([h[12_000:20_000], h[:50]]))
    assert f.contains(h[:20_000]).all() and f.contains(h[20_000:]).mean() < 0.01
    f = Cuckoo.loads(f.dumps())
    f.delete(np.concatenate([h[:10_000], h[:50]]))
    assert f.contains(h[10_000:20_000]).all() and f.contains(h[:10_000]).mean() < 0.01
    f.delete(h[10_000:20_000])
    assert not f.table.any() and not len(f.stash)
    full = Cuckoo.sized(100)
    full.insert(h[:3_000])  # far beyond its room: the rest is stashed
    assert full.contains(h[:3_000]).all()
    same = np.repeat(h[:1], 30)
    full = Cuckoo.sized(8)
    full.insert(same)
    full.delete(same)
    assert not full.table.any() and not len(full.stash)
    with pytest.raises(KeyError):
        full.delete(h[:1])
