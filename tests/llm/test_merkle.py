"""The Merkle manifest against plain Python, odd cases included."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.llm import merkle
from tests.llm.cases import clashing, documents


def h(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def climb(tree: list[list[str]], i: int, start: str) -> tuple[list[str], str]:
    """Siblings on the way from leaf i up, and the root that ``start`` gives."""
    met = []
    for level in tree[:-1]:
        a = i - i % 3
        run = level[a : a + 3]
        met += run[: i - a] + run[i - a + 1 :]
        start = h([*run[: i - a], start, *run[i - a + 1 :]])
        i //= 3
    return met, start


def brute(rows) -> Counter:
    """The rows of ``tamper_check`` for (doc_id, source, lang, n_chars, text) rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    digest = lambda r: h(map(field, r))
    trees, own = [], []
    for s in order:
        own.append(sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, digest(r))))
        trees.append(levels([digest(r) for r in own[-1]]))
    top = levels([t[-1][0] for t in trees])
    out = Counter()
    for t, (tree, mine) in enumerate(zip(trees, own, strict=True)):
        for i, r in enumerate(mine):
            start = tree[0][i]
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                start = digest((*r[:4], r[4].replace("\n", "")))
            low, sub = climb(tree, i, start)
            high, root = climb(top, t, sub)
            out[(r[0], tree[0][i], tree[-1][0], top[-1][0], h(low + high), root, root == top[-1][0])] += 1
    return out


@pytest.fixture(params=["clashing", "table", "empty"])
def docs(request, spark, sf_dir):
    return {"clashing": clashing, "empty": lambda s: documents(s, [])}.get(request.param, lambda s: s.read.parquet(f"{sf_dir}/documents.parquet"))(spark)


def wide(frame):
    return [tuple(r) for r in frame.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest(docs):
    got = Counter(map(tuple, merkle.tamper_check(docs.repartition(3)).collect()))
    assert got == brute(wide(docs))


@pytest.mark.parametrize("small", [0, 60])
def test_group_sizes(spark, small, monkeypatch):
    """One hot group, groups of 1 to 12 rows, repeated rows, and null ids, groups and texts; no level, or only some, may be broadcast."""
    monkeypatch.setattr(merkle, "SMALL", small)
    rows = [(i, "hot", "en", 1, f"a\n{i}") for i in range(400)] + [(1000 * g + i, f"g{g}", None, i, f"t\n{g}\n{i}") for g in range(1, 13) for i in range(g)]
    rows += [(None, None, None, None, None), (None, "hot", "x", 1, "a\nb"), (5, "hot", "en", 1, "a\n5"), (3, "", "", 0, ""), (-4, "Ä", "漢", 3, "x\n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert Counter(map(tuple, merkle.tamper_check(docs).collect())) == brute(rows)


def test_levels_and_coordinates(spark):
    for n in (1, 2, 3, 4, 9, 10, 27, 28, 100):
        sizes = [n]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // 3))
        frame = spark.range(n).select(F.col("id").alias("idx"), F.lit(n).cast("long").alias("n")).withColumn("height", merkle._height(F.col("n")))
        for r in frame.withColumn("c", merkle.coordinates(F.col("idx"), F.col("n"), F.col("height"))).collect():
            assert r["height"] == len(sizes) - 1
            want = [(k, j, j > r["idx"] // 3**k) for k, m in enumerate(sizes[:-1]) for j in range(3 * (r["idx"] // 3 ** (k + 1)), min(3 * (r["idx"] // 3 ** (k + 1)) + 3, m)) if j != r["idx"] // 3**k]
            assert [tuple(c) for c in r["c"]] == want
