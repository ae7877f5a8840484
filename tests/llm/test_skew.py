"""Joins without a hot key: equal to plain joins, and the operators on them whatever is taken for hot."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.llm import jaccard, sharding, skew
from tests.llm.cases import BASE


@pytest.mark.parametrize("how", ["inner", "left"])
def test_by_weight(spark, monkeypatch, how):
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 40}" if i % 7 else None, i) for i in range(900)], "k string, v long")
    values = rows.filter("k IS NOT NULL AND k <> 'k5'").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    plain = Counter(map(tuple, rows.join(values, "k", how).collect()))
    assert Counter(map(tuple, skew.by_weight(rows, values, ["k"], "n", how).collect())) == plain
    monkeypatch.setattr(skew, "HOT", 8)
    split = skew.by_weight(rows, values, ["k"], "n", how)
    assert Counter(map(tuple, split.collect())) == plain
    every = values.agg({"n": "sum"}).first()[0]
    hot = [r["k"] for r in values.collect() if r["n"] > every // 8]
    assert "hot" in hot and len(hot) < 8
    assert skew.by_weight(rows, values.limit(0), ["k"], "n", how).count() == (len(rows.collect()) if how == "left" else 0)


def test_components_with_hot_texts_and_groups(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 4)
    words = BASE.split()
    rows = [(i, BASE) for i in range(60)] + [(100 + i, " ".join([*words, f"tail{i}"])) for i in range(60)]
    rows += [(200 + i, " ".join(f"{w}{i // 2}" for w in words)) for i in range(40)] + [(300 + i, None if i % 2 else "") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    want = {d: 0 if d < 200 else d - d % 2 if d < 300 else d for d, _ in rows}
    assert got == want
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect())
    assert kept == sorted({c for d, c in want.items()})


def test_nodes_tell_classes_apart(spark):
    classes = [(k, n) for k in (-(1 << 63), -1, 0, 1, (1 << 63) - 1) for n in (1, 2, (1 << 31) - 1)]
    nodes = [r[0] for r in spark.createDataFrame(classes, "key long, n long").select(jaccard._node("key", "n")).collect()]
    assert [int(x) for x in nodes] == [k * (1 << 32) + n for k, n in classes]


def test_shards_with_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 4)
    texts = ["hot"] * 500 + [f"pair {i // 2}" for i in range(400)] + [f"trio {i // 3}" for i in range(300)] + [None, ""] * 3
    got = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    at, sizes = defaultdict(set), Counter(r["shard"] for r in got)
    for r in got:
        at[texts[r["doc_id"]] or ""].add(r["shard"])
        assert r["n_same"] == Counter(t or "" for t in texts)[texts[r["doc_id"]] or ""]
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sum(len(x) > 1 for t, x in at.items() if t != "hot") < 24
