"""Clustering against plain Python, ties and odd rows included."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def nearest(v, cs) -> tuple[int, int]:
    return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))


def brute(rows, k: int, rounds: int, size: int) -> Counter:
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for _ in range(rounds):
        of = [nearest(v, cs)[1] for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), a in zip(kept, of, strict=True) if a == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v, cs) for _, v in kept]
    per = Counter()
    for d, j in last:
        per[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return Counter((i, j, d, per[j], sum(per.values()), name[j]) for (i, _), (d, j) in zip(kept, last, strict=True))


def found(docs, k: int, rounds: int, size: int) -> Counter:
    return Counter(map(tuple, centroids.digest(*centroids.clusters(docs, k, rounds, size)).collect()))


def test_odd_rows_and_ties(spark):
    """Few values, so equal distances and equal centroids abound; one vector makes up a third of the rows."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(3)]) for i in range(120)] + [(200 + i, [0.25, 0.25, 0.0]) for i in range(60)]
    rows += [(None, [0.1, 0.2, 0.3]), (None, [0.3, 0.2, 0.1]), (7, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (400, None), (401, []), (402, [0.1, 0.2]), (403, [0.1, None, 0.2]), (404, [0.1, float("nan"), 0.0]), (405, [float("inf"), 0.0, 0.0])]
    exact = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v in rows]
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    assert found(docs, 12, 4, 3) == brute(exact, 12, 4, 3)
    assert found(docs.limit(0), 12, 4, 3) == Counter()
    few = docs.filter("vec_id IN (1, 2, 3, 402)")
    assert found(few, 12, 2, 3) == brute([r for r in exact if r[0] in (1, 2, 3, 402)], 12, 2, 3)
    with pytest.raises(Exception, match="after scaling"):
        found(spark.createDataFrame([(1, [1e9, 0.0, 0.0], 0)], SCHEMA), 2, 1, 3)


def test_search_equals_all_distances_and_measures_fewer():
    rng = np.random.default_rng(3)
    middle = rng.integers(-3000, 3000, (50, 16))
    v = middle[rng.integers(0, 50, 6000)] + rng.integers(-60, 60, (6000, 16))
    c, before = v[rng.choice(6000, 50, replace=False)], None
    state = np.full(6000, -1), np.zeros(6000), np.zeros(6000)
    measured = []
    for _ in range(6):
        *state, n = centroids.Search(c, before).assign(v, *state)
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all()
        two = np.sqrt(np.partition(d, 1, axis=1)[:, :2])
        assert (state[1] >= two[:, 0]).all() and (state[2] <= two[:, 1] + 1e-6).all()
        measured.append(n)
        before, c = c, np.stack([v[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c[j] for j in range(50)])
    assert max(measured[1:]) < 6000 * 50 / 2 and measured[-1] < 6000


def test_one_cluster():
    v = np.array([[1, 2], [3, 4]])
    cluster, *_ = centroids.Search(v[:1]).assign(v, np.full(2, -1), np.zeros(2), np.zeros(2))
    assert cluster.tolist() == [0, 0]
