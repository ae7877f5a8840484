"""Clustering by k-means over whole numbers, with Exponion's bounded search.

Components become floor(256 x). Every vector carries its centroid, an upper bound on its distance and a
lower bound on the distance to any other centroid. When centroids move, the bounds are widened by the
moves. If the upper bound is below the lower one, or below half the distance between the centroid and
its nearest other, the vector stays. Else its distance is measured, and if that does not settle it,
only centroids within twice the distance plus the distance to the nearest other one are scanned: a
prefix of the list of centroids sorted by distance from the vector's own. The ball is closed and bounds
are compared strictly, with a margin for rounding, so a tie is always seen and the smaller number wins.
Distances that decide are whole numbers.

Vectors lie in a table with their state, which each round writes anew and later rounds read by splits;
a task needs only the centroids (at most ``CLUSTERS`` rows) besides. Sums are taken per task and cluster before
they are shuffled.

Null vectors, vectors with other than ``SIZE`` components or a null or non-finite one are left out.
Repeated rows are vectors of their own; null ids count as an empty id. With fewer vectors than clusters
each starts a cluster. Equal start hashes follow the components. An empty table gives an empty result.
Components beyond +-``MOST`` after scaling are refused: squared distances must fit a long. Other columns
do not pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.session import discard, stored

CLUSTERS = 40
ROUNDS = 5
SIZE = 64
SCALE = 256
MOST = 1 << 27
SLACK = 1e-9  # of a distance, for rounding
STATE = "vec_id long, v array<long>, cluster int, distance long, upper double, lower double"


def vectors(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id and v, whole numbers, of the vectors that are kept."""
    e = F.col("embedding").cast("array<double>")
    fit = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter((F.size(e) == size) & fit)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def first_centroids(found: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id, in this order."""
    name = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = found.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Search:
    """Centroids, the sorted lists between them, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, k = centroids, len(centroids)
        between = np.sqrt(np.stack([_squared(centroids, x) for x in centroids]).astype(float))
        np.fill_diagonal(between, -1.0)  # the own centroid comes first, also before an equal one
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        self.near = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(_squared(centroids, before).astype(float)) * (1 + SLACK)
        most = np.sort(self.moved)
        #: The farthest move of any other centroid.
        self.others = np.where(self.moved == most[-1], most[-2] if k > 1 and (self.moved == most[-1]).sum() == 1 else most[-1], most[-1])

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Clusters, bounds, and the number of distances measured, from those of the round before (cluster -1: none)."""
        cluster, upper, lower, measured = cluster.copy(), upper.copy(), lower.copy(), 0
        new = cluster < 0
        upper = np.where(new, 0.0, upper + self.moved[cluster])
        lower = np.where(new, 0.0, np.maximum(lower - self.others[cluster] * (1 + SLACK), 0.0))
        cluster[new] = 0
        bound = np.maximum(lower, self.near[cluster] / 2) * (1 - SLACK)
        open_ = np.flatnonzero(new | ~(upper < bound))
        exact = np.sqrt(_squared(v[open_], self.c[cluster[open_]]).astype(float))
        measured += len(open_)
        upper[open_] = exact * (1 + SLACK)
        open_ = open_[~(upper[open_] < bound[open_])]
        own = cluster[open_]
        radius = (2 * upper[open_] + self.near[own]) * (1 + SLACK)
        for a in np.unique(own):
            rows, ball = open_[own == a], radius[own == a]
            size = np.searchsorted(self.sorted[a], ball, "right")
            wide = np.ceil(np.log2(np.maximum(size, 1))).astype(int)  # lists grow by doubling, so that rows of a pass have about one length
            for w in np.unique(wide):
                some = rows[wide == w]
                cand = np.sort(self.order[a, : min(1 << int(w), len(self.c))])
                d = np.stack([_squared(v[some], self.c[j]) for j in cand], axis=1)
                measured += d.size
                best = np.argmin(d, axis=1)  # the first of equal ones: the smallest number
                cluster[some] = cand[best]
                least = d[np.arange(len(some)), best]
                upper[some] = np.sqrt(least.astype(float)) * (1 + SLACK)
                d[np.arange(len(some)), best] = np.iinfo(np.int64).max
                # The nearest other centroid of ``a`` is in the ball, so the second best of all is.
                lower[some] = np.sqrt(d.min(axis=1).astype(float)) * (1 - SLACK) if len(cand) > 1 else np.inf
        return cluster, upper, lower, measured


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    if len(flat) and int(np.abs(flat).max()) > MOST:
        raise ValueError(f"a component lies beyond {MOST} after scaling")
    return flat.reshape(len(column), -1)


def _round(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"))
            cluster, upper, lower, _ = search.assign(v, b.column("cluster").to_numpy(), b.column("upper").to_numpy(), b.column("lower").to_numpy())
            distance = _squared(v, search.c[cluster])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "distance", "upper", "lower"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors and their sum per cluster, each cluster once a task."""
    total: dict[int, list] = {}
    for b in batches:
        cluster = b.column("cluster").to_numpy()
        v = _matrix(b.column("v")) if b.num_rows else None
        for c in np.unique(cluster):
            own = total.setdefault(int(c), [0, 0])
            own[0] += int((cluster == c).sum())
            own[1] = own[1] + v[cluster == c].sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floor of each cluster's mean; empty clusters stay."""
    size = centroids.shape[1] if centroids.ndim == 2 else 0
    parts = state.select("cluster", "v").mapInArrow(_sums, "cluster int, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(size)]).collect()  # a row per cluster
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return out


def clusters(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v, cluster, distance (squared) after ``rounds`` moves of the centroids, and the centroids."""
    start = vectors(rows, size).select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    state = stored(start, "vectors")
    c, before = first_centroids(state, k), None
    if not len(c):
        return state.select("vec_id", "v", "cluster", "distance"), c
    for turn in range(rounds + 1):
        new = stored(state.mapInArrow(_round(Search(c, before)), STATE), "vectors")
        discard(state)
        state = new
        if turn < rounds:
            before, c = c, moved(state, c)
    return state.select("vec_id", "v", "cluster", "distance"), c


def digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = found.sparkSession
    names = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, digits string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per = sums.join(names, "cluster").select("cluster", "cluster_inertia", F.sha2("digits", 256).alias("centroid_sha256"))
    inertia = found.agg(F.sum("distance").alias("inertia"))
    out = found.join(F.broadcast(per), "cluster").crossJoin(F.broadcast(inertia))  # a row per cluster, and one row
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustering_sql(k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> str:
    """The same in SQL, by measuring all distances; for small tables with distinct ids."""
    d = "list_sum(list_transform(range(1, {n} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))".format(n=size)
    near = lambda t: f"SELECT vec_id, v, arg_min(j, (dist, j)) AS j, min(dist) AS dist FROM (SELECT vec_id, v, j, {d} AS dist FROM kept CROSS JOIN {t}) GROUP BY vec_id, v"
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS ({near(f'c{r}')})")
        parts.append(f"m{r} AS (SELECT j, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(range(1, {size} + 1)) AS i, unnest(v) AS x FROM a{r}) GROUP BY j, i) GROUP BY j)")
        parts.append(f"c{r + 1} AS (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))")
    parts.append(f"last AS ({near(f'c{rounds}')})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(l.j AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY l.j) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last l JOIN c{rounds} USING (j)"""


CLUSTERING_SQL = clustering_sql()
