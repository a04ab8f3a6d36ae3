"""Centroid clustering with a vantage-point tree (operator 12).

Vectors become integers floor(scale * x).  Each round the driver builds a
vantage-point tree over the centroids and broadcasts it (k centroids, a
parameter).  Each vector searches it best-first: of the nodes it has reached it
takes the one with the least lower bound (triangle inequality on the nearest and
farthest centroid of either side), and stops once that exceeds the radius of the
best centroid so far.  The radius is inclusive, so that centroids at the same
distance are met too and the smaller number wins.  All distances that decide are
exact integers; bounds are floating-point numbers with slack for their rounding.

Tasks add up their vectors per centroid, so a round shuffles k rows a task,
whatever the share of a centroid.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import sliced, table
from logloom.session import written

DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, "1"
LIMIT = 1 << 27  # components within +-LIMIT keep squared distances in 64 bits, up to 64 components
LEAF = 2  # centroids in a leaf
SLACK = 1e-9
BATCH = 4096


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", value_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``id`` and integer ``v`` of the rows with exactly ``dim`` components, none null or non-finite."""
    x = F.col(value_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where((F.size(x) == dim) & fine).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    wide = F.exists("v", lambda c: F.abs(c) > LIMIT)
    checked = F.when(wide, F.raise_error(F.lit(f"a component beyond {LIMIT} makes distances too large for 64 bits")).cast("array<int>"))
    return rows.select("id", checked.otherwise(F.col("v").cast("array<int>")).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``c``."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class VantageTree:
    """Nodes (vantage centroid, near child, far child) and leaves over integer centroids."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.c = centroids.astype(np.int64)
        self.nodes: list[tuple] = []  # (members,) or (vantage, near, far, near's greatest, far's least distance)
        if len(self.c):
            self._build(np.arange(len(self.c)), leaf)

    def _build(self, members: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((members.tolist(),))
        if len(members) > leaf:
            spread = [np.sqrt(squared(self.c[members], self.c[m]).astype(np.float64)).std() for m in members[:32]]
            v = int(members[int(np.argmax(spread))])
            rest = members[members != v]
            d = np.sqrt(squared(self.c[rest], self.c[v]).astype(np.float64))
            order = np.argsort(d, kind="stable")
            rest, d, half = rest[order], d[order], len(rest) // 2
            near = self._build(rest[:half], leaf) if half else -1
            far = self._build(rest[half:], leaf)
            self.nodes[at] = (v, near, far, d[half - 1] if half else 0.0, d[half])
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and its squared distance, per row of ``x``."""
        x = x.astype(np.int64)
        n = len(x)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.c), np.int64)
        bound = np.full((n, len(self.nodes)), np.inf)  # lower bounds of the nodes reached and not yet taken
        bound[:, 0] = 0.0

        def measure(rows, c):
            d = squared(x[rows], self.c[c])
            better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], c
            return np.sqrt(d.astype(np.float64))

        live = np.arange(n)
        while len(live):
            node = np.argmin(bound[live], axis=1)
            low = bound[live, node]
            radius = np.sqrt(best[live].astype(np.float64))
            go = low <= radius * (1 + SLACK) + SLACK  # inclusive
            live, node = live[go & np.isfinite(low)], node[go & np.isfinite(low)]
            for k in np.unique(node).tolist():
                rows = live[node == k]
                own = bound[rows, k]
                bound[rows, k] = np.inf
                if len(self.nodes[k]) == 1:
                    for c in self.nodes[k][0]:
                        measure(rows, c)
                    continue
                v, near, far, greatest, least = self.nodes[k]
                d = measure(rows, v)
                loose = SLACK * (d + least + 1)
                if near >= 0:
                    bound[rows, near] = np.maximum(own, d - greatest - loose)
                bound[rows, far] = np.maximum(own, least - d - loose)
        return number, best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _sums(shared, k: int, dim: int):
    def run(batches):
        tree, total, count = shared.value, np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in sliced(batches, BATCH):
            x = _matrix(batch.column("v"), dim)
            number, _ = tree.nearest(x)
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
            total[number[order][first]] += np.add.reduceat(x[order], first, axis=0, dtype=np.int64)
            count += np.bincount(number, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some]),
                                          "s": pa.array(list(total[some]), pa.list_(pa.int64()))})
    return run


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id``, cluster and squared distance of every row of ``rows(id, v)``."""
    shared, dim = rows.sparkSession.sparkContext.broadcast(VantageTree(centroids)), centroids.shape[1]

    def run(batches):
        for batch in sliced(batches, BATCH):
            number, best = shared.value.nearest(_matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "cluster": pa.array(number, pa.int32()), "distance": pa.array(best)})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def first_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The ``k`` rows with the smallest sha256 of ``seed:id``, in that order (ties: by components)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], np.int64)


def next_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the componentwise floor of the mean of each centroid's vectors; empty ones stay."""
    k, dim = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    parts = rows.select("v").mapInArrow(_sums(shared, k, dim), "cluster int, n long, s array<long>")
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)]).collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]  # at most k rows
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", value_col: str = "embedding", dim: int = DIM, scale: int = SCALE,
            k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Null vectors, those of another length and those with a null or non-finite
    component are left out.  A null id is hashed as the empty string; repeated
    ids and equal vectors are rows of their own and may start as several
    centroids, of which the smaller number wins.  Fewer vectors than ``k``:
    so many centroids.  No vectors: no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(kept_vectors(vectors, id_col, value_col, dim, scale))
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        kind = rows.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids)
    found = written(assign(rows, centroids))
    total = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame([(c, s, sum(total.values()), digest[c]) for c, s in total.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of embeddings."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    def assigned(r):
        return f"""
a{r} AS MATERIALIZED (SELECT id, v, x[2] AS cluster, x[1] AS distance FROM (SELECT id, r, any_value(v) AS v, min(row(d, cluster)) AS x FROM (
  SELECT id, k.r, k.v, c.cluster, list_sum(list_transform(range(1, {DIM + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS d
  FROM kept k, c{r} c) GROUP BY id, r))"""

    def moved(r):
        return f"""
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(q ORDER BY i) AS v FROM (
  SELECT cluster, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
  FROM a{r}, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""

    steps = ",".join(assigned(r) + "," + moved(r) for r in range(ROUNDS)) + "," + assigned(ROUNDS)
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v FROM (
  SELECT sha256(concat('{SEED}:', id)) AS h, v FROM kept ORDER BY h, v LIMIT {K})),{steps}
SELECT id AS vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN (SELECT cluster, v FROM c{ROUNDS}) c USING (cluster)
"""


OP12_SQL = _sql()
