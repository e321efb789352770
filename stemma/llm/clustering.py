"""Centroid clustering of integer vectors: nearest centroids by the threshold algorithm, exact means.

For each dimension the centroids stand in a sorted list. A vector is put into each list at its own value; all lists are
walked outward from there together, one centroid a step, the nearer side first. A centroid's exact distance is taken
when any list meets it. What no list has met yet is at least as far as all frontiers together, so a vector is done as
soon as the sum of its squared frontier distances strictly exceeds its best exact distance: a centroid that ties with
the best is always met, and the smallest number wins.

Each round is one pass: tasks send one row of sums for each centroid they met, Spark adds them up, and the k means (k
numbers of each dimension, whatever the table's size) come to the driver. Sums and quotients are whole numbers, so
results do not hang on partitions or order.

Vectors that are null, of another length, or with a null, NaN or infinite component are left out. A row without vec_id
is clustered as any other but never starts a centroid. Repeated rows count as often as they are there; of equal start
hashes the lesser vector comes first, and of equal centroids the one with the smallest number gets the vectors. With
fewer named vectors than centroids there are fewer centroids; without any, and for an empty table, there is no row. Other columns
are ignored, whatever their names. Components of 2**27 or more after scaling raise an error: distances would not fit
a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import saved

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Scaled components must stay below this.
LIMIT = 1 << 27
#: Vectors that one step of the walk holds at once.
SLICE = 4096


def whole_vectors(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): kept vectors with each component x as floor(scale * x), x as double."""
    x = F.col("embedding").cast("array<double>")
    fits = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("bigint"))
    small = F.forall("v", lambda c: (c < LIMIT) & (c > -LIMIT))
    found = rows.where(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("bigint"), scaled.alias("v"))
    return found.select("vec_id", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large to take distances in whole numbers"))).alias("v"))


def start(vectors: DataFrame, k: int = CENTROIDS, salt: str = "3") -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `salt:vec_id`, in the order of their hashes."""
    named = vectors.where("vec_id is not null").withColumn("_hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["v"] for r in named.orderBy("_hash", "v").limit(k).collect()], np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector, the squared distance, and how many exact distances were taken."""
    n, k = len(vectors), len(centroids)
    best, chosen, taken = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64), 0
    order = np.argsort(centroids, axis=0, kind="stable")  # one sorted list a dimension
    values = np.take_along_axis(centroids, order, 0)
    dims = np.arange(vectors.shape[1])
    high = np.stack([np.searchsorted(values[:, d], vectors[:, d]) for d in dims], 1)
    low = high - 1
    met = np.zeros((n, k), bool)
    live = np.arange(n)
    while len(live):
        x, lo, hi = vectors[live], low[live], high[live]
        below = np.where(lo >= 0, x - values[np.maximum(lo, 0), dims], np.iinfo(np.int64).max)
        above = np.where(hi < k, values[np.minimum(hi, k - 1), dims] - x, np.iinfo(np.int64).max)
        down = below <= above
        frontier = np.where(down, below, above)
        at = order[np.where(down, np.maximum(lo, 0), np.minimum(hi, k - 1)), dims]
        low[live], high[live] = lo - down, hi + ~down
        before = met[live]
        now = before.copy()
        now[np.arange(len(live))[:, None], at] = True
        met[live] = now
        row, centroid = np.nonzero(now & ~before)
        taken += len(row)
        distance = ((x[row] - centroids[centroid]) ** 2).sum(1)
        exact = np.full((len(live), k), np.iinfo(np.int64).max)
        exact[row, centroid] = distance
        number, least = exact.argmin(1), exact.min(1)  # argmin gives the smallest number
        wins = (least < best[live]) | ((least == best[live]) & (number < chosen[live]))
        best[live], chosen[live] = np.where(wins, least, best[live]), np.where(wins, number, chosen[live])
        left = ((frontier**2).sum(1) <= best[live]) & ~now.all(1)
        live = live[left]
    return chosen, best, taken


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimensions)


def sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, d, total, n): for each cluster and dimension the sum of its vectors and their number."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), dimensions)
            for a in range(0, len(v), SLICE):
                cluster = nearest(v[a : a + SLICE], centroids)[0]
                np.add.at(total, cluster, v[a : a + SLICE])
                count += np.bincount(cluster, minlength=len(centroids))
        full = np.flatnonzero(count)
        for c in full.tolist():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dimensions, c)), pa.array(np.arange(dimensions)), pa.array(total[c]), pa.array(np.full(dimensions, count[c]))], names=["cluster", "d", "total", "n"])

    local = vectors.select("v").mapInArrow(run, "cluster bigint, d bigint, total bigint, n bigint")
    return local.groupBy("cluster", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: each non-empty one at the componentwise floor of its vectors' mean."""
    out = centroids.copy()
    for r in sums(vectors, centroids).collect():  # one number for each cluster and dimension
        out[r["cluster"], r["d"]] = int(r["total"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of all vectors."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dimensions)
            for a in range(0, len(v), SLICE):
                cluster, distance, _ = nearest(v[a : a + SLICE], centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(a, SLICE), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def clustered(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = "3") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), final centroids) of rows(vec_id, embedding)."""
    vectors = saved(whole_vectors(rows, dimensions, scale), "vectors")
    centroids = start(vectors, k, salt)
    if not len(centroids):
        return vectors.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return assigned(vectors, centroids), centroids


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = saved(found, "clustered")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    named = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in inertia]
    told = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Assignment by all distances, round by round."""
    near = """d{i} AS MATERIALIZED (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM parts v JOIN c{i} c USING (d) GROUP BY v.row, c.cluster),
a{i} AS MATERIALIZED (SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{i} GROUP BY row)"""
    move = """c{j} AS MATERIALIZED (SELECT c.cluster, c.d, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT cluster, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
  FROM parts JOIN a{i} USING (row) GROUP BY cluster, d) m USING (cluster, d))"""
    steps = [near.format(i=0)]
    for i in range(ROUNDS):
        steps += [move.format(i=i, j=i + 1), near.format(i=i + 1)]
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS row FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, unnest(v) AS x, unnest(range({DIMENSIONS})) AS d FROM kept),
chosen AS (SELECT row, row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), v) - 1 AS cluster FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT cluster, d, x FROM chosen JOIN parts USING (row)),
{", ".join(steps)},
digests AS (SELECT cluster, sha256(string_agg(x, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN kept USING (row) JOIN digests USING (cluster)"""


OP12_SQL = _sql()
