"""Clusters round centroids by sort-means, exact in integers.

Vectors become integers, floor(scale * x). Each round orders, for each centroid,
the others by their distance from it. A vector starts at the centroid it was
assigned to, at distance d; the others are scanned in that one's order, up to the
first that lies strictly beyond 2 d from it: by the triangle inequality neither
it nor any after it is as near, not even at a tie. So the result is that of a
full scan, ties to the smaller number.

Rounds. The vectors are written with their assignment; a round reads the last
table, writes the next, and drops the one before, so that a lost executor costs
one round. Tasks add up their vectors by centroid; what reaches the driver is
one sum for each centroid and component, whatever the number of vectors.

Defined cases: vectors that are null, of another length or hold null or
non-finite components are left out; components beyond +-2**27 are set to that
bound, so that squared distances stay longs; repeated rows count each. With
fewer vectors than centroids every vector starts one; equal ids start in the
order of their vectors, and a null id counts as empty text. An empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

CLUSTERS, ROUNDS, SCALE, SEED = 8, 10, 1024, 3
BOUND = 1 << 27


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, within the bound."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(float(BOUND))), F.lit(-float(BOUND))).cast("int"))


def usable(vector: Column, length: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == length) & finite, F.lit(False))


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return np.square(x - centroid).sum(-1)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, scanned from the one before."""
    best, distance = before.copy(), np.empty(len(x), np.int64)
    for a in np.unique(before).tolist():
        rows = np.flatnonzero(before == a)
        apart = squared(centroids, centroids[a])
        own = squared(x[rows], centroids[a])
        near, to = own.copy(), np.full(len(rows), a)
        for c in np.argsort(apart, kind="stable").tolist():
            if c == a:
                continue
            on = np.flatnonzero((apart[c] - 1) // 4 < own)  # not strictly beyond twice the distance
            if not len(on):
                break
            d = squared(x[rows[on]], centroids[c])
            better = (d < near[on]) | ((d == near[on]) & (c < to[on]))
            near[on[better]], to[on[better]] = d[better], c
        best[rows], distance[rows] = to, near
    return best, distance


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def _assigned(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(_matrix(batch.column(1), centroids.shape[1]), batch.column(2).to_numpy().astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "x", "cluster", "distance"])

    return run


def _summed(length: int):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, cluster = _matrix(batch.column(0), length), batch.column(1).to_numpy()
            for c in np.unique(cluster).tolist():
                part = x[cluster == c]
                total[c] = total.get(c, 0) + np.append(part.sum(0), len(part))
        for c, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), c, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["cluster", "component", "total"])

    return run


def moved(at: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; empty clusters stay."""
    length = centroids.shape[1]
    sums = at.select("x", "cluster").mapInArrow(_summed(length), "cluster int, component int, total long").groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total: dict[int, list[int]] = {}
    for cluster, component, value in sums.collect():  # clusters x (components + 1) numbers
        total.setdefault(cluster, [0] * (length + 1))[component] = int(value)
    out = centroids.copy()
    for cluster, sums in total.items():
        out[cluster] = [s // sums[-1] for s in sums[:-1]]
    return out


def first_centroids(at: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id."""
    of = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in at.select("x", of.alias("hash")).orderBy("hash", "x").limit(k).collect()], np.int64)


def sort_means(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, length: int = 64, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, x, cluster, distance) of every usable vector after the rounds and a last assignment, and the centroids."""
    scratch = Scratch(vectors.sparkSession, "means")
    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(usable(F.col("vec"), length))
    at = scratch.write(given.select("id", whole(F.col("vec"), scale).alias("x"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "0")
    centroids = first_centroids(at, k, seed)
    if not len(centroids):
        return at, centroids
    for step in range(1, rounds + 2):
        at = scratch.write(at.mapInArrow(_assigned(centroids), at.schema), str(step))
        scratch.drop(str(step - 1))
        if step <= rounds:
            centroids = moved(at, centroids)
    return at, centroids


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, centroids = sort_means(table(spark, sf_dir, "embeddings"))
    inertia = at.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # a row a cluster
    each = [(r["cluster"], int(r["inertia"]), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in inertia]
    told = spark.createDataFrame(each, "cluster int, cluster_inertia long, centroid_sha256 string").withColumn("inertia", F.lit(sum(r[1] for r in each)).cast("long"))
    return at.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(told), "cluster")


_ROUND = """a{i} AS MATERIALIZED (SELECT id, any_value(v.x) AS x, min({{'d': d, 'c': c}}) AS b FROM (SELECT id, v.x, c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, k{i} k) v GROUP BY id)"""
_MOVE = """m{i} AS (SELECT c, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY j) AS x FROM (SELECT b.c AS c, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(j) GROUP BY b.c, j) GROUP BY c),
k{j} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM k{i} k LEFT JOIN m{i} m USING (c))"""
#: The same by SQL, a full scan of the centroids each round.
OP12_SQL = ",\n".join(
    [
        "WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        "k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 8))",
        *(",\n".join([_ROUND.format(i=i), _MOVE.format(i=i, j=i + 1)]) for i in range(ROUNDS)),
        _ROUND.format(i=ROUNDS),
    ]
) + f"""
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (id) JOIN k{ROUNDS} k ON k.c = b.c"""
