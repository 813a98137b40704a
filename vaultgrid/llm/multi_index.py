"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes. Principal axes and an ITQ rotation are fitted on a bounded sample (the
``SAMPLE`` rows with the smallest hashes); the signs of a rotated vector are its
code, of up to 64 bits. Every row is indexed.

Index. Rows are dealt by hash into shards of bounded size. A shard splits each
code into ``PARTS`` substrings and keeps one table for each: substring value to
rows. Codes within Hamming distance r agree in some substring up to ``r //
PARTS`` bits, so probing all values that near in every table finds every code
within r, which are then compared whole and reranked by Euclidean distance.

Radius. On the sample, the radius within which ``COVER`` of the true neighbours
lie is measured; neighbours in all rows are nearer than those in a sample, so it
errs on the safe side. A shard that finds fewer than k codes within the radius
widens it until it has k or all its rows.

Each shard sees the queries in blocks (a stated query set against all rows); a
query's best k of each shard are merged by a ranked window.

Left out, as queries and as candidates: vectors that are null, zero, of another
length than the sample's commonest, or hold null or non-finite components.
Repeated rows are candidates of each other; a null id never is a query and ranks
last among ties; ids are whole numbers, and what is no number fails or is null as the session's casts say. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, hashed_sample, table

SAMPLE, SAMPLE_QUERIES = 8192, 256
BITS, PARTS, TURNS = 64, 4, 40
COVER = 0.97
#: Rows of a shard, and queries of a block, at most (about).
SHARD, BLOCK = 32_768, 32_768

_POPCOUNT16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


class Coder:
    def __init__(self, x: np.ndarray):
        self.mean = x.mean(0)
        bits = min(BITS, x.shape[1])
        _, _, axes = np.linalg.svd(x - self.mean, full_matrices=False)
        axes = axes[:bits].T
        v = (x - self.mean) @ axes
        rotation = np.linalg.qr(np.random.default_rng(0).normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(TURNS):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        self.turn = axes @ rotation

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The substrings of the codes, 16 bits each."""
        signs = ((x - self.mean) @ self.turn) >= 0
        padded = np.zeros((len(x), BITS), bool)
        padded[:, : signs.shape[1]] = signs
        return np.packbits(padded, axis=1).view(">u2").astype(np.uint16)


def distance(parts: np.ndarray, query: np.ndarray) -> np.ndarray:
    return _POPCOUNT16[parts ^ query].sum(-1, dtype=np.int64)


def radius_of(coder: Coder, x: np.ndarray, k: int, cover: float = COVER) -> int:
    parts = coder.parts(x)
    found = []
    for i in range(min(SAMPLE_QUERIES, len(x))):
        d = np.square(x - x[i]).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else []
        found += distance(parts[near], parts[i]).tolist()
    return int(np.quantile(found, cover, method="higher")) if found else BITS


class Shard:
    def __init__(self, x: np.ndarray, parts: np.ndarray):
        self.x, self.parts = x, parts
        self.tables = []
        for t in range(PARTS):
            order = np.argsort(parts[:, t], kind="stable")
            values, first = np.unique(parts[order, t], return_index=True)
            self.tables.append((values, first, np.append(first[1:], len(order)), order))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within the radius: pigeonhole probes, then whole codes."""
        hit = np.zeros(len(self.x), bool)
        for t, (values, first, last, order) in enumerate(self.tables):
            near = _POPCOUNT16[values ^ query[t]] <= radius // PARTS
            a, n = first[near], last[near] - first[near]
            # the rows of all probed buckets, end to end
            hit[order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(hit)
        return rows[distance(self.parts[rows], query) <= radius]

    def nearest(self, q: np.ndarray, query: np.ndarray, radius: int, k: int, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        while True:
            rows = self.within(query, radius)
            rows = rows[own[rows]]
            if len(rows) >= k or radius >= BITS:
                break
            radius += 4
        score = np.sqrt(np.square(self.x[rows] - q).sum(1))
        order = np.lexsort((ids[rows], score))[:k]
        return rows[order], score[order]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _searched(shared, k: int):
    def run(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        coder, radius = shared.value
        out: list[list] = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            x, q = _matrix(rows["vec"]), _matrix(queries["vec"])
            shard, codes = Shard(x, coder.parts(x)), coder.parts(q)
            at = rows["row"].to_numpy()
            ids = np.array([np.iinfo(np.int64).max if v is None else v for v in rows["id"].to_pylist()], np.int64)
            for i, (row, query_id) in enumerate(zip(queries["row"].to_pylist(), queries["id"].to_pylist())):
                best, score = shard.nearest(q[i], codes[i], radius, k, at != row, ids)
                out[0] += [row] * len(best)
                out[1] += [query_id] * len(best)
                out[2] += [rows["id"][int(b)].as_py() for b in best]
                out[3] += score.tolist()
        return pa.table({"query_row": pa.array(out[0], pa.int64()), "query_id": pa.array(out[1], pa.int64()), "vec_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})

    return run


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    given = vectors.withColumn("__q", F.coalesce(is_query, F.lit(False))).where(usable(F.col(vec_col)))
    given = given.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col("__q").alias("q"), F.monotonically_increasing_id().alias("row"))
    given = scratch.write(given, "given")
    sample = hashed_sample(given, F.xxhash64("id", "vec"), ["row"], SAMPLE).select("vec").toArrow()
    lengths = Counter(sample["vec"].combine_chunks().value_lengths().to_pylist() if sample.num_rows else [])
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = max(lengths, key=lambda n: (lengths[n], n))
    x = np.array([v for v in sample["vec"].to_pylist() if len(v) == width], np.float64)
    coder = Coder(x)
    shared = spark.sparkContext.broadcast((coder, radius_of(coder, x, k)))
    given = given.where(F.size("vec") == width)
    n, nq = given.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(-(-n // shard), min(16, -(-n // 1024)), 1), max(-(-nq // block), 1)
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    rows = given.select("id", "vec", "row", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("s")).withColumn("b", every(blocks))
    asked = given.where("q").select("id", "vec", "row", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("b")).withColumn("s", every(shards))
    found = rows.groupBy("s", "b").cogroup(asked.groupBy("s", "b")).applyInArrow(_searched(shared, k), "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
