"""What the training-data operators share: table access, scratch tables, word rules.

Scratch tables are Parquet under the folder that the cluster names in
``spark.checkpoint.dir``; they cut lineage and survive lost executors.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a contract speaks of words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only on a local master where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vaultgrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written once and read back, removed when the driver ends or on ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


#: Rows of an Arrow batch: texts of a few kilobytes, and some that are far longer.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, so that a worker and its JVM hold a few megabytes of text at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def lean(run, *caches):
    """``run`` over a task's batches; at the task's end caches are emptied and free memory goes back to the system.

    Python workers outlive their tasks, and what one stage leaves in them would add to the next one's.
    """

    def out(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            for c in caches:
                c.clear()
            getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)  # glibc's alone

    return out


def known_in(df: DataFrame, keys: DataFrame, on: str, rows: int, bound: int = 1 << 20) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (unique): a broadcast only if the counted rows are within ``bound``, else a shuffled join."""
    return df.join(F.broadcast(keys) if rows <= bound else keys, on)


def hashed_sample(df: DataFrame, key: Column, order: list, most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest hashes ``key``; a threshold from the count first, so that no task gets ``most`` rows of each partition."""
    n = df.count()
    if n > 2 * most:
        df = df.where(F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * 1.5 * most / n) + 1)
        key = F.pmod(key, F.lit(1 << 30))
    return df.orderBy(key, *order).limit(most)


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, also when it is used many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def attach(df: DataFrame, small: DataFrame, key: str, rows: int, bound: int = 100_000) -> DataFrame:
    """``small`` (unique ``key``, nulls match) joined to ``df`` from the left.

    Broadcast only if its counted ``rows`` are within ``bound``; else a shuffled
    join over salted keys, so that one key with a third of the rows is dealt out.
    """
    if rows <= bound:
        right = F.broadcast(small.withColumnRenamed(key, "__key"))
        return df.join(right, df[key].eqNullSafe(right["__key"]), "left").drop("__key")
    salts = 64
    left = df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(salts)))
    right = small.withColumnRenamed(key, "__key").withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("__salt2", F.col("__salt2").cast("long"))
    return left.join(right, left[key].eqNullSafe(right["__key"]) & (left["__salt"] == right["__salt2"]), "left").drop("__key", "__salt", "__salt2")


def ranked(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0) in a total order, without one task that holds all rows.

    Range-sorted, written with each row's place in its partition, then shifted by
    the sizes of the partitions before it (one number per partition on the driver).
    """
    placed = scratch.write(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())
    before, offsets = 0, [(-1, 0)]
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    shift = placed.sparkSession.createDataFrame(offsets, "__p long, __before long")
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(shift), part == F.col("__p")).withColumn("rank", rank).drop("__at", "__p", "__before")
