"""Running totals of groups of any size, by a prefix scan.

Rows are sorted by group and order over all partitions, so that a large group is
spread over many. Each partition adds up its part of a group; the sums of the
parts before it, one row a group and partition, are the offset of a part; within
a part totals run as usual. No task holds more of a group than a partition does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .reach import Steps


def totals(df: DataFrame, by: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with ``rank`` (from 1) and, for each of ``sums``, ``so_far_<name>`` and ``all_<name>`` of its group; a null group is a group.

    The order must be total, else ties fall as the sort leaves them.
    """
    steps = Steps(df.sparkSession, "totals")
    given = df.withColumns({f"__{n}": c for n, c in sums.items()})
    placed = steps.write(given.orderBy(by, *order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "placed")
    parts = placed.groupBy(F.col(by).alias("__by"), F.col("__part").alias("__of")).agg(F.count("*").alias("__rows"), *[F.sum(f"__{n}").alias(f"__{n}_sum") for n in sums])
    before = W.partitionBy("__by").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        "__by", "__of", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
        *[F.coalesce(F.sum(f"__{n}_sum").over(before), F.lit(0)).alias(f"__{n}_before") for n in sums], *[F.sum(f"__{n}_sum").over(W.partitionBy("__by")).alias(f"all_{n}") for n in sums],
    )
    joined = placed.join(parts, (F.col("__part") == F.col("__of")) & F.col(by).eqNullSafe(F.col("__by")))
    here = W.partitionBy(by, "__part").orderBy("__at")
    so_far = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    told = joined.withColumns({"rank": F.col("__before") + F.row_number().over(here)} | {f"so_far_{n}": F.col(f"__{n}_before") + F.coalesce(F.sum(f"__{n}").over(so_far), F.lit(0)) for n in sums})
    return told.drop("__at", "__part", "__by", "__of", "__before", *[f"__{n}" for n in sums], *[f"__{n}_before" for n in sums])
