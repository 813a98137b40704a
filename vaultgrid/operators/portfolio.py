"""Migration portfolios: running totals, efficient frontier, exact and greedy knapsacks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .reach import Steps
from .running import totals


def _order(seq: str):
    return [F.desc("efficiency"), F.desc("delta_r"), F.asc("cost_dev_weeks"), F.asc(seq)]


def running(items: DataFrame, by: str, seq: str = "asset_seq") -> DataFrame:
    """Rank, cumulative weeks and cumulative share of risk in each portfolio, best first."""
    gain = F.col("delta_r").cast("decimal(18,2)")
    cost = F.when(F.col("delta_r") > 0, F.col("cost_dev_weeks").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    told = totals(items, by, _order(seq), {"gain": gain, "cost": cost})
    total = F.col("all_gain")
    share = F.when(total > 0, F.round((F.col("so_far_gain").cast("double") / total.cast("double") * 100).cast("decimal(18,6)"), 1)).otherwise(F.lit(100).cast("decimal(18,1)"))
    told = told.withColumns({"rank": F.col("rank").cast("int"), "cumulative_weeks": F.col("so_far_cost").cast("double"), "cumulative_pct": share.cast("double")})
    return told.drop("so_far_gain", "so_far_cost", "all_gain", "all_cost")


def frontier(items: DataFrame, by: str, seq: str = "asset_seq") -> DataFrame:
    """Points of the efficient frontier, from an origin in each portfolio."""
    # what gains nothing sorts last, so it can go after the running totals
    points = running(items, by, seq).where("delta_r > 0").select(by, F.col("rank").alias("point"), F.col("cumulative_weeks").alias("cost"), F.least("cumulative_pct", F.lit(100.0)).alias("risk_pct"), "asset_id")
    origin = items.select(by).distinct().select(by, F.lit(0).alias("point"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("risk_pct"), F.lit("origin").alias("asset_id"))
    return points.unionByName(origin)


def knapsack(weight: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Which items an optimal 0/1 knapsack takes; an item is taken only if it is strictly better."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(weight), capacity + 1), bool)
    for i, (w, v) in enumerate(zip(weight.tolist(), value.tolist())):
        if w <= capacity:
            with_it = best[: capacity + 1 - w] + v
            better = with_it > best[w:]
            took[i, w:] = better
            best[w:] = np.where(better, with_it, best[w:])
    chosen, c = np.zeros(len(weight), bool), capacity
    for i in range(len(weight) - 1, -1, -1):
        if took[i, c]:
            chosen[i] = True
            c -= int(weight[i])
    return chosen


def measured(items: DataFrame, *columns: str) -> DataFrame:
    """These columns, written and read again: the optimizer need not carry the expressions of the measures through every step after them."""
    return Steps(items.sparkSession, "items").write(items.select(*columns))


def contenders(items: DataFrame, by: str, grid: int, seq: str) -> DataFrame:
    """Items that a knapsack of ``grid`` hundredths can take: of each weight, the first in order that fit together.

    Any later item of a weight could be exchanged for one of these at no loss, so
    neither the exact nor the greedy choice ever takes it. What is left of a
    portfolio is at most about ``grid * ln(grid)`` items, however many it has.
    """
    ranked = items.where("delta_r > 0")
    at = F.row_number().over(W.partitionBy(by, "cost_dev_weeks").orderBy(*_order(seq)))
    weight = F.greatest(F.lit(1), F.round(F.col("cost_dev_weeks") * 100).cast("long"))
    return ranked.withColumn("__n", at).where(F.col("__n") <= grid).where(F.col("__n") * weight <= grid).drop("__n")


def optimal(items: DataFrame, by: str, budget: float, seq: str = "asset_seq") -> DataFrame:
    """Adds is_selected: the exact optimum of each portfolio on a grid of 0.01 weeks."""
    grid = max(0, round(budget * 100))
    kinds = {f.name: f for f in items.schema.fields}
    schema = T.StructType([kinds[by], kinds[seq]])

    def solve(t: pa.Table) -> pa.Table:
        value, cost = t["delta_r"].to_numpy(), t["cost_dev_weeks"].to_numpy()
        order = np.lexsort((t[seq].to_numpy(), cost, -value, -t["efficiency"].to_numpy()))
        live = order[value[order] > 0]
        out = np.zeros(len(value), bool)
        if len(live) and grid:
            out[live] = knapsack(np.maximum(1, np.rint(cost[live] * 100).astype(np.int64)), value[live], grid)
        return t.select([by, seq]).filter(pa.array(out))

    live = contenders(measured(items, by, seq, "delta_r", "cost_dev_weeks", "efficiency"), by, grid, seq)
    taken = live.groupBy(by).applyInArrow(solve, schema).select(F.col(by).alias("__by"), F.col(seq).alias("__seq"))
    return items.join(taken, (F.col(by) == F.col("__by")) & (F.col(seq) == F.col("__seq")), "left").withColumn("is_selected", F.col("__seq").isNotNull()).drop("__by", "__seq")


def greedy(items: DataFrame, by: str, budget: float, seq: str = "asset_seq") -> DataFrame:
    """Best first, skipping what no longer fits: a fold over each portfolio's ordered items."""
    row = F.struct((-F.col("efficiency")).alias("e"), (-F.col("delta_r")).alias("d"), F.col("cost_dev_weeks").alias("c"), F.col(seq).alias("s"), F.col("asset_id").alias("id"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("delta_r") > 0, row)))
    cents = lambda x: F.round(x["c"] * 100).cast("long")
    fold = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<string>").alias("ids")),
        lambda acc, x: F.when(acc["spent"] + cents(x) <= round(budget * 100), F.struct((acc["spent"] + cents(x)).alias("spent"), F.array_append(acc["ids"], x["id"]).alias("ids"))).otherwise(acc),
    )
    items = measured(items, by, seq, "asset_id", "delta_r", "cost_dev_weeks", "efficiency")
    made = contenders(items, by, round(budget * 100), seq).groupBy(F.col(by).alias("__by")).agg(fold.alias("f"))
    out = items.select(by).distinct().join(made, F.col(by) == F.col("__by"), "left")
    nothing = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<string>").alias("ids"))
    return out.withColumn("f", F.coalesce("f", nothing)).select(by, (F.col("f.spent") / 100).alias("weeks"), F.size("f.ids").cast("long").alias("selected"), F.array_join("f.ids", ",").alias("asset_ids"))
