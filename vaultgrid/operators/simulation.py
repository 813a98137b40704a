"""Breach probability by simulation.

All assets share one seed, so a result depends on four numbers only: distinct
tuples are simulated once, in an Arrow UDF, and joined back.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

RESULT = "breach double, p50 double, p95 double, var_year int"


def quantile(ordered: list[float], p: float) -> float:
    """Linear interpolation between the nearest ranks."""
    at = (len(ordered) - 1) * p
    low = math.floor(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] * (1 - (at - low)) + ordered[high] * (at - low) if at > low else ordered[low]


def simulate(x: float, y: float, z: float, p: float, trials: int, seed: int, year: int) -> tuple[float, float, float, int]:
    rng = random.Random(seed)
    mode = min(fixed.ARRIVAL_MODE, z)
    margins, exposed, breaches = [], [], 0
    for _ in range(trials):
        arrival = rng.triangular(fixed.ARRIVAL_FIRST, fixed.ARRIVAL_LAST, mode)
        secret = rng.uniform(0.80 * x, 1.25 * x)
        until = year + secret + rng.triangular(0.70 * y, 1.50 * y, y)
        exposed.append(until)
        margins.append(arrival - until)
        breaches += until > arrival
    margins.sort()
    exposed.sort()
    return round(breaches / trials * p, 3), round(quantile(margins, 0.5), 2), round(quantile(margins, 0.05), 2), int(round(quantile(exposed, 0.95)))


def stochastic(scores: DataFrame, trials: int = 5000, seed: int = 42, year: int = fixed.CURRENT_YEAR) -> DataFrame:
    """Adds breach, p50, p95, var_year and risk_category to scored assets."""

    @F.pandas_udf(RESULT)
    def draw(x: pd.Series, y: pd.Series, z: pd.Series, p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([simulate(*t, trials, seed, year) for t in zip(x, y, z, p)], columns=["breach", "p50", "p95", "var_year"])

    lead = F.when(F.col("primitive_type").isin("KEY_EXCHANGE", "SIGNATURE"), 2.0).otherwise(1.0)
    keyed = scores.withColumn("__t", F.struct(F.greatest(F.lit(0.1), "x_years_effective").alias("x"), lead.alias("y"), F.col("z_regulatory_year").cast("double").alias("z"), F.col("p_hndl").alias("p")))
    calm = F.when(F.col("safe_name"), 1).when(F.col("intent_class") == "OPERATIONAL_UTILITY", 2).when(F.col("p_hndl") <= 0, 3)
    keyed = keyed.withColumn("__calm", calm)
    tuples = keyed.where(F.col("__calm").isNull()).select("__t").distinct()
    drawn = tuples.select(F.col("__t").alias("__k"), draw("__t.x", "__t.y", "__t.z", "__t.p").alias("__r"))
    out = keyed.join(drawn, (keyed["__t"] == drawn["__k"]) & keyed["__calm"].isNull(), "left")
    flat = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("__calm"))
    out = out.withColumns(
        {
            "breach": F.coalesce("__r.breach", F.lit(0.0)),
            "p50": F.coalesce("__r.p50", flat([25.0, 30.0, 20.0])),
            "p95": F.coalesce("__r.p95", flat([20.0, 25.0, 15.0])),
            "var_year": F.coalesce("__r.var_year", F.lit(2050)),
        }
    )
    category = F.when(F.col("__calm").isNotNull(), "LOW").when((F.col("breach") >= 0.5) | (F.col("p95") <= 0), "CRITICAL").when((F.col("breach") >= 0.2) | (F.col("p95") <= 2.0), "HIGH").when(F.col("breach") >= 0.05, "MEDIUM").otherwise("LOW")
    return out.withColumn("risk_category", category).drop("__t", "__k", "__r", "__calm")


def estate(results: DataFrame) -> DataFrame:
    """One row: mean over positive probabilities, maximum, counts by category."""
    mean = F.round(F.coalesce(F.avg(F.when(F.col("breach") > 0, F.col("breach"))), F.lit(0.0)).cast("decimal(18,6)"), 3).cast("double")
    return results.agg(F.count("*").alias("assets"), mean.alias("mean_breach"), F.max("breach").alias("max_breach"), F.count_if(F.col("risk_category") == "CRITICAL").alias("critical"), F.count_if(F.col("risk_category") == "HIGH").alias("high"))


def overridden(scores: DataFrame, simulated: DataFrame) -> DataFrame:
    """Scores with ``risk``: the simulated category where there is one, else the level by rule."""
    sim = simulated.select(F.col("asset_id").alias("__id"), "risk_category")
    return scores.join(sim, F.col("asset_id") == F.col("__id"), "left").drop("__id").withColumn("risk", F.upper(F.coalesce("risk_category", "risk_level")))
