"""Aggregates over scored assets: counts, distributions with empty buckets, readiness, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed


def risk_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_level").agg(F.count("*").alias("assets"), F.min("y_max_years").alias("least_runway"))


def distribution(assets: DataFrame, column: str, domain: list) -> DataFrame:
    """Counts of every value of ``domain``, zero where none has it."""
    spark: SparkSession = assets.sparkSession
    dim = spark.createDataFrame([(v,) for v in domain], f"{column} {'int' if isinstance(domain[0], int) else 'string'}")
    counts = assets.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("assets"))


def category(algorithm: Column, pqc: Column) -> Column:
    """PQC, deprecated or classical, by the name."""
    old = algorithm.rlike("(?i)md5|sha-?1(?![0-9])|des|rc4|rsa-1024|ecb")
    return F.when(pqc, "PQC").when(old, "DEPRECATED").otherwise("CLASSICAL")


def summary_cube(scores: DataFrame) -> DataFrame:
    """Counts by risk, by scope, by both and in all: one pass over grouping sets."""
    cubed = scores.cube("risk_level", "scope").agg(F.count("*").alias("assets"), F.grouping_id().cast("int").alias("level"))
    return cubed.select(F.coalesce("risk_level", F.lit("*")).alias("risk_level"), F.coalesce("scope", F.lit("*")).alias("scope"), "level", "assets")


def readiness(scores: DataFrame, by: str) -> DataFrame:
    """Three readiness scores by project and in all (rollup)."""
    crit, high, broken = (F.count_if(c) for c in (F.col("risk_level") == "CRITICAL", F.col("risk_level") == "HIGH", F.col("is_broken")))
    out = scores.rollup(by).agg(F.count("*").alias("assets"), crit.alias("critical"), high.alias("high"), broken.alias("broken"))
    clamped = F.greatest(F.lit(5), F.least(F.lit(100), 100 - 12 * F.col("critical") - 6 * F.col("high") - 8 * F.col("broken")))
    share = F.round((100.0 * (F.col("assets") - F.col("critical")) / F.col("assets")).cast("decimal(18,6)"), 1).cast("double")
    return out.select(F.coalesce(by, F.lit("*")).alias(by), "assets", "critical", "high", "broken", clamped.cast("long").alias("clamped_score"), share.alias("share_score"))


def top_algorithms(assets: DataFrame, n: int = 5) -> DataFrame:
    return assets.groupBy("algorithm").agg(F.count("*").alias("assets")).orderBy(F.desc("assets"), "algorithm").limit(n)


def gate(scores: DataFrame, fail_on: str = "CRITICAL", max_allowed: int = 0) -> DataFrame:
    """One row: whether at most ``max_allowed`` production assets reach the severity."""
    items = [F.lit(x) for pair in fixed.SEVERITY.items() for x in pair]
    rank = F.coalesce(F.try_element_at(F.create_map(*items), F.col("risk_level")), F.lit(-1))
    out = scores.agg(F.count("*").alias("assets"), F.count_if(rank >= fixed.SEVERITY.get(fail_on.upper(), 3)).alias("violations"))
    passed = F.col("violations") <= max_allowed
    return out.select(F.lit(fail_on.upper()).alias("threshold"), "assets", "violations", passed.alias("passed"), F.when(passed, 0).otherwise(1).alias("exit_code"))


def backlog(scores: DataFrame, n: int) -> DataFrame:
    """The n assets of least runway; a top-k, so no total sort."""
    first = scores.orderBy("y_max_years", "asset_seq").limit(n)
    rank = F.row_number().over(W.orderBy("y_max_years", "asset_seq"))
    return first.select(rank.alias("rank"), "asset_id", "algorithm", "x_tier", "y_max_years", "z_regulatory_year", "risk_level")


def negative_proof(scores: DataFrame) -> DataFrame:
    """One row of assertions: forbidden algorithms, asymmetric assets without a target."""
    name = F.upper("algorithm")
    hits = F.filter(F.array(*[F.lit(x) for x in fixed.FORBIDDEN]), lambda f: F.contains(name, f))
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_set(hits))))
    out = scores.agg(found.alias("found"), F.count("*").alias("assets"), F.count_if(F.col("primitive_type").isin("KEY_EXCHANGE", "SIGNATURE")).alias("asymmetric"))
    return out.select(F.concat_ws(",", "found").alias("forbidden_found"), (F.size("found") == 0).alias("claim_legacy"), "assets", "asymmetric")


def confusion(pairs: DataFrame, expected: str, detected: str, by: list[str]) -> DataFrame:
    """Confusion matrix and ratios by each column of ``by`` and in all (grouping sets)."""
    e, d = F.col(expected), F.col(detected)
    sets = [[F.col(c)] for c in by] + [[]]
    grouped = pairs.groupingSets(sets, *[F.col(c) for c in by]).agg(
        F.count_if(e & d).alias("tp"), F.count_if(~e & d).alias("fp"), F.count_if(~e & ~d).alias("tn"), F.count_if(e & ~d).alias("fn"), F.grouping_id().cast("int").alias("level")
    )
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")).cast("decimal(18,6)"), 4).cast("double")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return grouped.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("*")).alias(c) for c in by], "level", "tp", "fp", "tn", "fn",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
    )
