"""Runway score of assets: one projection, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, rules


def classified(assets: DataFrame) -> DataFrame:
    """Adds asset_kind, bits, cipher_mode, is_pqc, is_broken and safe_name."""
    a, k, p = F.col("algorithm"), F.col("key_size"), F.col("primitive_type")
    out = assets.withColumn("asset_kind", rules.asset_kind(a)).withColumn("cipher_mode", rules.cipher_mode(a))
    out = out.withColumn("bits", rules.kind_bits(F.col("asset_kind"), a, k))
    return out.withColumns(
        {
            "is_pqc": rules.is_post_quantum(F.col("asset_kind"), p, F.col("bits")),
            "is_broken": rules.is_broken(F.col("asset_kind"), F.col("bits"), F.col("cipher_mode")),
            "safe_name": rules.safe_name(a),
        }
    )


def scored(assets: DataFrame, year: int = fixed.CURRENT_YEAR, override_years: str | None = None) -> DataFrame:
    """Adds deadline, runway, risk level and score to classified assets.

    ``misuse`` and ``human_review`` are optional flags; ``override_years`` names
    a nullable column that replaces the tier's years and lifts review by tier.
    """
    if "asset_kind" not in assets.columns:
        assets = classified(assets)
    given: Column = F.col(override_years) if override_years else F.lit(None).cast("double")
    flag = F.coalesce(F.col("human_review"), F.lit(False)) if "human_review" in assets.columns else F.lit(False)
    misuse = F.coalesce(F.col("misuse"), F.lit(False)) if "misuse" in assets.columns else F.lit(False)
    review = rules.needs_review(F.col("algorithm"), F.col("x_tier"), flag)
    broken = ~review & (F.col("is_broken") | misuse)
    safe = F.col("is_pqc") | F.col("safe_name")
    by_kind = rules.deadline(F.col("asset_kind"), F.col("primitive_type"), F.col("is_broken"))
    first = assets.withColumns(
        {
            "z_regulatory_year": F.when(review, 2030).when(broken, 2026).when(safe, 2050).otherwise(by_kind["year"]).cast("int"),
            "z_regulatory_phase": F.when(review | broken | safe, 0).otherwise(by_kind["phase"]).cast("int"),
            "__x": F.coalesce(given, rules.lookup(F.col("x_tier"), fixed.TIER_YEARS, 5.0)),
            "agility_factor": rules.lookup(F.col("agility_level"), fixed.AGILITY_DISCOUNT, 0.0),
            "__intent": rules.lookup(F.col("intent_class"), fixed.INTENT_WEIGHT, 1.0),
            "__broken": broken,
            "__safe": safe,
            "__review": rules.needs_review(F.col("algorithm"), F.when(given.isNull(), F.col("x_tier")), flag),
        }
    )
    shred = F.coalesce(F.col("has_crypto_shredding"), F.lit(False)) & (F.col("__x") > 1.5)
    second = first.withColumn("crypto_shredding_viable", shred).withColumn("x_years_effective", F.when(shred, 1.5).otherwise(F.col("__x")))
    left = (F.col("z_regulatory_year") - year).cast("double")
    lead = F.when(F.col("primitive_type").isin("KEY_EXCHANGE", "SIGNATURE"), 2.0).otherwise(1.0)
    overdue = F.greatest(F.lit(0.0), F.col("x_years_effective") + lead - left)
    third = second.withColumn("__y", rules.two_places(left - F.col("x_years_effective"))).withColumn("r_q_score", rules.two_places(overdue * F.col("p_hndl") * (1 - F.col("agility_factor")) * F.col("__intent")))
    y = F.col("__y")
    level = (
        F.when(F.coalesce("__review", F.lit(False)), "MANUAL_REVIEW_REQUIRED")
        .when(F.col("__broken"), "CRITICAL")
        .when(F.col("__safe") | (F.col("__intent") == 0) | (F.col("p_hndl") == 0), "LOW")
        .when(y <= 1.0, "CRITICAL")
        .when(y <= 2.5, "HIGH")
        .when(y <= 4.5, "MEDIUM")
        .otherwise("LOW")
    )
    fourth = third.withColumn("risk_level", level)
    runway = F.when(F.col("risk_level").isin("LOW", "MANUAL_REVIEW_REQUIRED"), F.greatest(F.lit(0.0), y)).otherwise(y)
    out = fourth.withColumn("y_max_years", runway).withColumn("deadline_year", rules.two_places(F.col("y_max_years") + year))
    return out.drop("__x", "__y", "__intent", "__broken", "__safe", "__review")


def portfolio_items(scores: DataFrame, r0: str = "r0") -> DataFrame:
    """Adds delta_r, cost_dev_weeks and efficiency."""
    weight = rules.lookup(F.col("intent_class"), fixed.PORTFOLIO_INTENT, 1.0)
    nothing = F.col("safe_name") | (weight == 0) | (F.col("p_hndl") <= 0)
    gain = rules.two_places(F.col(r0) * F.col("p_hndl") * weight * rules.lookup(F.col("risk_level"), fixed.RISK_WEIGHT, 2.0))
    fan = 1.0 + 0.15 * F.least(F.col(r0), F.lit(5))
    cost = rules.two_places(F.greatest(F.lit(0.2), rules.lookup(F.col("primitive_type"), fixed.BASE_WEEKS, 1.5) * fan * rules.lookup(F.col("agility_level"), fixed.EFFORT, 1.0)))
    out = scores.withColumn("delta_r", F.when(nothing, 0.0).otherwise(gain)).withColumn("cost_dev_weeks", F.when(nothing, 0.2).otherwise(cost))
    return out.withColumn("efficiency", F.round((F.col("delta_r") / F.col("cost_dev_weeks")).cast("decimal(18,6)"), 3).cast("double"))
