"""From findings of any scanner to assets of the estate: one projection and the weakness lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import lookups

#: Characters of the matched code that an asset keeps.
KEPT_CODE = 120


def asset_ids(ordered: DataFrame, prefix: str, at: str) -> DataFrame:
    """``asset_id`` by the place ``at`` (from 1): three digits at least, none cut."""
    n = F.col(at).cast("string")
    return ordered.withColumn("asset_id", F.concat(F.lit(f"{prefix}-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)))


def assets_of(findings: DataFrame, prefix: str = "ASSET") -> DataFrame:
    """Assets of findings (seq, component_name, algorithm, key_size, primitive_type, file_path, line_number, x_tier, has_crypto_shredding,
    evidence_level, evidence_source, matched_code, language, cwe, description).

    Intent from name and code, agility from code, scope from the path, and the
    weakness of the given one, the algorithm, the name or the description,
    whichever is known first; a given one that none knows is kept.
    """
    made = findings.withColumns(
        {
            "scope": F.when(rules.is_test_path(F.col("file_path")), "TEST_FIXTURE").otherwise("PRODUCTION"),
            "intent_class": rules.intent_of(F.col("component_name"), F.lit(""), F.col("matched_code"), F.col("primitive_type")),
            "agility_level": rules.agility_of(F.col("matched_code"), F.lit(""), F.col("algorithm")),
            "x_confidence": F.when(F.col("evidence_level") == "E0_UNCONFIRMED", "LOW").otherwise("HIGH"),
            "evidence_sources": F.array("evidence_source"),
        }
    )
    known = lookups.weakness_of(made, lookups.weaknesses(findings.sparkSession), ["cwe", "algorithm", "component_name", "description"])
    given = F.when(F.col("cwe") != "", F.when(F.col("cwe").startswith("CWE-"), F.col("cwe")).otherwise(F.concat(F.lit("CWE-"), "cwe")))
    title = F.when(given.isNotNull(), F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise("Cryptographic Weakness"))
    named = known.withColumn("cwe_name", F.when(F.col("cwe_id").isNotNull(), F.col("cwe_name")).otherwise(title)).withColumn("cwe_id", F.coalesce("cwe_id", given))
    out = named.withColumn("matched_code", F.substring("matched_code", 1, KEPT_CODE)).drop("evidence_source", "cwe")
    return asset_ids(out, prefix, "seq")
