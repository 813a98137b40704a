"""The estate of cryptographic assets that the driver's tables stand for.

``part`` rows become assets by fixed arrays indexed with their keys; the same
derivation is written out in SQL, so that each query has an equivalent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

ALGORITHMS = [
    ("RSA-2048", 2048, "SIGNATURE"), ("RSA-1024", 1024, "KEY_EXCHANGE"), ("ECDSA-P256", 256, "SIGNATURE"), ("ECDH-P384", 384, "KEY_EXCHANGE"), ("ED25519", None, "SIGNATURE"),
    ("AES-256-GCM", 256, "ENCRYPTION"), ("AES-128-CBC", 128, "ENCRYPTION"), ("AES", 256, "SYMMETRIC_CIPHER"), ("AES-ECB", 128, "ENCRYPTION"), ("3DES", 64, "ENCRYPTION"),
    ("SHA-256", 256, "HASH"), ("SHA-1", 160, "HASH"), ("MD5", 128, "HASH"), ("ML-KEM-768", None, "KEY_EXCHANGE"), ("ML-DSA-87", None, "SIGNATURE"),
    ("KYBER512", None, "KEY_EXCHANGE"), ("SLH-DSA-128S", 32, "SIGNATURE"), ("DSA", 1024, "SIGNATURE"), ("DIFFIEHELLMAN", 3072, "KEY_EXCHANGE"), ("CHACHA20-POLY1305", 256, "ENCRYPTION"),
    ("DYNAMIC_UNRESOLVED", None, "ENCRYPTION"), ("IDEA", 128, "ENCRYPTION"), ("HMAC-SHA512", 512, "HASH"), ("PBKDF2", None, "KEY_EXCHANGE"),
]
TIERS = ["EPHEMERAL", "SHORT_TERM", "OPERATIONAL", "ARCHIVAL", "HUMAN_REVIEW", "TRANSIENT"]
PROFILES = [("PUBLIC", 1.0), ("INTERNAL", 0.05), ("AIRGAPPED", 0.0)]
INTENTS = ["OPERATIONAL_UTILITY", "INTEGRITY_CHECKSUM", "AUTHENTICATION_SIGNATURE", "CONFIDENTIALITY_ENVELOPE", "AUTHENTICATION_HANDSHAKE", "CONFIDENTIALITY_IN_TRANSIT"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    dim = spark.createDataFrame([(i, *a) for i, a in enumerate(ALGORITHMS)], "ai long, algorithm string, key_size int, primitive_type string")  # fixed rows
    p = p.withColumn("ai", F.pmod(k * 7 + size, F.lit(len(ALGORITHMS))).cast("long")).join(F.broadcast(dim), "ai")
    folder = F.when(k % 7 == 0, "tests/").otherwise("src/")
    path = F.concat(F.lit("svc"), (k % 40).cast("string"), F.lit("/"), folder, F.lit("mod_"), (k % 300).cast("string"), F.lit(".py"))
    out = p.select(
        k.alias("asset_seq"),
        F.concat(F.lit("ASSET-"), F.when(k < 1000, F.lpad(k.cast("string"), 3, "0")).otherwise(k.cast("string"))).alias("asset_id"),
        F.concat_ws(":", F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("x")).alias("component_name"),
        "algorithm",
        "key_size",
        "primitive_type",
        path.alias("file_path"),
        (k % 500 + 1).cast("int").alias("line_number"),
        pick(TIERS, size % 6).alias("x_tier"),
        (k % 5 == 0).alias("has_crypto_shredding"),
        pick(INTENTS, (k + size) % 6).alias("intent_class"),
        (size % 6).cast("int").alias("agility_level"),
        pick([a for a, _ in PROFILES], F.floor(k / 3) % 3).alias("exposure_profile"),
        pick([b for _, b in PROFILES], F.floor(k / 3) % 3).alias("p_hndl"),
        (k % 97 == 0).alias("misuse"),
        (k % 89 == 0).alias("human_review"),
        F.col("p_brand").alias("portfolio"),
    )
    return out.withColumn("scope", F.when(rules.is_test_path(F.col("file_path")), "TEST_FIXTURE").otherwise("PRODUCTION"))


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


ASSETS_SQL = f"""
assets AS (
  SELECT p_partkey AS asset_seq, 'ASSET-' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END AS asset_id,
         lower(replace(p_name, ' ', '_')) || ':x' AS component_name,
         {_list(a for a, _, _ in ALGORITHMS)}[ai + 1] AS algorithm, CAST({_list(b for _, b, _ in ALGORITHMS)}[ai + 1] AS INTEGER) AS key_size, {_list(c for _, _, c in ALGORITHMS)}[ai + 1] AS primitive_type,
         'svc' || (p_partkey % 40) || '/' || CASE WHEN p_partkey % 7 = 0 THEN 'tests/' ELSE 'src/' END || 'mod_' || (p_partkey % 300) || '.py' AS file_path,
         CAST(p_partkey % 500 + 1 AS INTEGER) AS line_number, {_list(TIERS)}[p_size % 6 + 1] AS x_tier, p_partkey % 5 = 0 AS has_crypto_shredding,
         {_list(INTENTS)}[(p_partkey + p_size) % 6 + 1] AS intent_class, CAST(p_size % 6 AS INTEGER) AS agility_level,
         {_list(a for a, _ in PROFILES)}[(p_partkey // 3) % 3 + 1] AS exposure_profile, CAST({_list(b for _, b in PROFILES)}[(p_partkey // 3) % 3 + 1] AS DOUBLE) AS p_hndl,
         p_partkey % 97 = 0 AS misuse, p_partkey % 89 = 0 AS human_review, p_brand AS portfolio, CASE WHEN p_partkey % 7 = 0 THEN 'TEST_FIXTURE' ELSE 'PRODUCTION' END AS scope
  FROM (SELECT *, (p_partkey * 7 + p_size) % {len(ALGORITHMS)} AS ai FROM part)
)"""

CLASSIFIED_SQL = (
    ASSETS_SQL
    + """, kinds AS (
  SELECT *, upper(algorithm) AS u,
    CASE WHEN regexp_matches(upper(algorithm), 'ML-DSA|DILITHIUM|ML-KEM|KYBER|SLH-DSA|SPHINCS|FALCON|LWE|PQC') THEN 'POST_QUANTUM'
         WHEN regexp_matches(upper(algorithm), 'ECDSA|ECDH|ED25519|ED448|X25519|X448|RISTRETTO|SECP|CURVE25519') THEN 'ELLIPTIC_CURVE'
         WHEN regexp_matches(upper(algorithm), 'RSA|DH|DIFFIEHELLMAN|^DSA$|^DSA-') THEN 'CLASSICAL_ASYMMETRIC'
         WHEN regexp_matches(upper(algorithm), 'AES|DES|CHACHA|BLOWFISH|RC4|SHA|MD5|HMAC|ARGON|PBKDF|BCRYPT|SCRYPT') THEN 'SYMMETRIC' ELSE 'OPAQUE' END AS asset_kind,
    CASE WHEN upper(algorithm) LIKE '%ECB%' THEN 'ECB' WHEN upper(algorithm) LIKE '%CBC%' THEN 'CBC' ELSE 'GCM' END AS cipher_mode FROM assets
), sized AS (
  SELECT *, CAST(CASE asset_kind
    WHEN 'ELLIPTIC_CURVE' THEN CASE WHEN key_size IN (224, 256, 384, 521) THEN key_size WHEN u LIKE '%384%' THEN 384 WHEN u LIKE '%521%' THEN 521 ELSE 256 END
    WHEN 'CLASSICAL_ASYMMETRIC' THEN CASE WHEN key_size >= 512 THEN key_size WHEN u LIKE '%1024%' THEN 1024 WHEN u LIKE '%4096%' THEN 4096 ELSE 2048 END
    WHEN 'SYMMETRIC' THEN CASE WHEN coalesce(key_size, 0) <> 0 THEN key_size WHEN u LIKE '%128%' THEN 128 WHEN u LIKE '%192%' THEN 192 WHEN u LIKE '%512%' THEN 512 ELSE 256 END END AS INTEGER) AS bits FROM kinds
), classified AS (
  SELECT *, CASE WHEN asset_kind = 'POST_QUANTUM' THEN true WHEN asset_kind = 'SYMMETRIC' AND primitive_type IN ('ENCRYPTION', 'KEY_EXCHANGE', 'HASH') THEN bits >= 256 ELSE false END AS is_pqc,
    CASE asset_kind WHEN 'CLASSICAL_ASYMMETRIC' THEN bits < 2048 WHEN 'ELLIPTIC_CURVE' THEN bits < 224 WHEN 'SYMMETRIC' THEN cipher_mode = 'ECB' OR bits < 112 ELSE false END AS is_broken,
    regexp_matches(u, 'ML-DSA|ML-KEM|DILITHIUM|KYBER|SLH-DSA|FALCON|LWE|SPHINCS|POST-QUANTUM|PQC|LIBOQS|AES-256|SECRET-TOKEN|CHACHA20|SHA-256|SHA-384|SHA-512|SHA256|SHA3|BLAKE|RISTRETTO|PEDERSEN|SECURE-PRNG|CSPRNG|PBKDF2|HOSTNAME-VERIFIER|SECURE-RANDOM') AS safe_name
  FROM sized
)"""
)

SCORED_SQL = (
    CLASSIFIED_SQL
    + """, flags AS (
  SELECT *, u = 'DYNAMIC_UNRESOLVED' OR x_tier = 'HUMAN_REVIEW' OR human_review AS review FROM classified
), zyear AS (
  SELECT *, NOT review AND (is_broken OR misuse) AS brk, is_pqc OR safe_name AS safe,
    CASE x_tier WHEN 'EPHEMERAL' THEN 0.0 WHEN 'TRANSIENT' THEN 0.0 WHEN 'SHORT_TERM' THEN 1.5 WHEN 'ARCHIVAL' THEN 10.0 ELSE 5.0 END::DOUBLE AS x0,
    [0.0, 0.3, 0.6, 0.85, 0.9, 0.95][agility_level + 1]::DOUBLE AS agility_factor,
    CASE intent_class WHEN 'OPERATIONAL_UTILITY' THEN 0.0 WHEN 'INTEGRITY_CHECKSUM' THEN 0.2 WHEN 'AUTHENTICATION_SIGNATURE' THEN 0.9 WHEN 'AUTHENTICATION_HANDSHAKE' THEN 0.9 ELSE 1.0 END::DOUBLE AS iw,
    asset_kind IN ('CLASSICAL_ASYMMETRIC', 'ELLIPTIC_CURVE') AS asym FROM flags
), runway AS (
  SELECT *, CAST(CASE WHEN review THEN 2030 WHEN brk THEN 2026 WHEN safe THEN 2050 WHEN asset_kind = 'POST_QUANTUM' THEN 2050 WHEN is_broken OR asset_kind = 'OPAQUE' THEN 2026
      WHEN asym AND primitive_type = 'SIGNATURE' THEN 2031 WHEN asym THEN 2030 ELSE 2050 END AS INTEGER) AS z_regulatory_year,
    CAST(CASE WHEN review OR brk OR safe OR is_broken OR NOT asym THEN 0 WHEN primitive_type = 'SIGNATURE' THEN 4 ELSE 3 END AS INTEGER) AS z_regulatory_phase,
    has_crypto_shredding AND x0 > 1.5 AS crypto_shredding_viable, CASE WHEN has_crypto_shredding AND x0 > 1.5 THEN 1.5 ELSE x0 END::DOUBLE AS x_years_effective FROM zyear
), ys AS (
  SELECT *, round(CAST(z_regulatory_year - 2026 - x_years_effective AS DECIMAL(18,6)), 2)::DOUBLE AS y0,
    round(CAST(greatest(0.0, x_years_effective + CASE WHEN primitive_type IN ('KEY_EXCHANGE', 'SIGNATURE') THEN 2.0 ELSE 1.0 END - (z_regulatory_year - 2026)::DOUBLE) * p_hndl * (1 - agility_factor) * iw AS DECIMAL(18,6)), 2)::DOUBLE AS r_q_score FROM runway
), levels AS (
  SELECT *, CASE WHEN review THEN 'MANUAL_REVIEW_REQUIRED' WHEN brk THEN 'CRITICAL' WHEN safe OR iw = 0 OR p_hndl = 0 THEN 'LOW' WHEN y0 <= 1.0 THEN 'CRITICAL' WHEN y0 <= 2.5 THEN 'HIGH' WHEN y0 <= 4.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM ys
), scored0 AS (
  SELECT *, CASE WHEN risk_level IN ('LOW', 'MANUAL_REVIEW_REQUIRED') THEN greatest(0.0, y0) ELSE y0 END::DOUBLE AS y_max_years FROM levels
), scored AS (SELECT *, round(CAST(y_max_years + 2026 AS DECIMAL(18,6)), 2)::DOUBLE AS deadline_year FROM scored0)"""
)

ITEMS_SQL = (
    SCORED_SQL
    + """, w AS (
  SELECT *, CAST(asset_seq % 8 + 1 AS BIGINT) AS r0, CASE intent_class WHEN 'OPERATIONAL_UTILITY' THEN 0.0 WHEN 'INTEGRITY_CHECKSUM' THEN 0.3 ELSE 1.0 END::DOUBLE AS pw,
    CASE risk_level WHEN 'CRITICAL' THEN 10.0 WHEN 'HIGH' THEN 5.0 WHEN 'MEDIUM' THEN 2.0 WHEN 'LOW' THEN 0.5 ELSE 2.0 END::DOUBLE AS rw,
    CASE primitive_type WHEN 'KEY_EXCHANGE' THEN 2.0 WHEN 'SIGNATURE' THEN 2.0 WHEN 'HASH' THEN 0.5 ELSE 1.5 END::DOUBLE AS bw,
    CASE agility_level WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.15 ELSE 1.0 END::DOUBLE AS ew FROM scored
), w2 AS (
  SELECT *, CASE WHEN safe_name OR pw = 0 OR p_hndl <= 0 THEN 0.0 ELSE round(CAST(r0 * p_hndl * pw * rw AS DECIMAL(18,6)), 2)::DOUBLE END::DOUBLE AS delta_r,
    CASE WHEN safe_name OR pw = 0 OR p_hndl <= 0 THEN 0.2 ELSE round(CAST(greatest(0.2, bw * (1.0 + 0.15::DOUBLE * least(r0, 5)) * ew) AS DECIMAL(18,6)), 2)::DOUBLE END::DOUBLE AS cost_dev_weeks FROM w
), items AS (SELECT *, round(CAST(delta_r / cost_dev_weeks AS DECIMAL(18,6)), 3)::DOUBLE AS efficiency FROM w2)"""
)
