"""Migration targets, report rules, handshake classes and dependency status: row-wise ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, rules

# --- fixed values: names that are broken or misused
BROKEN_NAMES = [
    "DES", "3DES", "DESEDE", "RC4", "ARCFOUR", "RC2", "RC5", "BLOWFISH", "IDEA", "MD5", "MD4", "MD2", "SHA-1", "SHA1", "HMAC-MD5", "HMAC-SHA1", "ECB", "STATIC-IV", "PREDICTABLE-KEY",
    "STATIC-SALT", "PREDICTABLE-SEED", "PBE-WEAK-ITERATION", "HARDCODED-PASSWORD", "PREDICTABLE-KEYSTORE", "CLEARTEXT-HTTP", "DUMMY-CERT", "DUMMY-HOSTNAME", "IMPROPER-SSL", "UNTRUSTED-PRNG",
]
# --- fixed values: standards by target
STANDARD = {
    "ML-DSA-87": "FIPS 204", "ML-DSA-65": "FIPS 204", "ML-DSA-44": "FIPS 204", "ML-KEM-1024": "FIPS 203", "ML-KEM-768": "FIPS 203", "ML-KEM-512": "FIPS 203", "AES-256-GCM": "SP 800-38D",
}


def broken_name(algorithm: Column) -> Column:
    """Whether a name stands for something broken or misused."""
    return rules.has_any(F.upper(algorithm), BROKEN_NAMES)


def _in(name: Column, *words: str) -> Column:
    return rules.has_any(name, list(words))


def target(profile: Column | None = None) -> Column:
    """What an asset should become: itself if post-quantum or a hash, else signature, key exchange, cipher, in this order."""
    a, key, tier = F.upper("algorithm"), F.coalesce("key_size", F.lit(0)), F.col("x_tier")
    role, intent = F.col("primitive_type"), F.col("intent_class")
    tight = (profile == "CONSTRAINED") if profile is not None else F.lit(False)
    signature = (
        (role == "SIGNATURE")
        | _in(a, "ECDSA", "DSA", "ED25519", "ED448")
        | (_in(a, "RSA") & _in(a, "SIGN", "PSS"))
        | (intent.isin("AUTHENTICATION_SIGNATURE", "INTEGRITY_CHECKSUM") & (role != "KEY_EXCHANGE") & ~_in(a, "ECDH", "DH", "X25519"))
    )
    small = ((key > 0) & (key <= 1024) & ~_in(a, "256", "384")) | _in(a, "1024")
    dsa = F.when((key >= 4096) | _in(a, "4096", "521", "ED448") | ((tier == "ARCHIVAL") & (key >= 384)), "ML-DSA-87").when(small, "ML-DSA-44").otherwise("ML-DSA-65")
    kem = F.when(tight, "ML-KEM-512").when((key >= 4096) | _in(a, "4096") | ((tier == "ARCHIVAL") & (key > 2048)), "ML-KEM-1024").when(small, "ML-KEM-512").otherwise("ML-KEM-768")
    return (
        F.when(_in(a, "ML-DSA", "ML-KEM", "DILITHIUM", "KYBER", "SLH-DSA", "FALCON", "LWE"), F.col("algorithm"))
        .when(_in(a, "RISTRETTO", "PEDERSEN"), "LATTICE-COMMITMENT")
        .when(_in(a, "DYNAMIC_UNRESOLVED"), "MANUAL-TRIAGE")
        .when((role == "HASH") | _in(a, "SHA-256", "SHA-384", "SHA-512", "SHA256", "SHA3"), F.col("algorithm"))
        .when(_in(a, "SECRET-TOKEN", "API-KEY"), "SECRET-256")
        .when(signature, dsa)
        .when(role == "KEY_EXCHANGE", kem)
        .when(_in(a, "AES", "DES", "RC4"), "AES-256-GCM")
        .when(key >= 4096, "ML-KEM-1024")
        .otherwise("ML-KEM-768")
    )


def standard(name: Column) -> Column:
    return rules.lookup(name, STANDARD, "NONE")


def report_rule() -> Column:
    """Weakness or migration rule of an asset."""
    a, key, role = F.upper("algorithm"), F.col("key_size"), F.col("primitive_type")
    field = _in(a, "RSA") | (_in(a, "DH") & ~_in(a, "ECDH")) | (a == "DSA") | (_in(a, "DSA") & ~_in(a, "ECDSA", "ML-DSA"))
    weak = (field & (key < 2048)) | (_in(a, "ECDSA", "ECDH") & (key < 224)) | (role.isin("ENCRYPTION", "SYMMETRIC_CIPHER") & (key < 128))
    return (
        F.when(F.coalesce(weak, F.lit(False)), "CWE-326")
        .when(rules.has_any(a, BROKEN_NAMES) | F.col("is_broken"), "CWE-327")
        .when((role == "SIGNATURE") | _in(a, "SIGN", "ECDSA", "ED25519", "DSA", "RSA-PSS"), "MIGRATE-FIPS204")
        .when((role == "KEY_EXCHANGE") | _in(a, "DH", "KEM", "KYBER", "RSA"), "MIGRATE-FIPS203")
        .otherwise("CWE-326")
    )


def report_level(risk: Column) -> Column:
    return F.when(risk.isin("CRITICAL", "HIGH"), "error").when(risk.isin("MEDIUM", "MANUAL_REVIEW_REQUIRED"), "warning").otherwise("note")


def key_exchange(version: Column, cipher: Column, group: Column) -> Column:
    """Struct of the exchange's name and whether harvested traffic can be decrypted later."""
    c, g = F.upper(cipher), F.upper(F.coalesce(group, cipher, F.lit("")))
    hybrid = _in(g, "MLKEM", "ML-KEM", "KYBER", "ML_KEM")
    name = (
        F.when(hybrid, F.coalesce(group, cipher))
        .when(_in(c, "ECDHE") | (version == "TLSv1.3"), F.concat(F.lit("ECDHE-"), F.coalesce(group, F.lit("X25519"))))
        .when(_in(c, "DHE"), "DHE")
        .when(_in(c, "RSA"), "RSA-KEX")
        .otherwise("ECDHE-P256")
    )
    return F.struct(name.alias("algorithm"), (~hybrid).alias("harvestable"))


def bulk_cipher(cipher: Column, secret_bits: Column) -> Column:
    """Struct of cipher, bits and quantum risk."""
    c = F.upper(cipher)
    name = (
        F.when(_in(c, "AES_256_GCM", "AES-256-GCM"), "AES-256-GCM")
        .when(_in(c, "AES_128_GCM", "AES-128-GCM"), "AES-128-GCM")
        .when(_in(c, "CHACHA20"), "CHACHA20-POLY1305")
        .when(_in(c, "AES_128_CCM"), "AES-128-CCM")
        .when(_in(c, "AES_256_CBC", "AES256"), "AES-256-CBC")
        .when(_in(c, "AES_128_CBC", "AES128"), "AES-128-CBC")
    )
    bits = F.when(name.isNull(), F.when(F.coalesce(secret_bits, F.lit(0)) > 0, secret_bits).otherwise(128)).when(_in(name, "128"), 128).otherwise(256).cast("int")
    return F.struct(F.coalesce(name, cipher).alias("algorithm"), bits.alias("bits"), F.when(bits >= 256, "LOW").otherwise("HIGH").alias("quantum_risk"))


def route_profile(mtu: Column, method: Column) -> Column:
    """Route class by path MTU; a probed host is never flexible."""
    return F.when(mtu >= 9000, F.when(method == "host", "STANDARD").otherwise("FLEXIBLE")).when(mtu >= 1500, "STANDARD").when(mtu >= 1280, F.when(method == "host", "CONSTRAINED").otherwise("STANDARD")).otherwise("CONSTRAINED")


def advised(scores: DataFrame) -> DataFrame:
    t = target()
    return scores.withColumn("target", t).withColumn("standard", standard(F.col("target"))).withColumn("rule_id", report_rule()).withColumn("report_level", report_level(F.col("risk_level")))
