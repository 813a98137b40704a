"""Classification rules as Column functions: no Python in the data path.

Every function takes Columns and returns a Column, so that Catalyst sees one
expression. Names are compared in upper case, texts in lower case. Nulls: a null
name matches nothing; a null size counts as none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def lookup(key: Column, table: dict, default) -> Column:
    items = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*items), key), F.lit(default))


def asset_kind(algorithm: Column) -> Column:
    a = F.upper(F.trim(algorithm))
    return (
        F.when(has_any(a, fixed.POST_QUANTUM_FAMILY), "POST_QUANTUM")
        .when(has_any(a, fixed.CURVE_FAMILY), "ELLIPTIC_CURVE")
        .when(has_any(a, fixed.MODULAR_FAMILY) | (a == "DSA") | a.startswith("DSA-"), "CLASSICAL_ASYMMETRIC")
        .when(has_any(a, fixed.SYMMETRIC_FAMILY), "SYMMETRIC")
        .otherwise("OPAQUE")
    )


def kind_bits(kind: Column, algorithm: Column, key_size: Column) -> Column:
    """Modulus, curve or key bits by kind; null for the others."""
    a, k = F.upper(F.trim(algorithm)), F.coalesce(key_size, F.lit(0))
    curve = F.when(k.isin(224, 256, 384, 521), k).when(F.contains(a, F.lit("384")), 384).when(F.contains(a, F.lit("521")), 521).otherwise(256)
    modulus = F.when(k >= 512, k).when(F.contains(a, F.lit("1024")), 1024).when(F.contains(a, F.lit("4096")), 4096).otherwise(2048)
    key = F.when(k != 0, k).when(F.contains(a, F.lit("128")), 128).when(F.contains(a, F.lit("192")), 192).when(F.contains(a, F.lit("512")), 512).otherwise(256)
    return F.when(kind == "ELLIPTIC_CURVE", curve).when(kind == "CLASSICAL_ASYMMETRIC", modulus).when(kind == "SYMMETRIC", key).cast("int")


def cipher_mode(algorithm: Column) -> Column:
    a = F.upper(algorithm)
    return F.when(F.contains(a, F.lit("ECB")), "ECB").when(F.contains(a, F.lit("CBC")), "CBC").otherwise("GCM")


def nist_level(algorithm: Column) -> Column:
    a = F.upper(F.trim(algorithm))
    c = lambda x: F.contains(a, F.lit(x))
    dsa = F.when(c("87") | c("5"), 5).when(c("44") | c("2"), 2).otherwise(3)
    kem = F.when(c("1024"), 5).when(c("512"), 1).otherwise(3)
    return F.when(c("ML-DSA") | c("DILITHIUM"), dsa).when(c("ML-KEM") | c("KYBER"), kem).when(c("LWE"), 5).otherwise(3).cast("int")


def flight_bytes(kind: Column, algorithm: Column, bits: Column, key_size: Column) -> Column:
    """Bytes of public key, signature and ciphertext on the wire."""
    a, level = F.upper(F.trim(algorithm)), nist_level(algorithm)
    c = lambda x: F.contains(a, F.lit(x))
    pq = (
        F.when(c("ML-DSA") | c("DILITHIUM"), F.when(level == 5, 2592 + 4627).when(level == 2, 1312 + 2420).otherwise(1952 + 3309))
        .when(c("ML-KEM") | c("KYBER"), F.when(level == 5, 1568 + 1568).when(level == 1, 800 + 768).otherwise(1184 + 1088))
        .when(c("LWE"), 65536 + 38000)
        .otherwise(F.when(F.coalesce(key_size, F.lit(0)) != 0, key_size).otherwise(1952))
    )
    return F.when(kind == "POST_QUANTUM", pq).when(kind.isin("ELLIPTIC_CURVE", "CLASSICAL_ASYMMETRIC"), F.floor(bits / 8) * 2).otherwise(0).cast("int")


def security_bits(kind: Column, algorithm: Column, bits: Column) -> Column:
    level = nist_level(algorithm)
    modulus = F.when(bits >= 15360, 256).when(bits >= 7680, 192).when(bits >= 3072, 128).when(bits >= 2048, 112).otherwise(80)
    pq = F.when(level.isin(1, 2), 128).when(level.isin(3, 4), 192).otherwise(256)
    return F.when(kind == "POST_QUANTUM", pq).when(kind == "CLASSICAL_ASYMMETRIC", modulus).when(kind == "ELLIPTIC_CURVE", F.floor(bits / 2)).when(kind == "SYMMETRIC", bits).otherwise(0).cast("int")


def is_post_quantum(kind: Column, primitive: Column, bits: Column) -> Column:
    """By kind: a symmetric key of 256 bits counts, except as a plain symmetric cipher or signature."""
    return F.when(kind == "POST_QUANTUM", True).when((kind == "SYMMETRIC") & primitive.isin("ENCRYPTION", "KEY_EXCHANGE", "HASH"), bits >= 256).otherwise(False)


def is_broken(kind: Column, bits: Column, mode: Column) -> Column:
    return F.when(kind == "CLASSICAL_ASYMMETRIC", bits < 2048).when(kind == "ELLIPTIC_CURVE", bits < 224).when(kind == "SYMMETRIC", (mode == "ECB") | (bits < 112)).otherwise(False)


def safe_name(algorithm: Column) -> Column:
    return has_any(F.upper(algorithm), fixed.POST_QUANTUM_NAMES + fixed.SAFE_NAMES)


def needs_review(algorithm: Column, tier: Column, flagged: Column) -> Column:
    return (F.upper(algorithm) == "DYNAMIC_UNRESOLVED") | (tier == "HUMAN_REVIEW") | F.coalesce(flagged, F.lit(False))


def deadline(kind: Column, primitive: Column, broken: Column) -> Column:
    """(year, phase) by kind alone."""
    asymmetric = kind.isin("CLASSICAL_ASYMMETRIC", "ELLIPTIC_CURVE")
    year = F.when(kind == "POST_QUANTUM", 2050).when(broken | (kind == "OPAQUE"), 2026).when(asymmetric, F.when(primitive == "SIGNATURE", 2031).otherwise(2030)).otherwise(2050)
    phase = F.when(~broken & asymmetric, F.when(primitive == "SIGNATURE", 4).otherwise(3)).otherwise(0)
    return F.struct(year.cast("int").alias("year"), phase.cast("int").alias("phase"))


def path_parts(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def should_scan(path: Column) -> Column:
    dirs = F.slice(path_parts(path), 1, F.greatest(F.size(path_parts(path)) - 1, F.lit(0)))
    denied = F.array(*[F.lit(x) for x in fixed.EXCLUDED_DIRS])
    lowered = F.exists(dirs, lambda d: (d.startswith(".") & (d != ".")) | F.array_contains(denied, F.lower(d)) | F.array_contains(denied, d))
    name = F.lower(F.element_at(path_parts(path), -1))
    manifest = name.startswith("requirements") & name.endswith(".txt")
    excluded = reduce(lambda a, b: a | b, [path.rlike(f"(?i){p}") for p in fixed.EXCLUDED_PATHS])
    return ~lowered & (manifest | ~excluded)


def is_test_path(path: Column) -> Column:
    dirs = F.transform(F.slice(path_parts(path), 1, F.greatest(F.size(path_parts(path)) - 1, F.lit(0))), F.lower)
    names = F.array(*[F.lit(x) for x in fixed.TEST_DIRS])
    by_dir = F.exists(dirs, lambda d: F.array_contains(names, d) | d.rlike("^tests?-|-tests?$"))
    return by_dir | reduce(lambda a, b: a | b, [path.rlike(f"(?i){p}") for p in fixed.TEST_PATHS])


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def normal_key(name: Column) -> Column:
    """Upper case, separators to single hyphens, brackets dropped."""
    dashed = F.translate(F.upper(F.trim(name)), "_/ .:()[]{}", "-----")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")


def intent_of(variable: Column, sink: Column, context: Column, primitive: Column) -> Column:
    """Sink first, then variable, then context, then the role."""
    v, s, c = (F.lower(F.coalesce(x, F.lit(""))) for x in (variable, sink, context))
    out = [F.when(has_any(s, fixed.INTENT_CALLS[i]), i) for i in fixed.SINK_ORDER]
    out += [F.when(has_any(v, words), i) for i, words in fixed.INTENT_VARIABLES.items()]
    out += [F.when(has_any(c, words), i) for i, words in fixed.INTENT_CALLS.items()]
    role = F.when(primitive == "SIGNATURE", "AUTHENTICATION_SIGNATURE").when(primitive == "HASH", "INTEGRITY_CHECKSUM").otherwise("CONFIDENTIALITY_ENVELOPE")
    return F.coalesce(*out, role)


def agility_of(line: Column, context: Column, algorithm: Column, parameterised: Column | None = None) -> Column:
    """Agility level 0 to 5 (4 is never given: orchestration counts as 3)."""
    text = F.lower(F.concat_ws("\n", F.coalesce(line, F.lit("")), F.coalesce(context, F.lit(""))))
    name = F.lower(F.trim(F.coalesce(algorithm, F.lit(""))))
    level = F.when(has_any(name, fixed.AGILITY_PQC) | has_any(text, fixed.AGILITY_PQC), 5)
    level = level.when(has_any(text, fixed.AGILITY_ORCHESTRATED) | has_any(name, ["tls", "ssl"]) | has_any(text, fixed.AGILITY_RUNTIME), 3)
    level = level.when(has_any(text, fixed.AGILITY_PROVIDER), 2)
    configurable = has_any(text, fixed.AGILITY_CONFIGURABLE)
    if parameterised is not None:
        configurable = configurable | F.coalesce(parameterised, F.lit(False))
    return level.when(configurable, 1).otherwise(0).cast("int")


def signature_shape(arguments: Column) -> Column:
    """What a function's argument names say it is: key derivation, cipher, signer; else null."""
    args = F.transform(arguments, F.lower)
    any_of = lambda words: F.exists(args, lambda a: has_any(a, words))
    many = F.exists(args, lambda a: F.coalesce(F.when(a.rlike("^[0-9]+$"), a.try_cast("long") > 100), F.lit(False)))
    kdf = any_of(["password", "passphrase", "secret", "pwd"]) & any_of(["salt"]) & (any_of(["cost", "iter", "round"]) | many | (F.size(arguments) >= 3))
    cipher = any_of(["key"]) & any_of(["iv", "nonce"]) & any_of(["plaintext", "data", "src", "payload", "cleartext"])
    signer = any_of(["priv", "sk"]) & any_of(["digest", "hash"])
    aead = any_of(["aad", "auth_data", "associated_data", "tag"])
    return F.when(kdf, "GENERIC-KDF").when(cipher & aead, "GENERIC-AEAD-CIPHER").when(cipher, "GENERIC-BLOCK-CIPHER").when(signer, "GENERIC-ASYMMETRIC-SIGNER")


def years_of(amount: Column, unit: Column) -> Column:
    """Days, months or years as years, to two places."""
    u, n = F.lower(unit), amount.cast("double")
    exact = F.when(F.contains(u, F.lit("day")), n / 365.25).when(F.contains(u, F.lit("month")), n / 12.0).otherwise(n)
    return F.round(exact.cast("decimal(18,6)"), 2).cast("double")


def tier_of_years(years: Column) -> Column:
    return F.when(years <= 0.1, "EPHEMERAL").when(years <= 2.0, "SHORT_TERM").when(years <= 7.0, "OPERATIONAL").otherwise("ARCHIVAL")


def two_places(x: Column) -> Column:
    """Rounded half up on the decimal value, so that engines agree."""
    return F.round(x.cast("decimal(18,6)"), 2).cast("double")
