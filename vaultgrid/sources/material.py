"""Certificates and keys: from key files by their headers, and from the components of another bill of materials.

All rules are column expressions. X.509 structures are not parsed: a certificate
comes with its parsed fields, or is told by its component's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

COMPONENT = (
    "name string, cryptoProperties struct<assetType: string, oid: string, certificateProperties: struct<subjectName: string, issuerName: string, notValidAfter: string>,"
    " relatedCryptoMaterialProperties: struct<type: string, size: int, format: string>>, evidence struct<occurrences: array<struct<location: string>>>"
)
KEY_SUFFIXES = ["crt", "cer", "pem", "key", "sk"]
#: Characters of a key file that its rules look at.
SAMPLE = 4096


def _has(text: Column, *words: str) -> Column:
    return rules.has_any(text, list(words))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def no_key(path: Column, name: Column, kind: Column) -> Column:
    """Environment files, tokens and interface keys: secrets, but no cryptography."""
    p, n = F.lower(path), F.lower(name)
    return F.contains(p, F.lit(".env")) | F.contains(n, F.lit(".env")) | F.contains(n, F.lit("generic-api-key")) | F.coalesce(kind.isin("token", "generic-api-key"), F.lit(False))


def _curve_size(path: Column, bits: int) -> Column:
    """Whether a lower-case path names a curve of so many bits: the number apart, or behind a name of curves, as in ``p384`` and ``secp384r1``; in ``key1384`` it is a serial number."""
    return path.rlike(rf"(?<![a-z0-9])(?:(?:nist|secp|prime|brainpool|curve|ecdsa|ecdh|es|ec|p)[-_]?)*{bits}(?![0-9])")


def key_facts(path: Column, name: Column, kind: Column, size: Column, sample: Column) -> Column:
    """(algorithm, key_size, primitive_type, x_tier) of a key, by its name, path and first characters; the first rule that fits counts."""
    n, p, s = F.upper(name), F.lower(path), F.coalesce(sample, F.lit(""))
    private = F.coalesce(kind == "private-key", F.lit(False))
    blind = _has(p, "blind") | _has(F.lower(name), "blind")
    fact = lambda a, b, r, t: F.struct(a.alias("algorithm"), b.cast("int").alias("key_size"), r.alias("primitive_type"), t.alias("x_tier"))
    lit = F.lit
    long_kept = F.when(private, "ARCHIVAL").otherwise("OPERATIONAL")
    rsa = fact(F.concat(lit("RSA-"), size.cast("string")), size, F.when(blind, "SIGNATURE").when(private, "KEY_EXCHANGE").otherwise("SIGNATURE"), F.when(blind, "EPHEMERAL").otherwise(long_kept))
    curve = lambda a, b: fact(lit(a), lit(b), lit("SIGNATURE"), lit("OPERATIONAL"))
    plain_ec = _has(n, "EC") | _has(p, "ecdsa", "wallet") | _has(s, "prime256v1", "secp256r1", "1.2.840.10045", "PRIVATE KEY") | path.endswith("_sk") | _has(path, "priv_sk", "keystore")
    return (
        F.when(_has(n, "RSA") | _has(p, "rsa") | _has(s, "BEGIN RSA"), rsa)
        .when(_has(s, "secp384r1", "1.3.132.0.34") | _curve_size(p, 384) | _has(name, "384"), curve("ECDSA-P384", 384))
        .when(_has(s, "secp521r1", "1.3.132.0.35") | _curve_size(p, 521) | _has(name, "521"), curve("ECDSA-P521", 521))
        .when(_has(s, "secp256k1", "1.3.132.0.10"), curve("ECDSA-secp256k1", 256))
        .when(plain_ec, curve("ECDSA-P256", 256))
        .when(_has(n, "ED25519") | _has(p, "ed25519"), curve("Ed25519", 256))
        .otherwise(fact(name, size, lit("ENCRYPTION"), long_kept))
    )


def components(documents: DataFrame) -> DataFrame:
    """(seq, c, path) of documents (doc_seq, content): every component of each, in order; what is no JSON has none."""
    parsed = F.from_json("content", f"components array<struct<{', '.join(_fields(COMPONENT))}>>")
    rows = documents.select("doc_seq", F.posexplode(parsed["components"]).alias("at", "c"))
    path = F.coalesce(F.get(F.col("c.evidence.occurrences"), F.lit(0))["location"], F.lit("unknown_file"))
    return rows.select(F.struct("doc_seq", "at").alias("seq"), "c", path.alias("path"))


def _fields(schema: str) -> list[str]:
    """``name kind, ...`` as ``name: kind`` at the outer level."""
    out, depth, part = [], 0, ""
    for ch in schema + ",":
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and not depth:
            out.append(part.strip().replace(" ", ": ", 1))
            part = ""
        else:
            part += ch
    return out


def material(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """Assets of the components of other bills of materials.

    ``samples`` holds (path, sha, sample, fingerprint) of the files at hand; a
    component whose file is not there is judged by its name alone. Certificates
    of one fingerprint are one asset with its replicas; a public key of a file
    that holds a certificate is left out, and so is a second key of one content.
    """
    rows = components(documents).where(rules.should_scan(F.col("path")))
    rows = rows.withColumns({"kind": F.col("c.cryptoProperties.assetType"), "name": F.coalesce("c.name", F.lit("asset"))})
    rows = rows.join(samples.withColumnRenamed("path", "__path"), F.col("path") == F.col("__path"), "left").drop("__path")
    certificate = rows.where("kind = 'certificate'").withColumn("mark", F.coalesce("fingerprint", F.sha2("path", 256)))
    first = certificate.groupBy("mark").agg(F.min(F.struct("seq", "path", "name")).alias("x"), F.array_sort(F.collect_set("path")).alias("replicas"))
    named = F.when(_has(F.col("x.name"), "RSA", "ECDSA"), F.col("x.name")).otherwise("RSA-2048")
    made = first.select(
        F.col("x.seq").alias("seq"), F.concat(F.lit("x509_cert:"), rules.stem(F.col("x.path"))).alias("component_name"), named.alias("algorithm"), F.lit(2048).alias("key_size"), F.lit("SIGNATURE").alias("primitive_type"),
        F.col("x.path").alias("path"), F.lit("OPERATIONAL").alias("x_tier"), F.array_join("replicas", ",").alias("replicas"),
    )
    p = rows.select("seq", "path", "name", "sha", "sample", F.col("c.cryptoProperties.relatedCryptoMaterialProperties.type").alias("type"), F.col("c.cryptoProperties.relatedCryptoMaterialProperties.size").alias("size"), "kind")
    keys = p.where("kind = 'related-crypto-material'").where(~no_key(F.col("path"), F.col("name"), F.col("type")))
    public = F.coalesce(F.col("type") == "public-key", F.lit(False))
    keys = keys.where(~(public & (suffix(F.col("path")).isin("crt", "cer") | F.contains(F.lower("path"), F.lit("-cert.pem")))))
    certified = certificate.select("path").distinct().withColumn("type", F.lit("public-key"))
    keys = keys.join(certified, ["path", "type"], "left_anti")
    once = keys.groupBy(F.coalesce("sha", "path").alias("mark"), F.coalesce("type", F.lit("")).alias("kind")).agg(F.min(F.struct("seq", "path", "name", "size", "sample")).alias("x"))
    size = F.when(F.coalesce(F.col("x.size"), F.lit(0)) == 0, 2048).otherwise(F.col("x.size"))
    once = once.withColumn("f", key_facts(F.col("x.path"), F.col("x.name"), F.col("kind"), size, F.col("x.sample")))
    held = once.select(
        F.col("x.seq").alias("seq"), F.concat(F.lit("keyfile:"), rules.stem(F.col("x.path")), F.lit("_"), F.col("kind")).alias("component_name"), "f.algorithm", "f.key_size", "f.primitive_type", F.col("x.path").alias("path"), "f.x_tier", F.lit("").alias("replicas"),
    )
    return made.unionByName(held)


def key_files(files: DataFrame) -> DataFrame:
    """Assets of key files (path, content) by their headers; one of each content, the first by path; keystores are told apart as unreadable."""
    kept = files.where(rules.should_scan(F.col("path")) & suffix(F.col("path")).isin(*KEY_SUFFIXES, "p12", "pfx"))
    text = F.substring("content", 1, SAMPLE)
    kind = F.when(suffix(F.col("path")).isin("p12", "pfx"), "keystore").when(_has(F.col("content"), "PRIVATE KEY"), "private-key").when(_has(F.col("content"), "PUBLIC KEY"), "public-key")
    rows = kept.withColumn("kind", kind).where("kind IS NOT NULL")
    once = rows.groupBy(F.sha2("content", 256).alias("sha"), "kind").agg(F.min("path").alias("path"), F.min_by(text, "path").alias("sample"))
    rsa, curve, edwards = _has(F.col("sample"), "RSA"), _has(F.col("sample"), "EC PRIVATE", "ECDSA", "prime256v1"), _has(F.col("sample"), "ED25519")
    private = F.col("kind") == "private-key"
    elliptic = ~rsa & (curve | edwards)
    algorithm = F.when(F.col("kind") == "keystore", F.lit(None)).when(rsa, "RSA-2048").when(curve, "ECDSA-P256").when(edwards, "Ed25519").otherwise("RSA-2048")
    return once.select(
        "path", "kind", algorithm.alias("algorithm"), F.when(F.col("kind") == "keystore", F.lit(None)).when(elliptic, 256).otherwise(2048).cast("int").alias("key_size"),
        F.when(elliptic, "SIGNATURE").when(private, "KEY_EXCHANGE").otherwise("SIGNATURE").alias("primitive_type"), F.when(private, "ARCHIVAL").otherwise("OPERATIONAL").alias("x_tier"), F.when(F.col("kind") == "keystore", "ENCRYPTED_KEYSTORE").alias("unknown"),
    )
