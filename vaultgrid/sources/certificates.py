"""Assets of certificate, key and keystore files, from their bytes.

Files are read in Arrow batches, each file on its own (``der``). A certificate is
one asset by its fingerprint, whichever files hold it, the first by path; so is
a key by the hash of its file, for each kind. A file with a certificate gives no
key. Keystores that hold something encrypted are told for the ledger of unknowns.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import der, material

SCHEMA = "path string, kind string, algorithm string, key_size int, fingerprint string, subject string, issuer string, not_before string, not_after string"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int32() if " int" in x else pa.string() for x in SCHEMA.split(", ")]


def _read(batches):
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            suffix = path.rpartition(".")[2].lower()
            rows += [{"path": path} | found for found in der.read(content.as_py(), suffix)]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(FIELDS, _TYPES)], FIELDS)


def found(files: DataFrame) -> DataFrame:
    """A row for each certificate, key and encrypted store in files (path, content as bytes); null content gives none."""
    kept = files.where(rules.should_scan(F.col("path")) & material.suffix(F.col("path")).isin(*material.KEY_SUFFIXES, "p12", "pfx") & F.col("content").isNotNull())
    return kept.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(_read, SCHEMA)


def assets(rows: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """One asset a fingerprint and kind, with the number of files that hold it.

    Keys whose structure told nothing are RSA-2048, as their headers alone would say.
    """
    held = rows.where("kind <> 'encrypted'").groupBy("fingerprint", "kind").agg(F.min(F.struct("path", "algorithm", "key_size", "subject", "issuer", "not_after")).alias("x"), F.countDistinct("path").alias("replicas"))
    certificate, private = F.col("kind") == "certificate", F.col("kind") == "private-key"
    store = material.suffix(F.col("x.path")).isin("p12", "pfx")
    algorithm = F.coalesce(F.col("x.algorithm"), F.lit("RSA-2048"))
    signs = certificate | ~private | ~F.startswith(algorithm, F.lit("RSA"))
    stem = rules.stem(F.col("x.path"))
    return held.select(
        F.when(certificate, F.concat(F.when(store, "p12_cert:").otherwise("x509_cert:"), stem)).otherwise(F.concat(F.lit("keyfile:"), stem, F.lit("_"), "kind")).alias("component_name"),
        "kind", algorithm.alias("algorithm"), F.coalesce(F.col("x.key_size"), F.lit(2048)).alias("key_size"), F.when(signs, "SIGNATURE").otherwise("KEY_EXCHANGE").alias("primitive_type"),
        F.col("x.path").alias("path"), F.when(private, "ARCHIVAL").otherwise("OPERATIONAL").alias("x_tier"), "fingerprint", F.col("x.subject").alias("subject"), F.col("x.issuer").alias("issuer"), F.col("x.not_after").alias("not_after"), "replicas",
    )


def replicas(rows: DataFrame) -> DataFrame:
    """(fingerprint, path) of every file that holds a certificate, a row each."""
    return rows.where("kind = 'certificate'").select("fingerprint", "path").distinct()


def unknown(rows: DataFrame) -> DataFrame:
    """(path, category, recommended_action) of stores that cannot be read without a password."""
    locked = rows.where("kind = 'encrypted'").select("path").distinct()
    return locked.withColumns({"category": F.lit("ENCRYPTED_KEYSTORE"), "recommended_action": F.lit("Provide the keystore's password or export its public certificate")})
