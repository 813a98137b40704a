"""Queries of certificates, keys and keystores from bytes, registered by import."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from ..sources import certificates, der
from .catalog import query
from .estate import table
from .inventory import _list

_SITE = "site00000000"


def _integer(n: int) -> bytes:
    return der.encoded(der.INTEGER, n.to_bytes(n.bit_length() // 8 + 1))


def _name(common: str) -> bytes:
    pair = lambda oid, text: der.encoded(der.SET, der.encoded(der.SEQUENCE, der.encoded_oid(oid), der.encoded(0x0C, text.encode())))
    return der.encoded(der.SEQUENCE, pair("2.5.4.10", "Acme, Inc"), pair("2.5.4.3", common))


def _algorithm(oid: str, *more: bytes) -> bytes:
    return der.encoded(der.SEQUENCE, der.encoded_oid(oid), *more)


def _keys() -> list[tuple[bytes, bytes, bytes]]:
    """(algorithm identifier, public key, private key) of five kinds; the numbers are no real keys."""
    out = []
    for bits in (2048, 1024):
        n = (1 << bits - 1) + 12345
        out.append((_algorithm(der.RSA, der.encoded(0x05)), der.encoded(der.SEQUENCE, _integer(n), _integer(65537)), der.encoded(der.SEQUENCE, _integer(0), _integer(n), _integer(65537), *[_integer(k) for k in range(3, 9)])))
    for curve, size in (("1.2.840.10045.3.1.7", 32), ("1.3.132.0.34", 48)):
        out.append((_algorithm(der.EC, der.encoded_oid(curve)), b"\4" + bytes(2 * size), der.encoded(der.SEQUENCE, _integer(1), der.encoded(der.OCTETS, bytes(size)))))
    out.append((_algorithm(der.ED25519), bytes(32), der.encoded(der.OCTETS, bytes(32))))
    return out


def _certificate(kind: int) -> bytes:
    algorithm, key, _ = _keys()[kind]
    spki = der.encoded(der.SEQUENCE, algorithm, der.encoded(der.BITS, b"\0", key))
    times = der.encoded(der.SEQUENCE, der.encoded(0x17, b"240101000000Z"), der.encoded(0x18, b"20550630235959Z"))
    signed = _algorithm("1.2.840.113549.1.1.11")
    body = der.encoded(der.SEQUENCE, der.encoded(0xA0, _integer(2)), _integer(77), signed, _name("Root"), times, _name(_SITE), spki)
    return der.encoded(der.SEQUENCE, body, signed, der.encoded(der.BITS, b"\0", bytes(8)))


def _store(kind: int, locked: bool) -> bytes:
    bag = der.encoded(der.SEQUENCE, der.encoded_oid("1.2.840.113549.1.9.22.1"), der.encoded(0xA0, der.encoded(der.OCTETS, _certificate(kind))))
    safe = der.encoded(der.SEQUENCE, der.encoded(der.SEQUENCE, der.encoded_oid(der.SHROUDED if locked else der.CERT_BAG), der.encoded(0xA0, bag)))
    content = der.encoded(der.SEQUENCE, der.encoded(der.SEQUENCE, der.encoded_oid(der.DATA), der.encoded(0xA0, der.encoded(der.OCTETS, safe))))
    return der.encoded(der.SEQUENCE, _integer(3), der.encoded(der.SEQUENCE, der.encoded_oid(der.DATA), der.encoded(0xA0, der.encoded(der.OCTETS, content))))


def _private(kind: int) -> bytes:
    algorithm, _, key = _keys()[kind]
    return der.encoded(der.SEQUENCE, _integer(0), algorithm, der.encoded(der.OCTETS, key))


_CERTS, _STORES, _PRIVATE = [_certificate(i) for i in range(5)], [_store(i, i == 4) for i in range(5)], [_private(i) for i in range(5)]


def _filled(templates: list[bytes], kind, site):
    """The template of each row's kind with the site's name in it, as bytes."""
    halves = [t.hex().split(_SITE.encode().hex()) for t in templates]
    whole = [F.concat(F.lit(h[0]), F.hex(site), F.lit(h[1])) if len(h) > 1 else F.lit(h[0]) for h in halves]
    return F.unhex(F.get(F.array(*whole), kind.cast("int")))


def _files(spark, sf):
    """Of each supplier a certificate as text and as bytes, a keystore, and a private key, which its whole nation shares."""
    s = table(spark, sf, "supplier")
    k, kind = F.col("s_suppkey"), F.col("s_suppkey") % 5
    site = F.concat(F.lit("site"), F.lpad(k.cast("string"), 8, "0"))
    armour = lambda label, body: F.concat(F.lit(f"-----BEGIN {label}-----\n"), F.translate(F.base64(body), "\r\n", ""), F.lit(f"\n-----END {label}-----\n")).cast("binary")
    at = lambda form: F.format_string(form, k)
    kinds = F.col("s_nationkey") % 5
    rows = [
        (at("c/%06d.pem"), armour("CERTIFICATE", _filled(_CERTS, kind, site))), (at("d/%06d.cer"), _filled(_CERTS, kind, site)), (at("s/%06d.p12"), _filled(_STORES, kind, site)),
        (at("k/%06d.key"), F.concat(armour("PRIVATE KEY", _filled(_PRIVATE, kinds, site)), F.col("s_nationkey").cast("string").cast("binary"))), (at("n/%06d.txt"), F.lit(b"no key")), (at("x/%06d.crt"), F.lit(b"\x30\x82\x01")),
    ]
    out = None
    for path, content in rows:
        one = s.select(path.alias("path"), content.alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


_ALGORITHMS, _SIZES = ["RSA-2048", "RSA-1024", "ECDSA-P256", "ECDSA-P384", "Ed25519"], [2048, 1024, 256, 384, 256]
_HALVES = [t.hex().split(_SITE.encode().hex()) for t in _CERTS]


@query(
    f"""WITH c AS (SELECT s_suppkey AS k, s_suppkey % 5 AS kind, 'site' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS site FROM supplier)
    SELECT 'x509_cert:' || lpad(CAST(k AS VARCHAR), 6, '0') AS component_name, 'certificate' AS kind, {_list(_ALGORITHMS)}[kind + 1] AS algorithm, CAST({_list(_SIZES)}[kind + 1] AS INTEGER) AS key_size, 'SIGNATURE' AS primitive_type, 'c/' || lpad(CAST(k AS VARCHAR), 6, '0') || '.pem' AS path, 'OPERATIONAL' AS x_tier,
    sha256(unhex({_list([h[0] for h in _HALVES])}[kind + 1] || hex(site) || {_list([h[1] for h in _HALVES])}[kind + 1])) AS fingerprint, 'CN=' || site || ',O=Acme\\, Inc' AS subject, 'CN=Root,O=Acme\\, Inc' AS issuer, '2055-06-30T23:59:59+00:00' AS not_after, CAST(CASE WHEN kind = 4 THEN 2 ELSE 3 END AS BIGINT) AS replicas FROM c
    UNION ALL SELECT 'keyfile:' || lpad(CAST(min(s_suppkey) AS VARCHAR), 6, '0') || '_private-key', 'private-key', {_list(_ALGORITHMS)}[s_nationkey % 5 + 1], CAST({_list(_SIZES)}[s_nationkey % 5 + 1] AS INTEGER), CASE WHEN s_nationkey % 5 < 2 THEN 'KEY_EXCHANGE' ELSE 'SIGNATURE' END, 'k/' || lpad(CAST(min(s_suppkey) AS VARCHAR), 6, '0') || '.key', 'ARCHIVAL',
    sha256('-----BEGIN PRIVATE KEY-----' || chr(10) || {_list([base64.b64encode(p).decode() for p in _PRIVATE])}[s_nationkey % 5 + 1] || chr(10) || '-----END PRIVATE KEY-----' || chr(10) || s_nationkey), NULL, NULL, NULL, count(*) FROM supplier GROUP BY s_nationkey"""
)
def certificate_bytes(spark, sf):
    """Algorithm, size, names, end and fingerprint read from bytes; three files hold one certificate, keys are shared."""
    return certificates.assets(certificates.found(_files(spark, sf)))


@query("SELECT 's/' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.p12' AS path, 'ENCRYPTED_KEYSTORE' AS category FROM supplier WHERE s_suppkey % 5 = 4")
def locked_keystores(spark, sf):
    return certificates.unknown(certificates.found(_files(spark, sf))).select("path", "category")


@query("SELECT 'CN=site' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS subject, f AS folder FROM supplier, (VALUES ('c'), ('d'), ('s')) t(f) WHERE f <> 's' OR s_suppkey % 5 <> 4")
def certificate_replicas(spark, sf):
    rows = certificates.found(_files(spark, sf))
    named = certificates.assets(rows).select("fingerprint", F.regexp_extract("subject", "^[^,]*", 0).alias("subject"))
    return certificates.replicas(rows).join(named, "fingerprint").select("subject", F.substring("path", 1, 1).alias("folder"))
