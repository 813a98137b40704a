"""Certificates, keys and keystores from bytes: hand-made structures, real ones where the JDK's tool is there, broken ones."""

import hashlib
import shutil
import subprocess

import pytest

from vaultgrid.plans import stores
from vaultgrid.sources import certificates, der


@pytest.mark.parametrize("kind, algorithm, size", [(0, "RSA-2048", 2048), (1, "RSA-1024", 1024), (2, "ECDSA-P256", 256), (3, "ECDSA-P384", 384), (4, "Ed25519", 256)])
def test_certificate_and_key(kind, algorithm, size):
    data = stores._certificate(kind)
    [got] = der.read(data, "cer")
    assert (got["algorithm"], got["key_size"], got["fingerprint"]) == (algorithm, size, hashlib.sha256(data).hexdigest())
    assert (got["subject"], got["issuer"], got["not_before"], got["not_after"]) == ("CN=site00000000,O=Acme\\, Inc", "CN=Root,O=Acme\\, Inc", "2024-01-01T00:00:00+00:00", "2055-06-30T23:59:59+00:00")
    assert der.private(stores._private(kind)) == (algorithm, size)
    assert der.read(stores._store(kind, False), "p12") == [got]
    assert der.read(stores._store(kind, True), "pfx") == [{"kind": "encrypted"}]


def test_names():
    pair = lambda oid, tag, text: der.encoded(der.SET, der.encoded(der.SEQUENCE, der.encoded_oid(oid), der.encoded(tag, text)))
    node = der.Node(der.encoded(der.SEQUENCE, pair("2.5.4.6", 0x13, b"DE"), pair("1.2.840.113549.1.9.1", 0x16, b"a@b"), pair("2.5.4.3", 0x1E, "é+#".encode("utf-16-be")), pair("2.5.4.11", 0x0C, b" x ")))
    assert der.name(node) == "OU=\\ x\\ ,CN=é\\+#,1.2.840.113549.1.9.1=a@b,C=DE"


def test_broken_bytes_have_no_fields():
    whole = stores._certificate(0)
    for n in range(0, len(whole), 7):
        assert der.read(whole[:n], "crt") == []
    for k in range(0, len(whole), 3):
        der.read(whole[:k] + bytes([whole[k] ^ 0xFF]) + whole[k + 1 :], "crt")  # any outcome, no failure
    for data in (b"", b"\x30\x80\0\0", b"-----BEGIN CERTIFICATE-----\n!!\n-----END CERTIFICATE-----", b"\x30\x84\xff\xff\xff\xff", b"\x30\x03\x02\x01\x01" * 50):
        assert der.read(data, "pem") == []
    assert der.read(b"junk", "p12") == [{"kind": "encrypted"}]
    assert der.read(b"-----BEGIN ENCRYPTED PRIVATE KEY-----\nAAAA\n-----END ENCRYPTED PRIVATE KEY-----", "key")[0]["algorithm"] is None


def test_hostile_files(spark):
    files = [("a.crt", None), ("b.crt", b""), ("c.pem", stores._certificate(2)), ("d.pem", stores._certificate(2)), ("e.txt", stores._certificate(2)), ("node_modules/f.pem", stores._certificate(1)), ("g.key", b"-----BEGIN PUBLIC KEY-----\nx\n-----END PUBLIC KEY-----")]
    rows = certificates.found(spark.createDataFrame(files, "path string, content binary"))
    got = {(r["path"], r["algorithm"], r["kind"], r["replicas"]) for r in certificates.assets(rows).collect()}
    assert got == {("c.pem", "ECDSA-P256", "certificate", 2), ("g.key", "RSA-2048", "public-key", 1)}


@pytest.mark.skipif(not shutil.which("keytool"), reason="needs the JDK's keytool")
@pytest.mark.parametrize("options, algorithm", [(["RSA", "-keysize", "3072"], "RSA-3072"), (["EC", "-groupname", "secp521r1"], "ECDSA-P521"), (["Ed25519"], "Ed25519"), (["DSA", "-keysize", "2048"], "DSA-2048")])
def test_real_certificates(tmp_path, options, algorithm):
    run = lambda *a: subprocess.run(["keytool", *a, "-alias", "a", "-keystore", str(tmp_path / "s.p12"), "-storepass", "changeit"], check=True, capture_output=True, timeout=120)
    run("-genkeypair", "-keyalg", *options, "-dname", "CN=a\\, b, OU=x, O=Acme, C=DE", "-storetype", "PKCS12")
    run("-exportcert", "-rfc", "-file", str(tmp_path / "a.pem"))
    run("-exportcert", "-file", str(tmp_path / "a.cer"))
    data = (tmp_path / "a.cer").read_bytes()
    [got] = der.read(data, "cer")
    assert got["algorithm"] == algorithm and got["subject"] == got["issuer"] == "CN=a\\, b,OU=x,O=Acme,C=DE" and got["fingerprint"] == hashlib.sha256(data).hexdigest()
    assert der.read((tmp_path / "a.pem").read_bytes(), "pem") == [got]
    assert der.read((tmp_path / "s.p12").read_bytes(), "p12") == [{"kind": "encrypted"}]
