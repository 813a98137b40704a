"""Certificates and keys from their bytes: nested tag-length-value, X.509, PKCS#1, PKCS#8, SEC 1 and PKCS#12.

Only structures in the clear are read; what is encrypted is told as such, and
what does not parse has no fields. Texts in PEM armour are decoded first.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from datetime import datetime, timezone

INTEGER, BITS, OCTETS, OID, SEQUENCE, SET = 0x02, 0x03, 0x04, 0x06, 0x30, 0x31
PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]+)-----(.*?)-----END \1-----", re.S)

# --- fixed values: object identifiers
RSA, EC, DSA, ED25519 = "1.2.840.113549.1.1.1", "1.2.840.10045.2.1", "1.2.840.10040.4.1", "1.3.101.112"
CURVES = {"1.2.840.10045.3.1.7": ("ECDSA-P256", 256), "1.3.132.0.34": ("ECDSA-P384", 384), "1.3.132.0.35": ("ECDSA-P521", 521), "1.3.132.0.10": ("ECDSA-SECP256K1", 256)}
NAMES = {"2.5.4.3": "CN", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU", "2.5.4.6": "C", "2.5.4.9": "STREET", "0.9.2342.19200300.100.1.25": "DC", "0.9.2342.19200300.100.1.1": "UID"}
DATA, ENCRYPTED, CERT_BAG, KEY_BAG, SHROUDED = "1.2.840.113549.1.7.1", "1.2.840.113549.1.7.6", "1.2.840.113549.1.12.10.1.3", "1.2.840.113549.1.12.10.1.1", "1.2.840.113549.1.12.10.1.2"


class NotDer(ValueError):
    pass


class Node:
    """A tag with its content; ``whole`` is the bytes of both."""

    def __init__(self, data: bytes, at: int = 0):
        try:
            self.tag, n, at0 = data[at], data[at + 1], at
            at += 2
            if n & 0x80:
                k = n & 0x7F
                if not 0 < k <= 4:
                    raise NotDer("length")
                n = int.from_bytes(data[at : at + k])
                at += k
        except IndexError:
            raise NotDer("end") from None
        if at + n > len(data):
            raise NotDer("end")
        self.content, self.whole, self.end = data[at : at + n], data[at0 : at + n], at + n

    def __iter__(self):
        at = 0
        while at < len(self.content):
            child = Node(self.content, at)
            yield child
            at = child.end

    def parts(self, tag: int = SEQUENCE) -> list[Node]:
        if self.tag != tag:
            raise NotDer(f"tag {self.tag:#x}")
        return list(self)

    def number(self) -> int:
        if self.tag != INTEGER:
            raise NotDer("integer")
        return int.from_bytes(self.content, signed=True)

    def oid(self) -> str:
        if self.tag != OID or not self.content:
            raise NotDer("oid")
        out, value = [], 0
        for b in self.content:
            value = value << 7 | b & 0x7F
            if not b & 0x80:
                out.append(value)
                value = 0
        first = min(out[0] // 40, 2)
        return ".".join(map(str, [first, out[0] - 40 * first, *out[1:]]))

    def text(self) -> str:
        return self.content.decode({0x1E: "utf-16-be", 0x14: "latin-1"}.get(self.tag, "utf-8"), "replace")

    def time(self) -> str:
        text = self.content.decode("ascii", "replace")
        if self.tag == 0x17:  # two digits of a year, from 1950
            text = ("20" if text[:2] < "50" else "19") + text
        return datetime.strptime(text, "%Y%m%d%H%M%SZ").replace(tzinfo=timezone.utc).isoformat()


def escaped(text: str) -> str:
    out = re.sub(r'([,+"\\<>;])', r"\\\1", text).replace("\0", "\\00")
    if out[:1] in ("#", " "):
        out = "\\" + out
    return out[:-1] + "\\ " if out.endswith(" ") and not out.endswith("\\ ") else out


def name(node: Node) -> str:
    """A distinguished name, last part first."""
    rdns = []
    for rdn in node.parts():
        pairs = []
        for pair in rdn.parts(SET):
            kind, value = pair.parts()
            pairs.append(f"{NAMES.get(kind.oid(), kind.oid())}={escaped(value.text())}")
        rdns.append("+".join(pairs))
    return ",".join(reversed(rdns))


def key_of(algorithm: Node, bits: bytes | None) -> tuple[str, int] | None:
    """(algorithm, size) of an algorithm identifier and, for RSA, the key's structure."""
    kind, *more = algorithm.parts()
    kind = kind.oid()
    if kind == RSA and bits is not None:
        numbers = Node(bits).parts()
        n = numbers[0].number() if len(numbers) == 2 else numbers[1].number()  # a private key begins with its version
        return f"RSA-{n.bit_length()}", n.bit_length()
    if kind == EC and more and more[0].tag == OID:
        curve = more[0].oid()
        return CURVES.get(curve, (f"ECDSA-{curve}", 256))
    if kind == DSA and more and more[0].tag == SEQUENCE:
        p = more[0].parts()[0].number().bit_length()
        return f"DSA-{p}", p
    return ("Ed25519", 256) if kind == ED25519 else None


def public(spki: Node) -> tuple[str, int] | None:
    algorithm, bits = spki.parts()
    if bits.tag != BITS:
        raise NotDer("bits")
    return key_of(algorithm, bits.content[1:])


def certificate(data: bytes) -> dict:
    """The fields of an X.509 certificate."""
    node = Node(data)
    body = node.parts()[0].parts()
    body = body[1:] if body[0].tag == 0xA0 else body  # without the version
    serial, _, issuer, validity, subject, spki = body[:6]
    begins, ends = validity.parts()
    algorithm, size = public(spki) or ("X509-UNKNOWN", 2048)
    serial.number()
    return {
        "kind": "certificate", "algorithm": algorithm, "key_size": size, "fingerprint": hashlib.sha256(node.whole).hexdigest(), "subject": name(subject), "issuer": name(issuer),
        "not_before": begins.time(), "not_after": ends.time(),
    }


def private(data: bytes, label: str = "PRIVATE KEY") -> tuple[str, int] | None:
    """(algorithm, size) of a PKCS#8, PKCS#1 or SEC 1 key, by its label."""
    parts = Node(data).parts()
    if label == "RSA PRIVATE KEY":
        n = parts[1].number().bit_length()
        return f"RSA-{n}", n
    if label == "EC PRIVATE KEY":
        curve = next((p for p in parts[2:] if p.tag == 0xA0), None)
        return CURVES.get(Node(curve.content).oid()) if curve else None
    return key_of(parts[1], parts[2].content)


def keystore(data: bytes) -> list[dict]:
    """Certificates and keys of a PKCS#12 store that are not encrypted; one row of kind ``encrypted`` if some are."""
    out, hidden = [], False

    def bags(content: bytes):
        nonlocal hidden
        for bag in Node(content).parts():
            kind, value, *_ = bag.parts()
            kind, value = kind.oid(), Node(value.content)
            if kind == CERT_BAG:
                out.append(certificate(Node(value.parts()[1].content).content))
            elif kind == KEY_BAG:
                found = key_of(value.parts()[1], value.parts()[2].content)
                out.append({"kind": "private-key", "algorithm": found and found[0], "key_size": found and found[1], "fingerprint": hashlib.sha256(value.whole).hexdigest()})
            hidden |= kind == SHROUDED

    _, safe, *_ = Node(data).parts()
    kind, content = safe.parts()
    if kind.oid() != DATA:
        raise NotDer("no store")
    for info in Node(Node(content.content).content).parts():
        kind, *content = info.parts()
        if kind.oid() == DATA:
            bags(Node(content[0].content).content)
        hidden |= kind.oid() == ENCRYPTED
    return out + [{"kind": "encrypted"}] * hidden


def read(data: bytes, suffix: str) -> list[dict]:
    """What a file holds, the first certificate before keys, as the first one counts; nothing if it is neither."""
    try:
        if suffix in ("p12", "pfx"):
            try:
                return keystore(data)
            except (ValueError, IndexError):
                return [{"kind": "encrypted"}]
        blocks = []
        for m in PEM.finditer(data):
            try:
                body = base64.b64decode(re.sub(rb"(?m)^[A-Za-z-]+:.*$", b"", m[2]))  # without the headers of old encrypted keys
            except binascii.Error:
                body = b""
            blocks.append((m[1].decode(), body, b"ENCRYPTED" in m[2] or m[1].startswith(b"ENCRYPTED")))
        for label, body, _ in blocks:
            if label in ("CERTIFICATE", "X509 CERTIFICATE", "TRUSTED CERTIFICATE"):
                try:
                    return [certificate(body)]
                except (ValueError, IndexError):
                    pass
        if not blocks:
            try:
                return [certificate(data)]
            except (ValueError, IndexError):
                return []
        for label, body, locked in blocks:
            kind = "private-key" if "PRIVATE KEY" in label else "public-key" if "PUBLIC KEY" in label else None
            if kind:
                found = None
                try:
                    if not locked:
                        found = private(body, label) if kind == "private-key" else public(Node(body)) if label == "PUBLIC KEY" else None
                        if label == "RSA PUBLIC KEY":
                            n = Node(body).parts()[0].number().bit_length()
                            found = f"RSA-{n}", n
                except (ValueError, IndexError):
                    pass
                return [{"kind": kind, "algorithm": found and found[0], "key_size": found and found[1], "fingerprint": hashlib.sha256(data).hexdigest()}]
        return []
    except RecursionError:
        return []


def encoded(tag: int, *parts: bytes) -> bytes:
    """A tag with its length round the parts."""
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + size + body


def encoded_oid(dotted: str) -> bytes:
    a, b, *rest = map(int, dotted.split("."))
    out = b""
    for v in [40 * a + b, *rest]:
        seven = [v & 0x7F]
        while v := v >> 7:
            seven.append(0x80 | v & 0x7F)
        out += bytes(reversed(seven))
    return encoded(OID, out)
