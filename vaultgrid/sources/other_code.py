"""Calls to cryptography in Java, JavaScript, Go, Rust and Ruby sources, by patterns over lines.

This reads what is written out at the call: a literal or the called type names
the algorithm, anything else is quarantined as unresolved. Lines that are
comments are left out. Values that reach a call through variables, fields or
other files are not followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import numbered_lines

SUFFIX = {"java": "java", "js": "javascript", "ts": "javascript", "go": "go", "rs": "rust", "rb": "ruby"}
#: By language: a call with the algorithm in group 1; group 2, if any, is a dynamic argument.
CALLS = {
    "java": r"(?:Cipher|MessageDigest|Signature|KeyPairGenerator|KeyGenerator|KeyAgreement|Mac|SecretKeyFactory)\.getInstance\(\s*(?:\"([^\"]+)\"|([A-Za-z_][\w.]*))",
    "javascript": r"\bcreate(?:Hash|Hmac|Cipheriv|Decipheriv|Sign|Verify)\(\s*(?:['\"]([^'\"]+)['\"]|([A-Za-z_][\w.]*))",
    "go": r"\b(md5|sha1|sha256|sha512|des|rc4|aes|rsa|ecdsa|ed25519)\.(?:New|Generate|Sum|Sign|Encrypt)\w*\(()",
    "rust": r"\b(Sha\d+|Md5|Aes\d+\w*|RsaPrivateKey|SigningKey|ChaCha20Poly1305)::(?:new|generate|from)\w*()",
    "ruby": r"\b(?:OpenSSL::)?(?:Digest|Cipher|PKey)(?:::(\w+)|\.new\(\s*(?:['\"]([^'\"]+)['\"])?)",
}


def calls(files: DataFrame) -> DataFrame:
    """(path, line_no, language, algorithm, resolved) of each call, in upper case."""
    lines = numbered_lines(files).where("NOT startswith(line, '//') AND NOT startswith(line, '#') AND NOT startswith(line, '*')")
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    language = F.try_element_at(F.create_map(*[F.lit(x) for pair in SUFFIX.items() for x in pair]), suffix)
    rows = None
    for name, pattern in CALLS.items():
        mine = lines.withColumn("language", language).where((F.col("language") == name) & F.col("line").rlike(pattern))
        hit = mine.select("path", "line_no", "language", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("call"))
        one, two = F.regexp_extract("call", pattern, 1), F.regexp_extract("call", pattern, 2)
        literal = F.when(one != "", one).when(F.lit(name == "ruby") & (two != ""), two)
        got = hit.select("path", "line_no", "language", F.coalesce(F.upper(literal), F.lit("DYNAMIC_UNRESOLVED")).alias("algorithm"), literal.isNotNull().alias("resolved"))
        rows = got if rows is None else rows.unionByName(got)
    return rows
