"""Queries of data flow, registered by import: where the values of written sources end, and what their arguments are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import data_flow, imports, java_flow, token_scan
from .catalog import query
from .estate import pick, table
from .inventory import _list

#: Calls that get a value, and the tier that each stands for; the last two are no sink.
_CALLS = ["sock.sendall", "redis.setex", "db.session.add", "s3.put_object", "memcached.set", "repository.save", "vendor.push", "relay"]
_TIERS = ["EPHEMERAL", "SHORT_TERM", "OPERATIONAL", "ARCHIVAL", "SHORT_TERM", "OPERATIONAL", "HUMAN_REVIEW", "HUMAN_REVIEW"]
#: (source with a place for the call and one for a name, line of the event or 0 for none, events that the value meets, whether the event is a deletion)
_SHAPES = [
    ("def f(data):\n    <v> = cipher.encrypt(data)\n    <c>(<v>)\n", 3, 1, 0),
    ("def f(data):\n    <v> = cipher.encrypt(data)\n    other = <v>\n    third = (other, 1)\n    <c>('k', third)\n    unknown(<v>)\n", 5, 2, 0),
    ("def f(data, way):\n    <v> = hmac.digest(data)\n    if way:\n        out = <v>\n    else:\n        out = None\n    <c>(out)\n", 7, 1, 0),
    ("def f(data):\n    last = None\n    for x in data:\n        <c>(last)\n        <v> = box.seal(x)\n        last = <v>\n", 4, 1, 0),
    ("def f(data):\n    <v> = cipher.encrypt(data)\n    <c>(Body=[<v>, 1])\n", 3, 1, 0),
    ("def f(data):\n    <v> = cipher.encrypt(data)\n    <v> = None\n    <c>(<v>)\n", 0, 0, 0),
    ("def f(data):\n    <v> = cipher.encrypt(data)\n    del <v>\n    <c>(1)\n", 3, 1, 1),
    ("def f(data):\n    <v> = cipher.encrypt(data)\n    return None\n    <c>(<v>)\n", 0, 0, 0),
    ("def f(data):\n    <v> = cipher.encrypt(data)\n\n    def later():\n        return <c>(<v>)\n    return later\n", 5, 1, 0),
    ("class A:\n    def put(self):\n        <v> = os.urandom(32)\n        self.kept = <v>\n\n    def out(self):\n        while self.more():\n            try:\n                <c>(self.kept.hex())\n            finally:\n                pass\n", 9, 1, 0),
    ("async def f(data):\n    async with session() as s:\n        if (<v> := signer.sign(data)):\n            await <c>(f'{<v>}')\n", 4, 1, 0),
    ("def f(data:\n    <v> = cipher.encrypt(data)\n", 0, 0, 0),
]
_VARIABLES = ["secret", "jwt", "etag", "checksum", "blob"]
_LINE = [2, 2, 2, 5, 2, 2, 2, 2, 2, 3, 3, 1]


@query(
    f"""WITH k AS (SELECT p_partkey AS k, p_partkey % {len(_SHAPES)} AS shape, (p_partkey // {len(_SHAPES)}) % {len(_CALLS)} AS c, {_list(_VARIABLES)}[p_partkey % {len(_VARIABLES)} + 1] AS v FROM part),
    f AS (SELECT *, {_list(_CALLS)}[c + 1] AS called, {_list([x[1] for x in _SHAPES])}[shape + 1] AS pos, {_list([x[2] for x in _SHAPES])}[shape + 1] AS n, {_list([x[3] for x in _SHAPES])}[shape + 1] AS gone, shape = {len(_SHAPES) - 1} AS broken FROM k),
    g AS (SELECT *, CASE WHEN gone = 1 THEN 'del ' || v WHEN pos > 0 THEN called END AS event, pos > 0 AND gone = 0 AND {_list(_TIERS)}[c + 1] = 'HUMAN_REVIEW' AS escaped FROM f)
    SELECT 'p' || k || '.py' AS path, CASE WHEN broken THEN 'syntax_error' ELSE v END AS variable, CAST({_list(_LINE)}[shape + 1] AS INTEGER) AS line_no,
    CASE WHEN broken THEN 'HUMAN_REVIEW' WHEN gone = 1 OR pos = 0 THEN 'EPHEMERAL' ELSE {_list(_TIERS)}[c + 1] END AS tier,
    CASE WHEN broken OR escaped THEN 'LOW' WHEN pos = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, broken OR escaped AS review_required, event AS sink_call, CASE WHEN pos > 0 THEN CAST(pos AS INTEGER) END AS sink_line, CAST(n AS BIGINT) AS n_events,
    CASE WHEN broken THEN 'E0_UNCONFIRMED' WHEN pos = 0 OR escaped THEN 'E1_STATIC_ARTIFACT' ELSE 'E2_REACHABLE_PATH' END AS evidence_level,
    CASE WHEN broken THEN 'CONFIDENTIALITY_ENVELOPE' WHEN event IN ('redis.setex', 'memcached.set') THEN 'OPERATIONAL_UTILITY' WHEN event IN ('db.session.add', 's3.put_object', 'repository.save') THEN 'CONFIDENTIALITY_ENVELOPE'
      ELSE CASE v WHEN 'jwt' THEN 'AUTHENTICATION_SIGNATURE' WHEN 'etag' THEN 'OPERATIONAL_UTILITY' WHEN 'checksum' THEN 'INTEGRITY_CHECKSUM' ELSE
        CASE WHEN shape IN (5, 6, 7) AND called IN ('redis.setex', 'memcached.set') THEN 'OPERATIONAL_UTILITY' ELSE 'CONFIDENTIALITY_ENVELOPE' END END END AS intent_class FROM g""",
)
def python_data_flow(spark, sf):
    """Values through copies, branches, loops, closures, attributes, dead code and deletion; twelve shapes of source by eight calls."""
    k = F.col("p_partkey")
    n, m = len(_SHAPES), len(_CALLS)
    text = pick([s for s, *_ in _SHAPES], k % n)
    text = F.replace(F.replace(text, F.lit("<c>"), pick(_CALLS, F.floor(k / n) % m)), F.lit("<v>"), pick(_VARIABLES, k % len(_VARIABLES)))
    files = table(spark, sf, "part").select(F.concat(F.lit("p"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("content"))
    found = data_flow.traced(files)
    return found.select("path", "variable", "line_no", "tier", "confidence", "review_required", "sink_call", "sink_line", F.col("n_events").cast("long").alias("n_events"), "evidence_level", "intent_class")


#: Bodies with places for two names of algorithms and a number; which of the names is found: 1, 2, 0 (neither is certain), -1 (the code cannot run); the line.
_JAVA = [
    ('  byte[] f() {\n    String a = "<1>";\n    {\n      String b = "<2>";\n    }\n    return MessageDigest.getInstance(a).digest();\n  }\n  void g() { String a = "<2>"; }', 1, 7),
    ('  String a = "<2>";\n  byte[] f() {\n    String a = "<1>";\n    return MessageDigest.getInstance(a).digest();\n  }', 1, 5),
    ('  byte[] f(boolean b) {\n    String a = <n> > 2 ? "<1>" : "<2>";\n    return MessageDigest.getInstance(a).digest();\n  }', 3, 4),
    ('  static final int N = <n>;\n  byte[] f() {\n    String a = "<2>";\n    if (N * 2 >= 6) {\n      a = "<1>";\n    }\n    return MessageDigest.getInstance(a).digest();\n  }', 3, 8),
    ('  byte[] f(int n) {\n    String a = "<1>";\n    if (n > 2) a = "<2>";\n    return MessageDigest.getInstance(a).digest();\n  }', 0, 5),
    ('  static String pick(int n, String x) { return x.trim(); }\n  static String one() { return "<1>"; }\n  byte[] f() {\n    return MessageDigest.getInstance(pick(1, " " + one())).digest();\n  }', 1, 5),
    ('  byte[] f() {\n    if (false) {\n      return MessageDigest.getInstance("<1>").digest();\n    }\n    while (1 > 2) { MessageDigest.getInstance("<2>"); }\n    return null;\n  }', -1, 0),
    ('  byte[] f(int n) {\n    String a = "<1>";\n    for (int i = 0; i < n; i++) {\n      a = "<2>";\n    }\n    return MessageDigest.getInstance(a).digest();\n  }', 0, 7),
    ('  byte[] f() {\n    Map<String, String> m = new HashMap<>();\n    m.put("x", "<1>");\n    m.put("y", "<2>");\n    return MessageDigest.getInstance(m.get("x")).digest();\n  }', 1, 6),
    ('  byte[] f(String p) {\n    return MessageDigest.getInstance(p).digest();\n  }', 1, 3),
    ('  byte[] f() {\n    return MessageDigest.getInstance(Names.MAIN).digest();\n  }', 1, 3),
    ('  private final String kept;\n  A(String given) { this.kept = given; }\n  byte[] f() {\n    return MessageDigest.getInstance(kept).digest();\n  }', 1, 5),
]
#: Another file of the folder: it passes a name through two calls, keeps one as a constant, and builds an object with one.
_OTHER = 'class Names {\n  static final String MAIN = "<1>";\n  void a(A x) { b(x, "<1>"); new A("<1>"); }\n  void b(A x, String q) { x.f(q); }\n}'
_NAMES = ["MD5", "SHA-1", "SHA-256", "SHA-512", "MD2"]


def _java_sources(spark, sf):
    k, n = F.col("p_partkey"), len(_JAVA)
    body = F.concat(F.lit("class A {\n"), pick([b for b, *_ in _JAVA], k % n), F.lit("\n}\n"))
    fill = lambda text: F.replace(F.replace(F.replace(text, F.lit("<1>"), pick(_NAMES, k % 5)), F.lit("<2>"), pick(_NAMES, (k + 2) % 5)), F.lit("<n>"), (k % 6).cast("string"))
    at = lambda name: F.concat(F.lit("j"), k.cast("string"), F.lit(f"/{name}.java"))
    part = table(spark, sf, "part")
    return part.select(at("A").alias("path"), fill(body).alias("content")).unionByName(part.select(at("Names").alias("path"), fill(F.lit(_OTHER)).alias("content")))


@query(
    f"""WITH k AS (SELECT p_partkey AS k, {_list([x[1] for x in _JAVA])}[p_partkey % {len(_JAVA)} + 1] AS which, {_list([x[2] for x in _JAVA])}[p_partkey % {len(_JAVA)} + 1] AS line, p_partkey % {len(_JAVA)} AS shape, p_partkey % 6 AS n, {_list(_NAMES)}[p_partkey % 5 + 1] AS one, {_list(_NAMES)}[(p_partkey + 2) % 5 + 1] AS two FROM part)
    SELECT 'j' || k || '/A.java' AS path, CAST(line AS INTEGER) AS line_no, CASE which WHEN 1 THEN one WHEN 3 THEN CASE WHEN n > 2 THEN one ELSE two END ELSE 'DYNAMIC_UNRESOLVED' END AS algorithm, CASE WHEN shape IN (9, 10, 11) THEN 'CALLER' WHEN which = 0 THEN 'PARAMETER' ELSE 'STATIC' END AS origin FROM k WHERE which >= 0"""
)
def java_values(spark, sf):
    """Scopes, shadowing, branches that cannot run, helper methods, loops, maps, and what other files pass on, in twelve shapes of source."""
    files = _java_sources(spark, sf)
    return java_flow.followed(token_scan.code_findings(files), files).select("path", "line_no", "algorithm", "origin")


#: By key: what a script, a Go file, a Rust file and a Python file import, and what that is below the project's folder; * stands for the project's name, a name without a suffix is a package.
_SPECS = {
    "web/app.ts": [("import { a } from './lib/aes';", "web/lib/aes.ts"), ("const a = require('./lib/rsa')", "web/lib/rsa/index.js"), ("export * from '../web/lib/md5.mjs'", "web/lib/md5.mjs"), ("import 'node-forge/lib'", "node-forge"), ("import x from './lib/aes.js'", "web/lib/aes.ts")],
    "svc/main.go": [('import "*.org/x/a"', "svc/a/k.go"), ('import (\n\t"fmt"\n)', "fmt"), ('import b "*.org/x/a/b"', "svc/a/b/k.go")],
    "rs/src/main.rs": [("use crate::net::Tls;", "rs/src/net/mod.rs"), ("use crate::{util::Key};", "rs/src/util.rs"), ("use sha2::Sha256;", "sha2"), ("mod net;", "rs/src/net/mod.rs")],
    "py/pkg/core.py": [("from .keys import K", "py/pkg/keys.py"), ("import pkg.deep.er", "py/pkg/deep/er.py"), ("from . import keys", "py/pkg/keys.py"), ("import hashlib", "hashlib"), ("from pkg.deep import er", "py/pkg/deep/er.py"), ("from pkg.deep import Thing", "py/pkg/deep/__init__.py")],
}
_MEMBERS = ["web/lib/aes.ts", "web/lib/rsa/index.js", "web/lib/md5.mjs", "svc/a/k.go", "svc/a/k_test.go", "svc/a/b/k.go", "rs/src/net/mod.rs", "rs/src/util.rs", "py/pkg/keys.py", "py/pkg/deep/er.py", "py/pkg/deep/__init__.py"]


def _projects(spark, sf):
    """A project of four languages for each part."""
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    rows = [(p, F.lit("")) for p in _MEMBERS] + [("svc/go.mod", F.concat(F.lit("module "), name, F.lit(".org/x\n")))]
    rows += [(p, F.replace(pick([t for t, _ in specs], F.col("p_partkey") % len(specs)), F.lit("*"), name) if p == "svc/main.go" else pick([t for t, _ in specs], F.col("p_partkey") % len(specs))) for p, specs in _SPECS.items()]
    each = F.array(*[F.struct(F.concat(name, F.lit("/" + p)).alias("path"), content.alias("content")) for p, content in rows])
    # keys are dealt out first: a few MB of them make many files
    return table(spark, sf, "part").select("p_partkey").repartition("p_partkey").select(F.inline(each))


def _imported() -> str:
    each = []
    for p, specs in _SPECS.items():
        found = f"{_list([s for _, s in specs])}[p_partkey % {len(specs)} + 1]"
        each.append(f"SELECT CASE WHEN contains({found}, '.') THEN 'm' || p_partkey || '/' ELSE '' END || {found} AS src, 'm' || p_partkey || '/{p}' AS dst, NOT contains({found}, '.') AS external FROM part")
    return " UNION ALL ".join(each)


@query(_imported())
def module_edges(spark, sf):
    """Edges from the file, or the package from elsewhere, that an import means, across the folders of projects in four languages."""
    return imports.resolved(_projects(spark, sf)).select("src", "dst", "external")


@query(f"WITH e AS ({_imported()}), s AS (SELECT CASE WHEN external THEN src ELSE regexp_extract(src, '([^/]+?)(\\.[^./]*)?$', 1) END AS src, regexp_extract(dst, '([^/]+?)(\\.[^./]*)?$', 1) AS dst FROM e) SELECT DISTINCT src, dst FROM s WHERE src <> dst")
def module_network(spark, sf):
    return imports.by_stem(imports.resolved(_projects(spark, sf)))


#: Every rule of the scanners: a file's name, its lines, and the findings (line, rule, algorithm); the whole stands below as many empty lines as the key says.
_RULES = [
    ("K.java", 'class K implements X509TrustManager {\n  public void checkServerTrusted(X509Certificate[] c, String a) {}\n  void f(Socket s) throws Exception {\n    Cipher.getInstance("AES/GCM/NoPadding");\n    Signature.getInstance("SHA256withRSA");\n    KeyPairGenerator.getInstance("DSA");\n    KeyGenerator.getInstance("AES");\n    KeyAgreement.getInstance("ECDH");\n    Mac.getInstance("HmacMD5");\n    SecretKeyFactory.getInstance("PBKDF2");\n    SSLContext.getInstance("TLSv1.1");\n    new java.util.Random();\n    new Socket("h", 1);\n    byte[] iv = new byte[16];\n    rnd.nextBytes(iv);\n    new IvParameterSpec(iv);\n    new IvParameterSpec("0000".getBytes());\n    new SecretKeySpec("key".getBytes(), "AES");\n    new PBEKeySpec(p, salt, 10 * 99);\n    new PBEParameterSpec(salt, 5000);\n    r.setSeed(4);\n    ks.load(in, "changeit".toCharArray());\n    u = "http://plain.example";\n    v = "http://www.w3.org/x";\n  }\n}',
     [(1, "X509TrustManager", "DUMMY-CERT-VALIDATION"), (4, "jca:Cipher", "AES-GCM"), (5, "jca:Signature", "SHA256WITHRSA"), (6, "jca:KeyPairGenerator", "DSA"), (7, "jca:KeyGenerator", "AES"), (8, "jca:KeyAgreement", "ECDH"), (9, "jca:Mac", "HMACMD5"), (10, "jca:SecretKeyFactory", "PBKDF2"), (11, "jca:SSLContext", "TLSV1.1"), (12, "new:Random", "UNTRUSTED-PRNG"), (13, "new:Socket", "UNENCRYPTED-SOCKET"), (17, "new:IvParameterSpec", "STATIC-IV"), (18, "new:SecretKeySpec", "PREDICTABLE-KEY"), (19, "new:PBEKeySpec", "PBE-WEAK-ITERATION"), (21, "setSeed", "PREDICTABLE-SEED"), (22, "KeyStore.load", "PREDICTABLE-KEYSTORE-PASSWORD"), (23, "url", "CLEARTEXT-HTTP")]),
    ("H.java", "class H implements HostnameVerifier {\n  public boolean verify(String h, SSLSession s) { return true; }\n}\nclass I implements HostnameVerifier {\n  public boolean verify(String h, SSLSession s) {\n    if (h.isEmpty()) return false;\n    return true;\n  }\n}\nclass J implements X509TrustManager {\n  public void checkServerTrusted(X509Certificate[] c, String a) throws E { throw new E(); }\n}",
     [(1, "HostnameVerifier", "DUMMY-HOSTNAME-VERIFIER"), (4, "HostnameVerifier", "TLS-HOSTNAME-VERIFIER")]),
    ("j.ts", "ml_dsa65.sign(m);\nml_kem768.keygen();\nforge.pki.rsa.generateKeyPair({ bits: 3072 });\nrsaBlindService.signBlinded(x);\nconst p = constants.RSA_NO_PADDING;\ncrypto.generateKeyPairSync('ed25519');\ncrypto.createDecipheriv('aes-256-cbc', k, iv);\ncrypto.createHmac('sha256', k);\ncrypto.createVerify('RSA-SHA256');\njwt.sign(t);\ncreateHash('sha1');",
     [(1, "noble", "ML-DSA-65"), (2, "noble", "ML-KEM-768"), (3, "forge", "RSA-3072"), (4, "blind", "RSA-2048"), (5, "padding", "RSA-2048"), (6, "generateKeyPairSync", "ED25519"), (7, "createDecipheriv", "AES-256-CBC"), (8, "createHmac", "HMAC-SHA-256"), (9, "createVerify", "RSA-SHA256"), (10, "jwt", "JWT-HMAC-SHA256"), (11, "createHash", "SHA-1")]),
    ("r.rs", "struct U2048(u8);\nuse curve25519_dalek::ristretto::RistrettoPoint;\nconst LWE_Q: u64 = 1;\nstruct LweCiphertext;\nlet h = sha2::Sha512::new();",
     [(1, "struct", "RSA-2048"), (2, "dalek", "RISTRETTO255"), (3, "lwe", "LWE-2048"), (4, "lwe", "LWE-2048"), (5, "sha2", "SHA-512")]),
    ("s.rb", "c = OpenSSL::Cipher.new('aes-128-gcm')\nd = OpenSSL::Digest::SHA384.new\nOpenSSL::HMAC.digest('sha512', k, x)\nOpenSSL::KDF.scrypt(p)\nk = OpenSSL::PKey::EC.new(384)\nActiveSupport::MessageEncryptor.new(k)\nBCrypt::Password.create(p)\nJWT.decode(t, k, 'ES512')",
     [(1, "openssl:Cipher", "AES-128-GCM"), (2, "openssl:Digest", "SHA-384"), (3, "openssl:HMAC", "HMAC-SHA-512"), (4, "openssl:KDF", "SCRYPT"), (5, "openssl:PKey", "EC-384"), (6, "rails", "AES-256-GCM"), (7, "bcrypt", "BCRYPT"), (8, "jwt", "JWT-ES512")]),
]


@query(
    "WITH r(f, n, rule, algorithm) AS (VALUES " + ", ".join(f"('{f}', {n}, '{rule}', '{a}')" for f, _, found in _RULES for n, rule, a in found) + ") SELECT 'r' || s_suppkey || '/' || f AS path, CAST(n + s_suppkey % 7 AS INTEGER) AS line_no, rule, algorithm FROM supplier, r"
)
def scanner_rules(spark, sf):
    """Every rule of the scanners of Java, JavaScript, Rust and Ruby, each file some lines further down."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    files = None
    for name, text, _ in _RULES:
        one = s.select(F.concat(F.lit("r"), k.cast("string"), F.lit("/" + name)).alias("path"), F.concat(F.repeat(F.lit("\n"), (k % 7).cast("int")), F.lit(text)).alias("content"))
        files = one if files is None else files.unionByName(one)
    return token_scan.code_findings(files).select("path", "line_no", "rule", "algorithm")
