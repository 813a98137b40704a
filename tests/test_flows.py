"""Data flow of Python sources and values of Java expressions, on hand cases."""

import pytest

from vaultgrid.sources import data_flow, java_flow, token_scan


def events(source):
    """{(variable, line): [events in order]}"""
    out = {}
    for variable, line, _, _, event, at, place, _ in data_flow.scan(source):
        out.setdefault((variable, line), []).append((place or 0, event, at))
    return {k: [(e, at) for _, e, at in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize(
    "source, want",
    [
        ("k = cipher.encrypt(x)\nsend(k)\n", {("k", 1): [("send", 2)]}),
        ("k = cipher.encrypt(x)\n", {("k", 1): [(None, 1)]}),
        ("signal = design(x)\nuse(signal)\n", {}),
        ("k = cipher.encrypt(x)\nk = cipher.encrypt(y)\nput(k)\n", {("k", 1): [(None, 1)], ("k", 2): [("put", 3)]}),
        ("a, b = 1, 2\nk = os.urandom(3)\na, b = k, a\nput(b)\nput(a)\n", {("k", 2): [("put", 5)]}),
        ("k = os.urandom(3)\nd = {}\nd['x'] = k\nput(d)\n", {("k", 1): [("put", 4)]}),
        ("k = os.urandom(3)\nput(k.hex().upper())\n", {("k", 1): [("put", 2)]}),
        ("k = os.urandom(3)\nx = wrap(k)\nput(x)\n", {("k", 1): [("wrap", 2)]}),
        ("k = os.urandom(3)\nput([c for c in k if ok(c)])\n", {("k", 1): [("put", 2), ("ok", 2)]}),
        ("k = os.urandom(3)\nput(len(k) > 3)\n", {("k", 1): [("len", 2)]}),
        ("k = os.urandom(3)\nput(lambda: k)\n", {("k", 1): [("put", 2)]}),
        ("def f():\n    if a:\n        k = os.urandom(3)\n        return k\n    put(k)\n", {("k", 3): [(None, 3)]}),
        ("def f():\n    for x in y:\n        if x:\n            k = os.urandom(3)\n            break\n    else:\n        k = None\n    put(k)\n", {("k", 4): [("put", 8)]}),
        ("def f():\n    while True:\n        put(c)\n        c = b\n        b = a\n        a = os.urandom(3)\n", {("a", 6): [("put", 3)]}),
        ("def f():\n    try:\n        k = os.urandom(3)\n        risky()\n    except E:\n        put(k)\n    finally:\n        done(k)\n", {("k", 3): [("put", 6), ("done", 8)]}),
        ("def f(v):\n    k = os.urandom(3)\n    match k:\n        case [a, *rest]:\n            put(rest)\n        case {'x': y}:\n            get(y)\n", {("k", 2): [("put", 5), ("get", 7)]}),
        ("def f():\n    k = os.urandom(3)\n    def g():\n        put(k)\n    g()\ndef h(k):\n    get(k)\n", {("k", 2): [("put", 4)]}),
        ("class A:\n    def a(self):\n        put(self.k)\n    def b(self):\n        k = os.urandom(3)\n        self.k = k\n", {("k", 5): [("put", 3)]}),
        ("def f():\n    put(k)\n    k = os.urandom(3)\n", {("k", 3): [(None, 3)]}),
        ("k = os.urandom(3)\ndel k\nput(k)\n", {("k", 1): [("del k", 2)]}),
        ("with os.urandom(3) as x:\n    k = x.token()\nput(k)\n", {("k", 2): [("put", 3)]}),
        ("k: bytes = os.urandom(3)\nk += b'x'\nput(k)\n", {("k", 1): [("put", 3)]}),
    ],
)
def test_events(source, want):
    assert events(source) == want


CASES = [
    ("def handle(sock, plain):\n    session_key = cipher.encrypt(plain)\n    sock.sendall(session_key)\n", ("session_key", "EPHEMERAL", "HIGH", False, "E2_REACHABLE_PATH", "Network socket")),
    ("def sign(m):\n    token = hmac.sign(m)\n    del token\n", ("token", "EPHEMERAL", "HIGH", False, "E2_REACHABLE_PATH", "del token")),
    ("def keep(u, t):\n    auth_token = cipher.encrypt(t)\n    redis.setex(f'session:{u}', 3600, auth_token)\n", ("auth_token", "SHORT_TERM", "HIGH", False, "E2_REACHABLE_PATH", "redis.setex")),
    ("def add(c):\n    pan = cipher.encrypt(c)\n    db.session.add(pan)\n    db.session.commit()\n", ("pan", "OPERATIONAL", "HIGH", False, "E2_REACHABLE_PATH", "database persistence sink")),
    ("def up(p):\n    blob = cipher.encrypt(p)\n    s3.put_object(Bucket='b', Key='k', Body=blob)\n", ("blob", "ARCHIVAL", "HIGH", False, "E2_REACHABLE_PATH", "cloud object storage")),
    ("def out(api, raw):\n    opaque = cipher.encrypt(raw)\n    api.push(opaque)\n", ("opaque", "HUMAN_REVIEW", "LOW", True, "E1_STATIC_ARTIFACT", "unanalyzed function")),
    ("def none(raw):\n    local = cipher.encrypt(raw)\n    return 1\n", ("local", "EPHEMERAL", "MEDIUM", False, "E1_STATIC_ARTIFACT", "flows into no sink")),
    ("def broken(:\n    x = cipher.encrypt(\n", ("syntax_error", "HUMAN_REVIEW", "LOW", True, "E0_UNCONFIRMED", "does not parse")),
]


def test_tiers(spark):
    files = spark.createDataFrame([(f"{i}.py", s) for i, (s, _) in enumerate(CASES)] + [("null.py", None), ("empty.py", "")], "path string, content string")
    got = {r["path"]: r for r in data_flow.traced(files).collect()}
    assert len(got) == len(CASES)
    for i, (_, want) in enumerate(CASES):
        r = got[f"{i}.py"]
        assert (r["variable"], r["tier"], r["confidence"], r["review_required"], r["evidence_level"]) == want[:5]
        assert want[5] in r["evidence"]


def test_levels_of_agility_and_intent(spark):
    sources = ["k = os.getenv('A') or x\nv = cipher.encrypt(k)\nput(v)\n", "v = cipher.new('AES')\nput(v)\n", "v = cipher.new(name)\nput(v)\n", "v = kyber.encrypt(1)\nput(v)\n", "access_token = cipher.new('AES')\nput(access_token)\n"]
    files = spark.createDataFrame([(f"{i}", s) for i, s in enumerate(sources)], "path string, content string")
    got = {r["path"]: (r["agility_level"], r["intent_class"]) for r in data_flow.traced(files).collect()}
    assert got == {"0": (1, "CONFIDENTIALITY_ENVELOPE"), "1": (0, "CONFIDENTIALITY_ENVELOPE"), "2": (1, "CONFIDENTIALITY_ENVELOPE"), "3": (5, "CONFIDENTIALITY_ENVELOPE"), "4": (0, "AUTHENTICATION_SIGNATURE")}


def java(body):
    text = body if body.startswith("class") else "class A { %s }" % body
    return [(r[3], r[6]) for r in token_scan.scan(text.replace("<<", "MessageDigest.getInstance(").replace(">>", ");"), "java")]


LOST = ("DYNAMIC_UNRESOLVED", "PARAMETER")


@pytest.mark.parametrize(
    "body, want",
    [
        ('void f(){ String a="MD5"; <<a>> } void g(){ String a="SHA-1"; <<a>> }', [("MD5", "STATIC"), ("SHA-1", "STATIC")]),
        ('String a="MD5"; void f(){ String a="SHA-256"; <<a>> <<this.a>> } void g(){ <<a>> }', [("SHA-256", "STATIC"), ("MD5", "STATIC")]),
        ('void f(){ String a="MD5"; { String b="x"; a="SHA-1"; } <<a>> }', [("SHA-1", "STATIC")]),
        ('void f(boolean b){ <<b ? "MD5" : "MD5">> <<b ? "MD5" : "SHA-1">> <<true ? "SHA-256" : "MD5">> }', [("MD5", "STATIC"), LOST, ("SHA-256", "STATIC")]),
        ('void f(){ if (false) { <<"MD5">> } else { <<"SHA-1">> } }', [("SHA-1", "STATIC")]),
        ('static final int N = 3; void f(){ if (N > 2 && !(N == 4)) <<"SHA-1">> else <<"MD5">> }', [("SHA-1", "STATIC")]),
        ('static int N = 3; void g(){ N = 1; } void f(){ if (N > 2) <<"SHA-1">> else <<"MD5">> }', [("SHA-1", "STATIC"), ("MD5", "STATIC")]),
        ('void f(int n){ String a="MD5"; if (n > 2) a="SHA-1"; else a="SHA-1"; <<a>> }', [("SHA-1", "STATIC")]),
        ('void f(int n){ String a="MD5"; while (n-- > 0) { <<a>> a="SHA-1"; } }', [LOST]),
        ('void f(int n){ String a; switch (n) { case 1: a="MD5"; break; default: a="SHA-1"; } <<a>> }', [LOST]),
        ('void f(){ String a="MD5"; try { a="SHA-1"; g(); } catch (E e) { <<a>> } finally { <<a>> } }', [LOST]),
        ('static String h(){ return k().toUpperCase(); } static String k(){ return "sha" + -256; } void f(){ <<h()>> <<A.k()>> }', [("SHA-256", "STATIC")]),
        ('static String h(boolean b){ if (b) return "MD5"; return "SHA-1"; } void f(){ <<h(true)>> }', [LOST]),
        ('static String h(int n, String x){ return x; } void f(){ <<h(1, "MD5")>> <<h(2, "SHA-1")>> }', [("MD5", "STATIC"), ("SHA-1", "STATIC")]),
        ('static String h(String x){ return h(x); } void f(){ <<h("MD5")>> }', [LOST]),
        ('void f(){ Map<String, String> m = new HashMap<>(); m.put("x", "MD5"); <<m.get("x")>> <<m.get("y")>> }', [("MD5", "STATIC"), LOST]),
        ('void f(){ Runnable r = () -> { String b = "SHA-1"; <<b>> }; Object o = new Object() { String c = "MD5"; void g() { <<c>> } }; }', [("SHA-1", "STATIC"), ("MD5", "STATIC")]),
        ('void f(){ <<String.valueOf("MD5")>> <<(String) "SHA-1">> <<new String("SHA-256")>> <<"sha".concat("-512").replace("sha", "SHA")>> }', [("MD5", "STATIC"), ("SHA-1", "STATIC"), ("SHA-256", "STATIC"), ("SHA-512", "STATIC")]),
        ('class A { class B { static final String X = "MD5"; } void f(){ <<B.X>> <<a.b.B.X>> } }', [("MD5", "STATIC")]),
        ('void f(){ byte[] iv = new byte[16]; rnd.nextBytes(iv); new IvParameterSpec(iv); }', []),
        ('void f(){ byte[] iv = "0123456789".getBytes(); new IvParameterSpec(iv); }', [("STATIC-IV", "STATIC")]),
        ('void f(){ int n = 10; n *= 3; new PBEKeySpec(p, salt, n); int m = 100 * 5; new PBEKeySpec(p, salt, m); }', [("PBE-WEAK-ITERATION", "STATIC")]),
    ],
)
def test_java_values(body, want):
    got = java(body)
    assert got == list(dict.fromkeys(want)) or got == want


def test_java_callers_in_other_files(spark):
    a = 'class A { void f(String p) { Cipher.getInstance(p); } void g(String q) { Cipher.getInstance(q); } void h(String r) { Cipher.getInstance(r); } }'
    b = 'class B { void m(String t) { A x = new A(); x.f(t); } void n() { m("DES/CBC/PKCS5Padding"); A.g(K.NAME); other.h("AES"); } }'
    files = spark.createDataFrame([("s/A.java", a.replace(" void", "\n void")), ("s/B.java", b), ("s/K.java", 'class K { static final String NAME = "RC4"; }'), ("t/C.java", 'class C { void z() { A.h("RC2"); } }'), ("s/n.java", None), ("s/deep.java", "class D { void f() { " + "{" * 9000 + " } }")], "path string, content string")
    got = {(r["line_no"], r["algorithm"], r["origin"]) for r in java_flow.followed(token_scan.code_findings(files), files).where("path = 's/A.java'").collect()}
    assert got == {(2, "DES-CBC", "CALLER"), (3, "RC4", "CALLER"), (4, "DYNAMIC_UNRESOLVED", "PARAMETER")}


def test_java_walk_ends_on_any_tokens():
    import random

    words = 'class A { } ( ) ; = , . if else for while do try catch switch case : return new String "MD5" a b int + - == < && ? ! [ ] true 1 -> this f MessageDigest.getInstance( { } ( ) ; @X nextBytes'.split(" ")
    draw = random.Random(0)
    for _ in range(3000):
        token_scan.scan(" ".join(draw.choice(words) for _ in range(draw.randint(1, 80))), "java")
