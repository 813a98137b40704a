"""Readers, sinks, registry and the entry module on small literal inputs."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from vaultgrid.operators import documents, registry
from vaultgrid.plans import catalog, scans
from vaultgrid.sources import material, python_code, texts

REPO = Path(__file__).resolve().parent.parent


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_corpus_skips_excluded_paths(spark, tmp_path):
    for name, text in {"src/a.py": "import os", "docs/b.py": "x", "node_modules/c.js": "x", "src/d.txt": "x", "requirements.txt": "oqs"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: r["content"] for r in texts.corpus(spark, str(tmp_path), [".py", ".txt"]).collect()}
    assert got == {"src/a.py": "import os", "requirements.txt": "oqs"}


def test_readers_take_null_and_broken_content(spark):
    odd = files(spark, ("a", None), ("b", ""), ("c", "{not json"), ("compose.yaml", "a: [unclosed"))
    for read in (texts.npm, texts.cargo, texts.go_mod, texts.requirements, texts.maven, texts.tls_directives, texts.ddl_lifespans, texts.model_lifespans, texts.exposures, python_code.python_facts):
        assert all(r["path" if "path" in r else "manifest_path"] is not None for r in (x.asDict() for x in read(odd).collect()))


def test_trace_lines(spark):
    lines = spark.createDataFrame([("EVP_ENCRYPT_INIT pid=7 comm=app cipher=aes-256-gcm",), ("EVP_ENCRYPT_INIT",), ("EVP_DIGEST_INIT md=sha256",), ("SSL_CIPHER_LIST str=A:B",), ("noise",), (None,)], "value string")
    got = [(r["algorithm"], r["key_size"], r["pid"]) for r in texts.trace_events(lines).collect()]
    assert got == [("AES-256-GCM", 256, "7"), ("OPENSSL-EVP-CIPHER", None, "unknown"), ("SHA256", None, "unknown"), ("A", None, "unknown")]


def test_unparsed_python_is_reported(spark):
    got = python_code.python_facts(files(spark, ("a.py", "import (:"), ("b.py", "x = 1"))).collect()
    assert [(r["path"], r["kind"]) for r in got] == [("a.py", "unparsed")]


def test_line_sinks_replace(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "asset_seq long, line string")
    for _ in range(2):
        documents.write_lines(df, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_registry(spark):
    now = spark.createDataFrame([(1, "a", "old", "s")], "id long, name string, created_at string, status string")
    new = spark.createDataFrame([(1, "b", "new", "t"), (2, "c", "new", "t")], "id long, name string, created_at string, status string")
    assert sorted(tuple(r) for r in registry.upsert(now, new).collect()) == [(1, "b", "old", "s"), (2, "c", "new", "t")]
    with pytest.raises(ValueError):
        registry.update(now, "id", 1, {"id": 9}, {"name"})
    assert registry.upsert(now.limit(0), new.limit(0)).count() == 0


def test_entry_works_without_the_training_operators(tmp_path):
    for name in ("vaultgrid", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "vaultgrid" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'risk_summary' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_map_lookup(spark):
    lines = spark.createDataFrame([(1, '{"bom-ref":"A","name":"X","properties":[{"name":"k","value":"1"},{"name":"k","value":"2"}]}')], "asset_seq long, line string")
    assert documents.properties(lines).select(F.col("p")["k"].alias("v")).first()["v"] == "1"


POM = """<project><parent><groupId>com.acme</groupId><version>9</version></parent><artifactId>app</artifactId>
<properties><java.version>17</java.version><java-version>x</java-version><bc.v>${major}.2</bc.v><major>1</major></properties>
<dependencyManagement><dependencies><dependency><groupId>org.jasypt</groupId><artifactId>jasypt</artifactId><version>${bc.v}</version></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>org.bouncycastle</groupId><artifactId>bcprov-jdk18on</artifactId><version>${bc.v}-jdk${java.version}</version></dependency>
<dependency><groupId>org.jasypt</groupId><artifactId>jasypt</artifactId></dependency>
<dependency><groupId>com.acme</groupId><artifactId>core</artifactId><version>${project.version}</version></dependency>
<dependency><groupId>x</groupId><artifactId>y</artifactId><version>${missing}</version></dependency></dependencies></project>"""


def test_maven_placeholders_managed_versions_and_own_modules(spark):
    got = {r["package"]: r["version"] for r in texts.maven(files(spark, ("pom.xml", POM))).collect()}
    assert got == {"org.bouncycastle:bcprov-jdk18on": "1.2-jdk17", "org.jasypt:jasypt": "1.2", "x:y": "managed"}


def test_a_module_without_facts_is_local(spark):
    both = files(spark, ("pkg/shared.py", "X = 1"), ("app.py", "import pkg.shared"))
    assert [tuple(r) for r in python_code.import_edges(python_code.python_facts(both), both).collect()] == [("shared", "app")]


def test_journal_folds_every_action(spark):
    journal = spark.createDataFrame([(i, "b", "a", now) for i, now in ((1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "b"))], "tx_id int, sha_before string, sha_after string, sha_now string")
    steps = {1: ["undo"], 2: ["undo", "redo"], 3: ["undo", "redo", "undo"], 4: ["redo"], 5: ["undo", "undo"]}
    actions = spark.createDataFrame([(k, i, a) for k, v in steps.items() for i, a in enumerate(v)], "tx_id int, pos int, action string")
    assert {r["tx_id"]: r["state"] for r in registry.journal_state(journal, actions).collect()} == {1: "REVERTED", 2: "APPLIED", 3: "REVERTED", 4: "REFUSED", 5: "REFUSED"}


def test_knapsacks_are_the_same_without_the_items_that_cannot_count(spark):
    import numpy as np

    from vaultgrid.operators import portfolio

    rng = np.random.default_rng(4)
    rows = [("p", i, f"A{i}", float(v), float(c), round(float(v / c), 3)) for i, (v, c) in enumerate(zip(rng.integers(0, 9, 400), rng.integers(1, 6, 400) / 2))]
    items = spark.createDataFrame(rows, "portfolio string, asset_seq long, asset_id string, delta_r double, cost_dev_weeks double, efficiency double")
    kept = portfolio.optimal(items, "portfolio", 10.0).where("is_selected")
    order = sorted((r for r in rows if r[3] > 0), key=lambda r: (-r[5], -r[3], r[4], r[1]))
    chosen = portfolio.knapsack(np.array([round(r[4] * 100) for r in order]), np.array([r[3] for r in order]), 1000)
    assert sorted(r["asset_seq"] for r in kept.collect()) == sorted(r[1] for r, c in zip(order, chosen) if c)
    spent, ids = 0, []
    for r in order:
        if spent + round(r[4] * 100) <= 1000:
            spent, ids = spent + round(r[4] * 100), [*ids, r[2]]
    got = portfolio.greedy(items, "portfolio", 10.0).first()
    assert (got["weeks"], got["asset_ids"]) == (spent / 100, ",".join(ids))
    assert portfolio.contenders(items, "portfolio", 1000, "asset_seq").count() < 60


def found(source, language):
    from vaultgrid.sources import token_scan

    return [(line, algorithm, origin, key) for line, _, _, algorithm, _, _, origin, key, _ in token_scan.scan(source, language)]


def test_java_constants_comments_and_misuse():
    source = """import javax.crypto.*;
class A { static final String ALG = "AES" + "/ECB/" + "PKCS5Padding"; // Cipher.getInstance("DES")
 void f(String p) { Cipher c = Cipher.getInstance(A.ALG); Mac.getInstance(p);
 new Random(); new PBEKeySpec(pw, salt, 100); new PBEKeySpec(pw, salt, 200000);
 ks.load(in, "secret".toCharArray()); ks.load(in, pw);
 String u = "http://x.com", v = "http://www.w3.org/x";
 /* new Socket() */ new Socket(h, 1); new SecretKeySpec("k".getBytes(), "AES"); new SecretKeySpec(raw, "AES");
 KeyPairGenerator.getInstance("DSA"); SSLContext.getInstance("TLSv1.2"); } }"""
    assert [(line, a) for line, a, _, _ in found(source, "java")] == [
        (3, "AES-ECB"), (3, "DYNAMIC_UNRESOLVED"), (4, "UNTRUSTED-PRNG"), (4, "PBE-WEAK-ITERATION"), (5, "PREDICTABLE-KEYSTORE-PASSWORD"), (6, "CLEARTEXT-HTTP"), (7, "UNENCRYPTED-SOCKET"), (7, "PREDICTABLE-KEY"), (8, "DSA"), (8, "TLSV1.2"),
    ]


def test_script_arguments_tell_where_they_come_from():
    source = "a = createHash(process.env.H || 'md5')\nb = crypto.createHash(config.get('h'))\nc = crypto.createHash(row.alg)\nd = crypto.createHash('sha' + '-256'.trim())\ne = crypto.createHash(x)\nlet x = 'md5'; x = 'sha1'\nforge.pki.rsa.generateKeyPair({bits: 4096}); ml_kem768.keygen(); jwt.sign(t)"
    assert found(source, "javascript") == [
        (1, "MD5", "ENV", "H"), (2, "DYNAMIC_UNRESOLVED", "CONFIG", "h"), (3, "DYNAMIC_UNRESOLVED", "DATABASE", "row.alg"), (4, "SHA-256", "STATIC", ""), (5, "DYNAMIC_UNRESOLVED", "PARAMETER", "x"),
        (7, "RSA-4096", "STATIC", ""), (7, "ML-KEM-768", "STATIC", ""), (7, "JWT-HMAC-SHA256", "STATIC", ""),
    ]


def test_go_rust_and_ruby():
    assert [a for _, a, _, _ in found('package m\nimport d "crypto/des"\nimport "fmt"\nfunc f() { d.NewCipher(k); fmt.Print(1) }', "go")] == ["crypto/des.NewCipher"]
    assert [a for _, a, _, _ in found("use curve25519_dalek::ristretto::X;\nuse sha2::Sha512;\nstruct U2048(u8);\nconst LWE_Q: u32 = 1;", "rust")] == ["RISTRETTO255", "SHA-512", "RSA-2048", "LWE-2048"]
    ruby = "c = OpenSSL::Cipher.new('aes-128-cbc')\nd = OpenSSL::Digest::SHA1.new # OpenSSL::Cipher.new('des')\nOpenSSL::HMAC.hexdigest('sha256', k, x)\nOpenSSL::KDF.hkdf(k)\nBCrypt::Password.create(p)\nJWT.encode(p, k, 'RS256')\nActiveSupport::MessageEncryptor.new(k)"
    assert [a for _, a, _, _ in found(ruby, "ruby")] == ["AES-128-CBC", "SHA-1", "HMAC-SHA-256", "HKDF", "BCRYPT", "JWT-RS256", "AES-256-GCM"]


def test_code_scan_takes_odd_files(spark):
    from vaultgrid.sources import token_scan

    odd = files(spark, ("a.java", None), ("b.js", ""), ("c.go", "crypto \"unclosed"), ("d.py", "crypto"), ("e.rb", "OpenSSL::" * 2000), ("f.ts", "crypto.createHash(" * 2000))
    assert {r["path"] for r in token_scan.code_findings(odd).collect()} <= {"f.ts"}


def test_registered_signatures_replace_and_come_last(spark):
    from vaultgrid.operators import lookups

    dim = lookups.signatures(spark).select("ord", "id", "symbol")
    new = spark.createDataFrame([("go.crypto.md5.new", "Other"), ("zz", "New")], "id string, symbol string")
    got = {r["id"]: (r["ord"], r["symbol"]) for r in lookups.register(dim, new).collect()}
    assert len(got) == 47 and got["go.crypto.md5.new"] == (46, "Other") and got["zz"] == (47, "New")


def test_weakness_of_nothing_known(spark):
    from vaultgrid.operators import lookups

    rows = spark.createDataFrame([(1, None, "x"), (2, "", "GOST"), (3, "nothing", "uses 3DES")], "id int, cwe string, name string")
    got = lookups.weakness_of(rows, lookups.weaknesses(spark), ["cwe", "name"])
    assert {r["id"]: r["cwe_id"] for r in got.collect()} == {1: None, 2: None, 3: "CWE-327"}


def test_a_new_language_can_be_added(spark):
    from vaultgrid.sources import token_scan

    def kotlin(source):
        for i, chain, _ in source.chains():
            if chain == "Crypto.weak":
                yield i, token_scan.Found("kt", "MD5", "HASH")

    got = token_scan.code_findings(files(spark, ("a.kt", "val x = Crypto.weak(1)"), ("b.js", "crypto.createHash('md5')")), {"kt": "kotlin"}, {"kotlin": kotlin}).collect()
    assert sorted((r["path"], r["language"], r["algorithm"]) for r in got) == [("a.kt", "kotlin", "MD5"), ("b.js", "javascript", "MD5")]


def test_scans_begin_and_end(spark):
    projects, history = registry.empty_tables(spark)
    projects = projects.unionByName(spark.createDataFrame([(1, "a", "p", "t0", None, True, 1, "IDLE"), (2, "b", "q", "t0", None, True, 1, "IDLE")], registry.PROJECTS))
    projects, history = registry.begun(projects, history, 1, 7, "t1")
    assert {r["id"]: r["status"] for r in projects.collect()} == {1: "SCANNING", 2: "IDLE"}
    projects, history = registry.ended(projects, history, 7, "t2", "READY", 5, 1)
    assert {r["id"]: (r["status"], r["last_scanned"]) for r in projects.collect()} == {1: ("READY", "t2"), 2: ("IDLE", None)}
    assert [tuple(r)[3:] for r in history.collect()] == [("t2", "READY", 5, 1)]
    after = projects.unionByName(projects.where("id = 2").withColumn("id", F.lit(3).cast("long")))
    assert sorted(r["id"] for r in registry.changed(registry.empty_tables(spark)[0].unionByName(projects.where("id = 2")), after, "id", "status").collect()) == [1, 3]


def test_artifacts_that_are_missing_or_broken(spark, tmp_path):
    from vaultgrid.sources import artifacts

    assert artifacts.artifact(spark, str(tmp_path / "none.json"), "a int").count() == 0
    for name, text in (("p1", '{"a": 1}'), ("p2", '{"a": 2}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "bill.json").write_text(text)
    (tmp_path / "broken.json").write_text('{"a": ')
    assert artifacts.artifact(spark, str(tmp_path / "broken.json"), "a int").count() == 0
    assert sorted(tuple(r) for r in artifacts.projects(spark, str(tmp_path), "bill.json", "a int").collect()) == [(1, "p1"), (2, "p2")]
    sheet = spark.createDataFrame([("s", 1, "T1", "c1", "A.java, B.java", "yes"), ("s", 2, "", "c2", "C.java", "no"), ("s", 3, "T2", "", "", ""), ("s", 4, "", "c3", "D.java", None)], "sheet string, line_no int, tier string, case string, files string, expected string")
    assert sorted(tuple(r) for r in artifacts.ground_truth(sheet).collect()) == [("T1", "c1", "A.java", True), ("T1", "c1", "B.java", True), ("T1", "c2", "C.java", False), ("T2", "c3", "D.java", False)]


def test_command_line(spark, tmp_path, capsys):
    from vaultgrid.__main__ import main

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text('class A { Object f() { return Cipher.getInstance("DES/ECB/PKCS5Padding"); } }')
    (tmp_path / "src" / "b.go").write_text('package m\nimport "crypto/sha256"\nfunc f() { sha256.New() }')
    assert main(["list"]) == 0 and "risk_summary" in capsys.readouterr().out
    assert main(["scan", str(tmp_path), "--fail-on", "critical"], spark) == 1
    assert main(["scan", str(tmp_path), "--fail-on", "critical", "--max", "1", "--out", str(tmp_path / "out")], spark) == 0
    assert sorted(r["algorithm"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["DES-ECB", "SHA-256"]
    assert main(["run", "top_algorithms", "/root/testdata/sf0.001"], spark) == 0


def test_serial_numbers_are_no_sizes_of_curves(spark):
    paths = {"k/key521.pem": "blob", "k/key1384.pem": "blob", "k/5210.pem": "blob", "k/p384.pem": "ECDSA-P384", "k/a-secp521r1.key": "ECDSA-P521", "k/ecdsa_p384/x.pem": "ECDSA-P384", "k/384/x.pem": "ECDSA-P384", "k/my-521.pem": "ECDSA-P521"}
    doc = '{"components":[%s]}' % ",".join('{"name":"blob","cryptoProperties":{"assetType":"related-crypto-material","relatedCryptoMaterialProperties":{"type":"private-key","size":0}},"evidence":{"occurrences":[{"location":"%s"}]}}' % p for p in paths)
    docs = spark.createDataFrame([(1, doc)], "doc_seq long, content string")
    none = spark.createDataFrame([], "path string, sha string, sample string, fingerprint string")
    assert {r["path"]: r["algorithm"] for r in material.material(docs, none).collect()} == paths


def test_foreign_material_agrees_with_its_sql_where_serial_numbers_look_like_sizes(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT unnest([384, 385, 521, 1384, 3841, 5212, 13844]) AS s_suppkey) TO '{tmp_path}/supplier.parquet'")
    got = scans.foreign_material(spark, f"file://{tmp_path}")
    want = duckdb.sql(f"WITH supplier AS (FROM '{tmp_path}/supplier.parquet') SELECT * FROM ({catalog.ORACLES['foreign_material']})")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
