"""Further queries: guidance, documents, registry, rewriting, source code; imported by the catalog for its registrations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import documents, guidance, registry
from ..operators import graph
from ..sources import other_code, python_code, texts
from ..streaming import traces
from . import estate
from .catalog import _files, _trace_lines, query, scored
from .estate import SCORED_SQL, table

_TARGET = """CASE WHEN regexp_matches(u, 'ML-DSA|ML-KEM|DILITHIUM|KYBER|SLH-DSA|FALCON|LWE') THEN algorithm WHEN u = 'DYNAMIC_UNRESOLVED' THEN 'MANUAL-TRIAGE'
  WHEN primitive_type = 'HASH' OR regexp_matches(u, 'SHA-256|SHA-384|SHA-512|SHA256|SHA3') THEN algorithm
  WHEN primitive_type = 'SIGNATURE' OR regexp_matches(u, 'DSA|ED25519|ED448') OR (intent_class IN ('AUTHENTICATION_SIGNATURE', 'INTEGRITY_CHECKSUM') AND primitive_type <> 'KEY_EXCHANGE' AND NOT regexp_matches(u, 'DH|X25519')) THEN
    CASE WHEN coalesce(key_size, 0) >= 4096 OR (x_tier = 'ARCHIVAL' AND coalesce(key_size, 0) >= 384) THEN 'ML-DSA-87' WHEN (key_size BETWEEN 1 AND 1024 AND NOT regexp_matches(u, '256|384')) OR u LIKE '%1024%' THEN 'ML-DSA-44' ELSE 'ML-DSA-65' END
  WHEN primitive_type = 'KEY_EXCHANGE' THEN CASE WHEN coalesce(key_size, 0) >= 4096 OR (x_tier = 'ARCHIVAL' AND coalesce(key_size, 0) > 2048) THEN 'ML-KEM-1024' WHEN (key_size BETWEEN 1 AND 1024 AND NOT regexp_matches(u, '256|384')) OR u LIKE '%1024%' THEN 'ML-KEM-512' ELSE 'ML-KEM-768' END
  WHEN regexp_matches(u, 'AES|DES|RC4') THEN 'AES-256-GCM' ELSE 'ML-KEM-768' END"""
_RULE = """CASE WHEN ((u LIKE '%RSA%' OR (u LIKE '%DH%' AND u NOT LIKE '%ECDH%') OR (u LIKE '%DSA%' AND u NOT LIKE '%ECDSA%' AND u NOT LIKE '%ML-DSA%')) AND key_size < 2048) OR (primitive_type IN ('ENCRYPTION', 'SYMMETRIC_CIPHER') AND key_size < 128) THEN 'CWE-326'
  WHEN regexp_matches(u, 'DES|RC4|IDEA|MD5|SHA-1|SHA1|ECB') OR is_broken THEN 'CWE-327' WHEN primitive_type = 'SIGNATURE' OR regexp_matches(u, 'SIGN|DSA|ED25519') THEN 'MIGRATE-FIPS204' WHEN primitive_type = 'KEY_EXCHANGE' OR regexp_matches(u, 'DH|KEM|KYBER|RSA') THEN 'MIGRATE-FIPS203' ELSE 'CWE-326' END"""


@query(f"WITH {SCORED_SQL}, t AS (SELECT asset_id, {_TARGET} AS target FROM scored) SELECT *, CASE WHEN regexp_matches(target, '^ML-DSA-(44|65|87)$') THEN 'FIPS 204' WHEN regexp_matches(target, '^ML-KEM-(512|768|1024)$') THEN 'FIPS 203' WHEN target = 'AES-256-GCM' THEN 'SP 800-38D' ELSE 'NONE' END AS standard FROM t")
def migration_targets(spark, sf):
    return guidance.advised(scored(spark, sf)).select("asset_id", "target", "standard")


@query(f"WITH {SCORED_SQL} SELECT {_RULE} AS rule_id, CASE WHEN risk_level IN ('CRITICAL', 'HIGH') THEN 'error' WHEN risk_level IN ('MEDIUM', 'MANUAL_REVIEW_REQUIRED') THEN 'warning' ELSE 'note' END AS report_level, count(*) AS findings FROM scored GROUP BY 1, 2")
def report_rules(spark, sf):
    return guidance.advised(scored(spark, sf)).groupBy("rule_id", "report_level").agg(F.count("*").alias("findings"))


@query(f"WITH {SCORED_SQL} SELECT asset_seq, algorithm || ' in ' || component_name || ' (' || risk_level || ')' AS message, file_path AS uri, CAST(line_number AS BIGINT) AS line FROM scored")
def finding_documents(spark, sf):
    lines = documents.finding_lines(guidance.advised(scored(spark, sf)))
    at = "$.locations[0].physicalLocation"
    get = lambda p: F.get_json_object("line", p)
    return lines.select("asset_seq", get("$.message.text").alias("message"), get(f"{at}.artifactLocation.uri").alias("uri"), get(f"{at}.region.startLine").cast("long").alias("line"))


@query(f"WITH {SCORED_SQL} SELECT asset_seq, asset_id, risk_level, CAST(key_size AS VARCHAR) AS key_size, x_tier, CASE WHEN key_size IS NULL THEN 3 ELSE 4 END::INTEGER AS properties FROM scored")
def bill_of_materials(spark, sf):
    back = documents.properties(documents.bill_lines(scored(spark, sf), ["risk_level", "key_size", "x_tier", "scope"]))
    p = F.col("p")
    return back.select("asset_seq", "asset_id", p["risk_level"].alias("risk_level"), F.try_element_at(p, F.lit("key_size")).alias("key_size"), p["x_tier"].alias("x_tier"), F.size(p).alias("properties"))


@query(f"""WITH {SCORED_SQL}, s AS (SELECT '{{"assets":' || count(*) || ',"critical":' || count(*) FILTER (risk_level = 'CRITICAL') || ',"root":"00ff"}}' AS statement FROM scored) SELECT statement, sha256(statement) AS digest FROM s""")
def estate_statement(spark, sf):
    return documents.statement(scored(spark, sf), "00ff")


_SUITES = [("TLSv1.3", "TLS_AES_256_GCM_SHA384", "X25519MLKEM768"), ("TLSv1.2", "ECDHE-RSA-AES128-GCM-SHA256", None), ("TLSv1.2", "DHE-RSA-CHACHA20", None), ("TLSv1.2", "AES256-SHA", None), ("TLSv1.2", "RSA-CAMELLIA", None)]
_KEX = [("X25519MLKEM768", False), ("ECDHE-X25519", True), ("DHE", True), ("ECDHE-P256", True), ("RSA-KEX", True)]
_BULK = [("AES-256-GCM", 256, "LOW"), ("AES-128-CBC", 128, "HIGH"), ("CHACHA20-POLY1305", 256, "LOW"), ("AES-256-CBC", 256, "LOW"), ("RSA-CAMELLIA", 112, "HIGH")]


def _sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in values) + "]"


@query(f"SELECT o_orderkey, {_sql(a for a, _ in _KEX)}[o_orderkey % 5 + 1] AS exchange, {_sql(b for _, b in _KEX)}[o_orderkey % 5 + 1] AS harvestable, {_sql(a for a, _, _ in _BULK)}[o_orderkey % 5 + 1] AS cipher, CAST({_sql(b for _, b, _ in _BULK)}[o_orderkey % 5 + 1] AS INTEGER) AS bits, {_sql(c for _, _, c in _BULK)}[o_orderkey % 5 + 1] AS quantum_risk FROM orders")
def handshake_classes(spark, sf):
    at = F.col("o_orderkey") % 5
    version, cipher, group = (estate.pick([s[i] for s in _SUITES], at) for i in range(3))
    o = table(spark, sf, "orders").select("o_orderkey", version.alias("v"), cipher.alias("c"), group.alias("g"))
    o = o.select("o_orderkey", guidance.key_exchange(F.col("v"), F.col("c"), F.col("g")).alias("k"), guidance.bulk_cipher(F.col("c"), F.lit(112)).alias("b"))
    return o.select("o_orderkey", F.col("k.algorithm").alias("exchange"), "k.harvestable", F.col("b.algorithm").alias("cipher"), "b.bits", "b.quantum_risk")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'CONSTRAINED' WHEN c_custkey % 4 = 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'CONSTRAINED' ELSE 'STANDARD' END WHEN c_custkey % 4 = 1 THEN 'STANDARD' WHEN c_custkey % 3 = 0 THEN 'STANDARD' ELSE 'FLEXIBLE' END AS profile FROM customer")
def route_profiles(spark, sf):
    k = F.col("c_custkey")
    method = F.when(k % 3 == 0, "host").otherwise("interface")
    return table(spark, sf, "customer").select("c_custkey", guidance.route_profile(estate.pick([9000, 1500, 1280, 576], k % 4), method).alias("profile"))


# ------------------------------------------------------------- registry


def _projects(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("2026-01-01").alias("created_at"), F.lit("idle").alias("status"))


@query(
    """WITH c AS (SELECT s_suppkey + 5 AS id, 'new' || s_suppkey AS name, '2026-02-02' AS created_at, 'ready' AS status FROM supplier WHERE s_suppkey % 3 = 0), p AS (SELECT s_suppkey AS id, s_name AS name FROM supplier)
    SELECT coalesce(p.id, c.id) AS id, coalesce(c.name, p.name) AS name, CASE WHEN p.id IS NULL THEN c.created_at ELSE '2026-01-01' END AS created_at, CASE WHEN p.id IS NULL THEN c.status ELSE 'idle' END AS status FROM p FULL JOIN c USING (id)"""
)
def registry_upsert(spark, sf):
    s = F.col("s_suppkey")
    changes = table(spark, sf, "supplier").where(s % 3 == 0).select((s + 5).alias("id"), F.concat(F.lit("new"), s.cast("string")).alias("name"), F.lit("2026-02-02").alias("created_at"), F.lit("ready").alias("status"))
    return registry.upsert(_projects(spark, sf), changes)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey = 7 THEN 'running' ELSE 'idle' END AS status FROM supplier WHERE s_suppkey % 4 <> 1")
def registry_update_delete(spark, sf):
    changed = registry.update(_projects(spark, sf), "id", 7, {"status": "running"}, {"status", "name"})
    kept, _ = registry.cascade_delete(changed, _projects(spark, sf).select(F.col("id").alias("project_id")), table(spark, sf, "supplier").where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("id")))
    return kept.select("id", "status")


@query("SELECT user_id AS project_id, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS nth FROM events QUALIFY nth <= 3")
def registry_history(spark, sf):
    h = table(spark, sf, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("id"), F.col("ts").alias("started_at"))
    return registry.latest(h, 3).select("project_id", "id", "nth")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 AND epoch(TIMESTAMP '1998-01-01' - o_orderdate) >= 86400 / (o_orderkey % 3 + 1)")
def registry_due(spark, sf):
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select(k.alias("id"), (k % 2 == 0).alias("auto_scan"), (k % 3 + 1).alias("scans_per_day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("last_scanned"))
    return registry.due(p, F.to_timestamp(F.lit("1998-01-01 00:00:00"))).select("id")


# ------------------------------------------------------------- rewriting


_BODY = "import hashlib\na = hashlib.md5(x)\nb = hashlib.md5(y)\nc = hashlib.sha1(z)\nkey = 1024\n"
_RULES = [("weak-hash", [("hashlib.md5", "hashlib.sha256"), ("hashlib.sha1", "hashlib.sha256")]), ("key-size", [("1024", "3072")]), ("none", [("rc4", "aes")])]


@query(
    """WITH b AS (SELECT 'p' || s_suppkey || '/m.py' AS path, 'import hashlib' || chr(10) || 'a = hashlib.md5(x)' || chr(10) || 'b = hashlib.md5(y)' || chr(10) || 'c = hashlib.sha1(z)' || chr(10) || 'key = 1024' || chr(10) || '# ' || s_suppkey AS c FROM supplier),
    r AS (SELECT path, 'weak-hash' AS rule, 3 AS changes, replace(replace(c, 'hashlib.md5', 'hashlib.sha256'), 'hashlib.sha1', 'hashlib.sha256') AS n, c FROM b UNION ALL SELECT path, 'key-size', 1, replace(c, '1024', '3072'), c FROM b)
    SELECT path, rule, CAST(CASE WHEN rule = 'key-size' THEN (length(c) - length(replace(c, '1024', ''))) // 4 ELSE changes END AS INTEGER) AS changes, sha256(c) AS sha_before, sha256(n) AS sha_after FROM r"""
)
def patch_plan(spark, sf):
    files = _files(spark, sf, F.concat(F.lit(_BODY + "# "), F.col("s_suppkey").cast("string")), "m.py")
    return registry.patches(files, _RULES).select("path", "rule", "changes", "sha_before", "sha_after")


@query("SELECT 'p' || s_suppkey || '/m.py' AS path, CAST(n AS INTEGER) AS line_no, o AS old, w AS new FROM supplier, (VALUES (2, 'a = hashlib.md5(x)', 'a = hashlib.sha256(x)'), (3, 'b = hashlib.md5(y)', 'b = hashlib.sha256(y)'), (4, 'c = hashlib.sha1(z)', 'c = hashlib.sha256(z)')) v(n, o, w)")
def patch_diff(spark, sf):
    files = _files(spark, sf, F.lit(_BODY), "m.py")
    after = registry.patches(files, _RULES[:1]).select("path", F.col("patched").alias("content"))
    return registry.line_diff(files, after)


@query("SELECT s_suppkey AS tx_id, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'undo' ELSE 'redo' END AS action, CASE WHEN s_suppkey % 3 = 0 THEN 'APPLIED' WHEN s_suppkey % 3 = 1 AND s_suppkey % 2 = 0 THEN 'REVERTED' WHEN s_suppkey % 3 = 2 AND s_suppkey % 2 = 1 THEN 'APPLIED' ELSE 'REFUSED' END AS state FROM supplier")
def journal_states(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    journal = s.select(k.alias("tx_id"), F.lit("before").alias("sha_before"), F.lit("after").alias("sha_after"), F.when(k % 2 == 0, "after").otherwise("before").alias("sha_now"))
    once = s.where(k % 3 > 0).select(k.alias("tx_id"), F.lit(1).alias("pos"), F.lit("undo").alias("action"))
    again = s.where(k % 3 == 2).select(k.alias("tx_id"), F.lit(2).alias("pos"), F.lit("redo").alias("action"))
    return registry.journal_state(journal, once.unionByName(again))


# ------------------------------------------------------------- source code


_CODE = "import hashlib\nfrom shared import keys\nh = hashlib.new('SHA' + '-1')\nbuf = bytearray(64)\nsave(h)\ndel buf\n"


@query(
    """SELECT 'p' || s_suppkey || '/mod_a.py' AS path, kind, CAST(line_no AS INTEGER) AS line_no, name, detail FROM supplier, (VALUES ('import', 1, 'hashlib', NULL), ('import', 2, 'shared', NULL), ('call', 3, 'hashlib.new', 'SHA-1'), ('call', 4, 'bytearray', '64'), ('buffer', 4, 'bytearray', '64'),
    ('call', 5, 'save', NULL), ('flow', 5, 'h', 'save'), ('flow', 6, 'buf', 'del')) v(kind, line_no, name, detail)"""
)
def python_facts(spark, sf):
    return python_code.python_facts(_files(spark, sf, F.lit(_CODE), "mod_a.py")).select("path", "kind", "line_no", "name", "detail")


@query("SELECT 'p' || s_suppkey || '/mod_a.py' AS path, CAST(4 AS INTEGER) AS line_no, CAST(64 AS BIGINT) AS bytes, 'CRITICAL' AS severity FROM supplier")
def buffer_hazards(spark, sf):
    return python_code.buffer_hazards(python_code.python_facts(_files(spark, sf, F.lit(_CODE), "mod_a.py")))


@query("SELECT 'shared' AS src, 'm' || s_suppkey AS dst FROM supplier")
def import_graph(spark, sf):
    k = F.col("s_suppkey").cast("string")
    mods = table(spark, sf, "supplier").select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), F.lit("import hashlib\nimport pkg.shared\n").alias("content"))
    shared = spark.createDataFrame([("src/shared.py", "X = 1\n")], "path string, content string")  # a module that says nothing else
    files = mods.unionByName(shared)
    return python_code.import_edges(python_code.python_facts(files), files)


# ------------------------------------------------------------- streams


def _stream_dirs(spark, sf) -> str:
    """A log folder of the events' trace lines, in the shared folder."""
    root = f"{graph.shared_dir(spark)}/trace-{uuid.uuid4().hex}"
    _trace_lines(spark, sf).select("value").write.text(f"{root}/log")
    return root


@query("SELECT ['encrypt', 'digest', 'ssl'][event_id % 4 + 1] AS event, ['AES-256-GCM', 'OPENSSL-EVP-DIGEST', 'ECDHE-RSA'][event_id % 4 + 1] AS algorithm, count(*) AS n FROM events WHERE event_id % 4 < 3 GROUP BY 1, 2")
def streamed_traces(spark, sf):
    root = _stream_dirs(spark, sf)
    traces.run_once(traces.trace_stream(spark, f"{root}/log"), f"{root}/out", f"{root}/ckpt").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event", "algorithm").agg(F.count("*").alias("n"))


@query(
    f"""WITH {estate.ASSETS_SQL} SELECT ['AES-256-GCM', 'OPENSSL-EVP-DIGEST', 'ECDHE-RSA'][event_id % 4 + 1] AS algorithm, CASE event_id % 4 WHEN 0 THEN (SELECT arg_min(asset_id, asset_seq) FROM assets WHERE algorithm LIKE '%AES%' AND primitive_type = 'ENCRYPTION')
    WHEN 1 THEN (SELECT arg_min(asset_id, asset_seq) FROM assets WHERE regexp_matches(algorithm, 'SHA|MD5') AND primitive_type = 'HASH') ELSE (SELECT arg_min(asset_id, asset_seq) FROM assets WHERE algorithm LIKE '%RSA%' AND primitive_type = 'KEY_EXCHANGE') END AS asset_id, count(*) AS n
    FROM events WHERE event_id % 4 < 3 GROUP BY ALL"""
)
def streamed_promotion(spark, sf):
    root = _stream_dirs(spark, sf)
    traces.promoted(traces.trace_stream(spark, f"{root}/log"), estate.assets(spark, sf), f"{root}/out", f"{root}/ckpt").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("algorithm", "asset_id").agg(F.count("*").alias("n"))


_SOURCES = {
    "A.java": 'Cipher c = Cipher.getInstance("AES/ECB/PKCS5Padding");\n// Cipher.getInstance("DES")\nMac.getInstance(name);\n', "a.js": "const h = crypto.createHash('md5');\n", "a.go": "h := sha256.New()\nk, _ := rsa.GenerateKey(r, 2048)\n",
    "a.rs": "let h = Sha256::new();\n", "a.rb": "d = OpenSSL::Digest::SHA1.new\n", "a.txt": "Cipher.getInstance('AES')\n",
}


@query(
    """SELECT 'p' || s_suppkey || '/' || f AS path, CAST(n AS INTEGER) AS line_no, l AS language, a AS algorithm, r AS resolved FROM supplier, (VALUES ('A.java', 1, 'java', 'AES/ECB/PKCS5PADDING', true), ('A.java', 3, 'java', 'DYNAMIC_UNRESOLVED', false), ('a.js', 1, 'javascript', 'MD5', true),
    ('a.go', 1, 'go', 'SHA256', true), ('a.go', 2, 'go', 'RSA', true), ('a.rs', 1, 'rust', 'SHA256', true), ('a.rb', 1, 'ruby', 'SHA1', true)) v(f, n, l, a, r)"""
)
def other_code_calls(spark, sf):
    made = None
    for name, body in _SOURCES.items():
        one = _files(spark, sf, F.lit(body), name)
        made = one if made is None else made.unionByName(one)
    return other_code.calls(made)


@query(
    """SELECT 'p' || s_suppkey || '/build.gradle' AS manifest_path, 'maven' AS ecosystem, p AS package, replace(v, 'K', CAST(s_suppkey AS VARCHAR)) AS version, s AS scope FROM supplier,
    (VALUES ('org.bouncycastle:bcprov-jdk18on', '1.K', 'PRODUCTION'), ('com.google.crypto.tink:tink', 'managed', 'TEST_FIXTURE')) t(p, v, s)"""
)
def gradle_dependencies(spark, sf):
    body = F.concat(F.lit("dependencies {\n  implementation 'org.bouncycastle:bcprov-jdk18on:1."), F.col("s_suppkey").cast("string"), F.lit("'\n  testImplementation(\"com.google.crypto.tink:tink\")\n  api 'x:y:1'\n}\n"))
    return texts.with_rules(texts.gradle(_files(spark, sf, body, "build.gradle"))).select("manifest_path", "ecosystem", "package", "version", "scope")
