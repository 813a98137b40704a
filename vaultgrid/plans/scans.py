"""Queries from source texts to findings, assets and scores, and of whole documents; imported by the entry for its registrations."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import factory, graph, guidance, lookups, portfolio, posture, reach, reports, scoring, views
from ..sources import lineage_scan, material, python_code, texts, token_scan
from . import catalog, estate
from .catalog import BUDGET, _edges, _nodes, query, scored
from .estate import ITEMS_SQL, SCORED_SQL, pick, table
from .inventory import _SIGS, _deps, _list, _values

# ------------------------------------------------------------- scanners

#: (file, text with one place for what differs, what the place holds by key, found as (line, algorithm, role, origin) by the same keys)
_CASES = [
    ("A.java", 'class A {\n  static final String M = "/ECB/" + "PKCS5Padding"; // Cipher.getInstance("DES")\n  Cipher c() { return Cipher.getInstance("{}" + M); }\n}', ["AES", "DES", "Blowfish"], 3, ["AES-ECB", "DES-ECB", "BLOWFISH-ECB"], "ENCRYPTION", "STATIC"),
    ("B.java", "class B {\n  byte[] f(String p) throws Exception {\n    return MessageDigest.getInstance({}).digest();\n  }\n}", ['"sha-256".toUpperCase()', 'System.getenv("H")', "p"], 3, ["SHA-256", "DYNAMIC_UNRESOLVED", "DYNAMIC_UNRESOLVED"], "HASH", ["STATIC", "ENV", "PARAMETER"]),
    ("c.js", "const alg = '{}';\nconst c = crypto.createCipheriv(alg, key, iv);\n", ["aes-256-gcm", "aes-128-cbc", "des-ede3-cbc"], 2, ["AES-256-GCM", "AES-128-CBC", "DES-EDE3-CBC"], "ENCRYPTION", "STATIC"),
    ("d.ts", "import x from 'y';\n\nconst h = crypto.createHash({});\n", ["'md5'", "config.get('hash')", "row.algorithm"], 3, ["MD5", "DYNAMIC_UNRESOLVED", "DYNAMIC_UNRESOLVED"], "HASH", ["STATIC", "CONFIG", "DATABASE"]),
    ("e.go", 'package main\nimport (\n\t"fmt"\n\tx "crypto/{}"\n)\nfunc f() { h := x.New(); fmt.Println(h) }\n', ["sha256", "md5", "sha1"], 6, ["crypto/sha256.New", "crypto/md5.New", "crypto/sha1.New"], "UNKNOWN", "STATIC"),
    ("f.rs", "// sha2::Sha256\nuse sha2::{};\n", ["Sha256", "Sha512", "Sha384"], 2, ["SHA-256", "SHA-512", None], "HASH", "STATIC"),
    ("g.rb", "# OpenSSL::Cipher.new('des')\nk = OpenSSL::PKey::RSA.new({})\n", ["1024", "2048", "4096"], 2, ["RSA-1024", "RSA-2048", "RSA-4096"], "SIGNATURE", "STATIC"),
]


def _sources(spark, sf):
    """One file of every case for each supplier, its text differing by the key."""
    k = F.col("s_suppkey")
    made = None
    for name, body, fills, *_ in _CASES:
        text = F.replace(F.lit(body), F.lit("{}"), pick(fills, k % 3))
        one = table(spark, sf, "supplier").select(F.concat(F.lit("p"), k.cast("string"), F.lit("/" + name)).alias("path"), text.alias("content"))
        made = one if made is None else made.unionByName(one)
    return made


def _found() -> str:
    each = []
    for name, _, _, line, algorithms, role, origin in _CASES:
        origins = origin if isinstance(origin, list) else [origin] * 3
        each.append(f"SELECT s_suppkey AS k, 'p' || s_suppkey || '/{name}' AS path, CAST({line} AS INTEGER) AS line_no, {_list(algorithms)}[s_suppkey % 3 + 1] AS algorithm, '{role}' AS primitive_type, {_list(origins)}[s_suppkey % 3 + 1] AS origin FROM supplier")
    return "found AS (SELECT * FROM (" + " UNION ALL ".join(each) + ") WHERE algorithm IS NOT NULL)"


@query(f"WITH {_found()} SELECT path, line_no, algorithm, primitive_type, origin FROM found")
def code_findings(spark, sf):
    return token_scan.code_findings(_sources(spark, sf)).select("path", "line_no", "algorithm", "primitive_type", "origin")


@query(f"WITH {_SIGS}, {_found()} SELECT path, id, default_risk FROM found LEFT JOIN sigs ON ecosystem = 'go' AND symbol = 'New' AND contains(lower(namespace), regexp_extract(algorithm, '^(.*)\\.[^.]*$', 1)) WHERE found.primitive_type = 'UNKNOWN' QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord) = 1")
def go_signatures(spark, sf):
    calls = token_scan.code_findings(_sources(spark, sf)).where("rule = 'go:call'")
    split = lambda i: F.regexp_extract("algorithm", r"^(.*)\.([^.]*)$", i)
    named = calls.select("path", F.lit("go").alias("ecosystem"), split(1).alias("namespace"), split(2).alias("symbol"))
    return lookups.by_call(named, lookups.signatures(spark)).select("path", "id", "default_risk")


def _scanned_assets(spark, sf):
    """Assets of all findings: Go calls by their signatures, the file's key lifecycle, then the factory."""
    files = _sources(spark, sf)
    found = token_scan.code_findings(files)
    split = lambda i: F.regexp_extract("algorithm", r"^(.*)\.([^.]*)$", i)
    is_go = F.col("rule") == "go:call"
    calls = found.withColumns({"ecosystem": F.when(is_go, "go"), "namespace": F.when(is_go, split(1)), "symbol": F.when(is_go, split(2))})
    known = lookups.by_call(calls, lookups.signatures(spark).withColumnsRenamed({"primitive_type": "role", "key_size": "bits", "cwe": "weakness"}), ["normalized_alg", "role", "bits", "weakness"])
    life = files.select(F.col("path").alias("__path"), token_scan.shredding(F.col("content")).alias("life"))
    rows = known.join(life, F.col("path") == F.col("__path"))
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1)
    seq = F.regexp_extract("path", r"^p(\d+)/", 1).cast("long")
    return factory.assets_of(
        rows.select(
            seq.alias("seq"), F.concat_ws(":", stem, "rule").alias("component_name"), F.coalesce("normalized_alg", "algorithm").alias("algorithm"), F.coalesce("key_size", "bits").alias("key_size"), F.coalesce("role", "primitive_type").alias("primitive_type"),
            F.col("path").alias("file_path"), F.col("line_no").alias("line_number"), F.col("life.x_tier").alias("x_tier"), F.col("life.has_crypto_shredding").alias("has_crypto_shredding"), F.lit("E1_STATIC_ARTIFACT").alias("evidence_level"),
            F.concat_ws(":", "language", "rule").alias("evidence_source"), "matched_code", "language", F.coalesce("weakness", F.lit("")).alias("cwe"), F.lit("").alias("description"),
        )
    )


#: What the rules make of (role, algorithm, origin): level, weakness and score by hand; five years of secrecy, public exposure, the year 2026.
_EXPECTED = [
    ("ENCRYPTION", "AES-ECB", "STATIC", "CRITICAL", "CWE-1240", 6.0), ("ENCRYPTION", "BLOWFISH-ECB", "STATIC", "CRITICAL", "CWE-327", 6.0), ("ENCRYPTION", "DES-ECB", "STATIC", "CRITICAL", "CWE-327", 6.0),
    ("ENCRYPTION", "DES-EDE3-CBC", "STATIC", "CRITICAL", "CWE-327", 6.0), ("ENCRYPTION", "AES-128-CBC", "STATIC", "LOW", None, 0.0), ("ENCRYPTION", "AES-256-GCM", "STATIC", "LOW", None, 0.0),
    ("HASH", "DYNAMIC_UNRESOLVED", "ENV", "MANUAL_REVIEW_REQUIRED", None, 0.28), ("HASH", "DYNAMIC_UNRESOLVED", "CONFIG", "MANUAL_REVIEW_REQUIRED", None, 0.28), ("HASH", "DYNAMIC_UNRESOLVED", "PARAMETER", "MANUAL_REVIEW_REQUIRED", None, 0.4),
    ("HASH", "DYNAMIC_UNRESOLVED", "DATABASE", "MANUAL_REVIEW_REQUIRED", None, 0.4), ("HASH", "SHA-256", "STATIC", "LOW", None, 0.0), ("HASH", "SHA-512", "STATIC", "LOW", None, 0.0), ("HASH", "MD5", "STATIC", "CRITICAL", "CWE-327", 1.2),
    ("UNKNOWN", "MD5", "STATIC", "CRITICAL", "CWE-328", 1.2), ("UNKNOWN", "SHA-1", "STATIC", "CRITICAL", "CWE-328", 1.2), ("UNKNOWN", "SHA-256", "STATIC", "LOW", None, 0.0),
    ("SIGNATURE", "RSA-1024", "STATIC", "CRITICAL", "CWE-327", 6.3), ("SIGNATURE", "RSA-2048", "STATIC", "CRITICAL", "CWE-327", 1.8), ("SIGNATURE", "RSA-4096", "STATIC", "CRITICAL", "CWE-327", 1.8),
]


@query(
    f"""WITH {_found()}, w(role, name, o, risk_level, cwe_id, score) AS (VALUES {_values(_EXPECTED)}), g AS (SELECT *, CASE algorithm WHEN 'crypto/sha256.New' THEN 'SHA-256' WHEN 'crypto/md5.New' THEN 'MD5' WHEN 'crypto/sha1.New' THEN 'SHA-1' ELSE algorithm END AS known FROM found)
    SELECT path AS file_path, known AS algorithm, risk_level, cwe_id, CASE primitive_type WHEN 'ENCRYPTION' THEN 'CONFIDENTIALITY_ENVELOPE' WHEN 'SIGNATURE' THEN 'AUTHENTICATION_SIGNATURE' ELSE 'INTEGRITY_CHECKSUM' END AS intent_class, 'PRODUCTION' AS scope, score::DOUBLE AS r_q_score
    FROM g LEFT JOIN w ON role = primitive_type AND name = known AND o = origin"""
)
def scan_to_scores(spark, sf):
    a = _scanned_assets(spark, sf).withColumns({"exposure_profile": F.lit("PUBLIC"), "p_hndl": F.lit(1.0), "misuse": guidance.broken_name(F.col("algorithm"))})
    return scoring.scored(a).select("file_path", "algorithm", "risk_level", "cwe_id", "intent_class", "scope", "r_q_score")


_LIFE = ["fn drop() { key.zeroize(); }", "zeroize(k); fs.writeFileSync(p, k)", "let x = 1;", None, "db.insert(row)"]
_TIER = ["EPHEMERAL", "SHORT_TERM", "OPERATIONAL", "OPERATIONAL", "OPERATIONAL"]


@query(f"SELECT p_partkey, p_partkey % 5 < 2 AS has_crypto_shredding, {_list(_TIER)}[p_partkey % 5 + 1] AS x_tier FROM part")
def shredding_context(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", token_scan.shredding(pick(_LIFE, F.col("p_partkey") % 5)).alias("l"))
    return p.select("p_partkey", "l.has_crypto_shredding", "l.x_tier")


_KEY_TEXT = ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN PUBLIC KEY----- ED25519", "nothing", "-----BEGIN PRIVATE KEY-----"]


@query(
    f"""WITH f AS (SELECT 'k/' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.pem' AS path, s_suppkey % 5 AS c, s_suppkey // 3 AS body FROM supplier), g AS (SELECT c, body, min(path) AS path FROM f WHERE c <> 3 GROUP BY 1, 2)
    SELECT path, ['private-key', 'private-key', 'public-key', NULL, 'private-key'][c + 1] AS kind, ['RSA-2048', 'ECDSA-P256', 'Ed25519', NULL, 'RSA-2048'][c + 1] AS algorithm, CAST([2048, 256, 256, NULL, 2048][c + 1] AS INTEGER) AS key_size, ['KEY_EXCHANGE', 'SIGNATURE', 'SIGNATURE', NULL, 'KEY_EXCHANGE'][c + 1] AS primitive_type,
    CASE WHEN c = 2 THEN 'OPERATIONAL' ELSE 'ARCHIVAL' END AS x_tier FROM g"""
)
def key_files(spark, sf):
    k = F.col("s_suppkey")
    files = table(spark, sf, "supplier").select(F.concat(F.lit("k/"), F.lpad(k.cast("string"), 6, "0"), F.lit(".pem")).alias("path"), F.concat_ws("\n", pick(_KEY_TEXT, k % 5), F.floor(k / 3).cast("string")).alias("content"))
    return material.key_files(files).select("path", "kind", "algorithm", "key_size", "primitive_type", "x_tier")


def _component(kind: str, name, path, more) -> F.Column:
    return F.concat(F.lit('{"name":"'), name, F.lit(f'","cryptoProperties":{{"assetType":"{kind}"'), more, F.lit('},"evidence":{"occurrences":[{"location":"'), path, F.lit('"}]}}'))


@query(
    """SELECT 'x509_cert:site' || s_suppkey AS component_name, CASE WHEN s_suppkey % 2 = 0 THEN 'ECDSA-P384' ELSE 'RSA-2048' END AS algorithm, CAST(2048 AS INTEGER) AS key_size, 'SIGNATURE' AS primitive_type, 'OPERATIONAL' AS x_tier, 'c/site' || s_suppkey || '.crt,d/copy' || s_suppkey || '.crt' AS replicas FROM supplier
    UNION ALL SELECT 'keyfile:key' || s_suppkey || '_private-key', ['RSA-3072', 'ECDSA-P256', 'blob'][s_suppkey % 3 + 1], CAST([3072, 256, 2048][s_suppkey % 3 + 1] AS INTEGER), ['KEY_EXCHANGE', 'SIGNATURE', 'ENCRYPTION'][s_suppkey % 3 + 1], ['ARCHIVAL', 'OPERATIONAL', 'ARCHIVAL'][s_suppkey % 3 + 1], '' FROM supplier"""
)
def foreign_material(spark, sf):
    """Five components a document: a certificate and its copy, its public key, a private key, and a token."""
    s = F.col("s_suppkey").cast("string")
    at = F.col("s_suppkey")
    path = lambda a, b: F.concat(F.lit(a), s, F.lit(b))
    cert = F.when(at % 2 == 0, "ECDSA-P384").otherwise("site")
    related = lambda kind, size: F.concat(F.lit(f',"relatedCryptoMaterialProperties":{{"type":"{kind}","size":'), size, F.lit("}"))
    parts = [
        _component("certificate", cert, path("c/site", ".crt"), F.lit("")), _component("certificate", cert, path("d/copy", ".crt"), F.lit("")), _component("related-crypto-material", F.lit("RSA"), path("c/site", ".crt"), related("public-key", F.lit("2048"))),
        _component("related-crypto-material", pick(["RSA", "EC", "blob"], at % 3), path("k/key", ".pem"), related("private-key", pick(["3072", "256", "0"], at % 3))), _component("related-crypto-material", F.lit("generic-api-key"), path("k/tok", ".txtx"), related("token", F.lit("0"))),
    ]
    docs = table(spark, sf, "supplier").select(at.alias("doc_seq"), F.concat(F.lit('{"components":['), F.concat_ws(",", *parts), F.lit("]}")).alias("content"))
    samples = table(spark, sf, "supplier").select(F.explode(F.array(path("c/site", ".crt"), path("d/copy", ".crt"))).alias("path"), F.lit(None).cast("string").alias("sha"), F.lit(None).cast("string").alias("sample"), F.sha2(s, 256).alias("fingerprint"))
    return material.material(docs, samples).select("component_name", "algorithm", "key_size", "primitive_type", "x_tier", "replicas")


# ------------------------------------------------------------- documents


@query(
    f"""WITH {SCORED_SQL} SELECT asset_seq, CASE WHEN scope = 'PRODUCTION' THEN 'required' ELSE 'optional' END AS scope, ['STATIC_REACHABLE', 'CONFIG_CONFIRMED', 'ACTIVE', 'DORMANT'][asset_seq % 4 + 1] AS status, file_path || ':' || line_number AS location,
    CASE WHEN p_hndl >= 0.8 THEN 'CRITICAL_HARVEST_TARGET' ELSE 'INTERNAL_DEFENDED' END AS harvest, ['RIGID', 'CONFIGURABLE', 'PROVIDER', 'RUNTIME_AGILE', 'ORCHESTRATED', 'QUANTUM_AGILE'][agility_level + 1] AS agility, x_years_effective AS years FROM scored"""
)
def attested_components(spark, sf):
    a = scored(spark, sf).withColumn("evidence_level", pick(["E1_STATIC_ARTIFACT", "E3_CONFIG_CONFIRMED", "E4_RUNTIME_OBSERVED", "DORMANT"], F.col("asset_seq") % 4))
    at = lambda p: F.get_json_object("line", f"$.cdxAttestation.discussion966.{p}")
    return reports.attested(a).select(
        "asset_seq", F.get_json_object("line", "$.scope").alias("scope"), at("runtimeExecutionStatus").alias("status"), at("reachabilityProof.callLocation").alias("location"), at("adversarialExposure.harvestRiskCategory").alias("harvest"),
        at("camsMaturity.agilityClassification").alias("agility"), at("dataLifetime.effectiveSecrecyYears").cast("double").alias("years"),
    )


@query(f"WITH {SCORED_SQL} SELECT count(*) AS results, '2.1.0' AS version, CAST(count(*) AS VARCHAR) AS told FROM scored")
def finding_run(spark, sf):
    run = reports.finding_run(guidance.advised(scored(spark, sf)), "vaultgrid", "1.0")
    return run.select("results", F.get_json_object("document", "$.version").alias("version"), F.get_json_object("document", "$.run.resultCount").alias("told"))


_CLASSES = """c AS (SELECT node_id, r0, CASE WHEN left(node_id, 1) = 'N' AND r0 >= 2 THEN 'ANCHOR' WHEN left(node_id, 1) = 'N' THEN 'SAFE' WHEN left(node_id, 1) IN ('R', 'S') AND r0 >= 2 THEN 'SUPERSPREADER' WHEN left(node_id, 1) IN ('R', 'S') THEN 'CRYPTO' WHEN r0 > 0 THEN 'INTERMEDIARY' ELSE 'CONSUMER' END AS kind
  FROM (SELECT node_id, count(dst) AS r0 FROM n LEFT JOIN c0 ON c0.src = node_id GROUP BY 1))"""


@query(
    "WITH RECURSIVE " + catalog._CLOSURE.replace(" c AS (", " c0 AS (").replace("c.src, e.dst FROM c JOIN e ON c.dst", "c0.src, e.dst FROM c0 JOIN e ON c0.dst") + ", " + _CLASSES
    + """ SELECT 'node' AS kind, node_id AS id, CASE kind WHEN 'SUPERSPREADER' THEN 'red' WHEN 'CRYPTO' THEN 'orange' WHEN 'ANCHOR' THEN 'green' WHEN 'SAFE' THEN 'green' WHEN 'INTERMEDIARY' THEN 'blue' ELSE 'grey' END AS color, CAST(least(40, 10 + 2 * r0) AS INTEGER) AS size FROM c UNION ALL SELECT 'link', src || '->' || dst, NULL, NULL FROM e"""
)
def graph_document(spark, sf):
    e = _edges(spark, sf)
    n = _nodes(e)
    kinds = n.select("node_id", F.left("node_id", F.lit(1)).isin("R", "S").alias("vulnerable"), (F.left("node_id", F.lit(1)) == "N").alias("safe"))
    lines = reports.graph_lines(graph.classes(kinds, reach.reached(e), e), e)
    return lines.select("kind", "id", F.get_json_object("line", "$.color").alias("color"), F.get_json_object("line", "$.size").cast("int").alias("size"))


@query(f"WITH {ITEMS_SQL} SELECT portfolio, count(*) AS items, sum(CAST(delta_r AS DECIMAL(18,2)))::DOUBLE AS risk, arg_min(asset_id, {{'e': -efficiency, 's': asset_seq}}) AS best FROM items GROUP BY 1")
def portfolio_documents(spark, sf):
    items = portfolio.optimal(catalog._items(spark, sf), "portfolio", BUDGET)
    got = lambda p: F.get_json_object("document", f"$.{p}")
    return reports.portfolio_documents(items, "portfolio").select("portfolio", got("items").cast("long").alias("items"), got("risk").cast("double").alias("risk"), got("best").alias("best"))


@query(
    f"""WITH {SCORED_SQL}, h AS (SELECT 0 AS n, '# Migration report' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, 'Assets: ' || (SELECT count(*) FROM scored) UNION ALL SELECT 2 + i, '- ' || l || ': ' || (SELECT count(*) FROM scored WHERE risk_level = l) FROM (SELECT unnest({_list(reports.LEVELS)}) AS l, unnest(range(1, 6)) AS i)
      UNION ALL SELECT 8, '' UNION ALL SELECT 9, '## Least runway' UNION ALL SELECT 10, '' UNION ALL SELECT 11, '| asset_id | algorithm | risk_level | y_max_years |' UNION ALL SELECT 12, '|---|---|---|---|'),
    t AS (SELECT 12 + row_number() OVER (ORDER BY y_max_years, asset_seq) AS n, '| ' || asset_id || ' | ' || algorithm || ' | ' || risk_level || ' | ' || CAST(y_max_years AS VARCHAR) || ' |' AS line FROM scored QUALIFY n <= 27)
    SELECT CAST(n AS INTEGER) AS n, line FROM h UNION ALL SELECT CAST(n AS INTEGER), line FROM t"""
)
def executive_report(spark, sf):
    return reports.executive_report(scored(spark, sf), "Migration report")


@query("SELECT s_suppkey AS id, '{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\",\"assets\":' || count(l_orderkey) || ',\"critical\":' || count(l_orderkey) FILTER (l_returnflag = 'A') || ',\"readiness\":' || CASE WHEN count(l_orderkey) = 0 THEN '100.0' ELSE CAST(round(CAST(100.0::DOUBLE * (count(l_orderkey) - count(l_orderkey) FILTER (l_returnflag = 'A')) / count(l_orderkey) AS DECIMAL(18,6)), 1)::DOUBLE AS VARCHAR) END || '}' AS line FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name")
def fleet_registry(spark, sf):
    projects = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    scores = table(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") == "A", "CRITICAL").otherwise("LOW").alias("risk_level"))
    return reports.fleet(projects, scores, "l_suppkey")


@query(
    f"""WITH d AS ({catalog.ORACLES["detection_confusion"]}), t AS (SELECT 1 + row_number() OVER (ORDER BY level, source, lang) AS n, '| ' || source || '/' || lang || ' | ' || tp || ' | ' || fp || ' | ' || tn || ' | ' || fn || ' | ' || coalesce(CAST(precision AS VARCHAR), '') || ' | ' || coalesce(CAST(recall AS VARCHAR), '') || ' |' AS line FROM d)
    SELECT CAST(0 AS INTEGER) AS n, '| group | tp | fp | tn | fn | precision | recall |' AS line UNION ALL SELECT 1, '|---|---|---|---|---|---|---|' UNION ALL SELECT CAST(n AS INTEGER), line FROM t WHERE n <= 201"""
)
def detection_report(spark, sf):
    pairs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("source", "lang", (F.col("quality") == 0).alias("e"), F.coalesce("text", F.lit("")).rlike(r"[#*$%&|]{3}").alias("f"))
    return reports.detection_report(posture.confusion(pairs, "e", "f", ["source", "lang"]), ["source", "lang"])


_SPECS = [("ML-KEM-768", "FIPS 203"), ("ML-DSA-65", "FIPS 204"), ("SLH-DSA", "FIPS 205"), ("AES-256-GCM", "SP 800-38D")]
_ASKED = ["ml-kem-768", "ML-DSA", "SLH-DSA-128s", "aes-256", "RSA", "ML-KEM-768-HYBRID"]


@query(f"SELECT p_partkey, {_list(_ASKED)}[p_partkey % 6 + 1] AS name, ['FIPS 203', 'FIPS 204', 'FIPS 205', 'SP 800-38D', NULL, 'FIPS 203'][p_partkey % 6 + 1] AS standard FROM part")
def specification_lookup(spark, sf):
    return table(spark, sf, "part").select("p_partkey", pick(_ASKED, F.col("p_partkey") % 6).alias("name")).withColumn("standard", reports.specification(F.col("name"), _SPECS))


@query(
    """WITH a AS (SELECT c_custkey, ['ml-kem-768', 'vendor_kem ' || c_nationkey, 'VENDOR-KEM-' || c_nationkey || '-X', 'x25519-ml-kem-768', 'RSA', 'slh.dsa', 'ML-DSA-65 '][c_custkey % 7 + 1] AS name, c_nationkey FROM customer)
    SELECT c_custkey, name, CASE c_custkey % 7 WHEN 0 THEN 'OWN 203' WHEN 1 THEN 'OWN ' || c_nationkey WHEN 2 THEN 'OWN ' || (SELECT min(n_nationkey) FROM nation WHERE contains('VENDOR-KEM-' || c_nationkey || '-X', 'VENDOR-KEM-' || n_nationkey)) WHEN 3 THEN 'HYBRID' WHEN 5 THEN 'FIPS 205' WHEN 6 THEN 'FIPS 204' END AS standard FROM a"""
)
def registered_standards(spark, sf):
    """A catalogue of standards to which every nation adds its own, one of them under a known name and one a hybrid with other names."""
    specs = spark.createDataFrame([(i, *x) for i, x in enumerate(_SPECS)], "ord int, name string, standard string")
    n = table(spark, sf, "nation")
    own = n.select(F.format_string("Vendor KEM (%02d)", "n_nationkey").alias("name"), F.concat(F.lit("OWN "), F.col("n_nationkey").cast("string")).alias("standard"))
    own = own.withColumn("name", F.regexp_replace("name", r"\(0?(\d+)\)", "$1"))
    new = own.unionByName(spark.createDataFrame([("ml_kem 768", "OWN 203"), ("Composite-KEM v1", "HYBRID")], "name string, standard string"))
    k = F.col("c_custkey") % 7
    nation = F.col("c_nationkey").cast("string")
    name = F.get(F.array(F.lit("ml-kem-768"), F.concat(F.lit("vendor_kem "), nation), F.concat(F.lit("VENDOR-KEM-"), nation, F.lit("-X")), F.lit("x25519-ml-kem-768"), F.lit("RSA"), F.lit("slh.dsa"), F.lit("ML-DSA-65 ")), k.cast("int"))
    asked = table(spark, sf, "customer").select("c_custkey", name.alias("name"))
    return lookups.standard_of(asked, lookups.standards(lookups.register_standard(specs, new)), "name")


@query("WITH d AS (SELECT DISTINCT 'lib-' || l_suppkey AS package, 'app' || (l_orderkey % 50) || '/pom.xml' AS manifest_path FROM lineitem) SELECT manifest_path, package FROM d")
def manifest_dedup(spark, sf):
    d = _deps(spark, sf)
    return d.groupBy("manifest_path", "package").agg(F.min("dep_id").alias("first")).select("manifest_path", "package")


# ------------------------------------------------------------- lineage and networks

_JS = "const a = process.env.ALG_{k};\nconst p = process.env.PORT;\nconst c = crypto.createCipheriv({arg}, k, iv);\nconst r = crypto.generateKeyPairSync('rsa', {});\n{keep}\n"
_ARGS = ["process.env.ALG_X", "config.get('cipher')", "'aes-256-gcm'", "mode"]
_ARG_NODE = ["INGRESS:ENV:ALG_X", "INGRESS:CONFIG:cipher", None, "INGRESS:PARAMETER:mode"]
_KEEP = ["redis.set(x, c);", "db.save(c);", "contract.submitTransaction(c);", "log(c);", "q.xadd(c)"]
_KEEP_NODE = ["EGRESS:CACHE:redis_store:", "EGRESS:DATABASE:sql_store:", "EGRESS:LEDGER:fabric", None, "EGRESS:STREAM:redis_stream:"]


def _traced(spark, sf):
    k = F.col("s_suppkey")
    text = F.replace(F.replace(F.replace(F.lit(_JS), F.lit("{k}"), (k % 7).cast("string")), F.lit("{arg}"), pick(_ARGS, k % 4)), F.lit("{keep}"), pick(_KEEP, k % 5))
    return table(spark, sf, "supplier").select(F.concat(F.lit("s"), k.cast("string"), F.lit(".js")).alias("path"), text.alias("content"))


_TRACED = f"""tr AS (SELECT 's' || s_suppkey || '.js' AS path, 'INGRESS:ENV:ALG_' || (s_suppkey % 7) AS env, {_list(_ARG_NODE)}[s_suppkey % 4 + 1] AS arg, CASE WHEN s_suppkey % 5 IN (0, 1, 4) THEN {_list(_KEEP_NODE)}[s_suppkey % 5 + 1] || 's' || s_suppkey || '.js' ELSE {_list(_KEEP_NODE)}[s_suppkey % 5 + 1] END AS keep FROM supplier),
  nx AS (SELECT *, 'NEXUS:' || path || ':3' AS a, 'NEXUS:' || path || ':4' AS b FROM tr),
  ed AS (SELECT env AS source_id, a AS target_id, 'FEEDS' AS edge_type FROM nx UNION SELECT env, b, 'FEEDS' FROM nx UNION SELECT arg, a, 'FEEDS' FROM nx WHERE arg IS NOT NULL UNION SELECT arg, b, 'FEEDS' FROM nx WHERE starts_with(arg, 'INGRESS:ENV') OR starts_with(arg, 'INGRESS:CONFIG') UNION SELECT a, keep, 'REACHES' FROM nx WHERE keep IS NOT NULL UNION SELECT b, keep, 'REACHES' FROM nx WHERE keep IS NOT NULL)"""


@query(f"WITH {_TRACED} SELECT source_id, target_id, edge_type FROM ed")
def source_lineage(spark, sf):
    return lineage_scan.lineage_graph(lineage_scan.lineage_events(_traced(spark, sf)))[1]


@query(f"WITH {_TRACED}, n AS (SELECT source_id AS node_id FROM ed UNION SELECT target_id FROM ed) SELECT node_id, string_split(node_id, ':')[1] AS category, CASE WHEN starts_with(node_id, 'NEXUS') THEN 'CALLSITE' ELSE string_split(node_id, ':')[2] END AS source_type FROM n")
def source_lineage_nodes(spark, sf):
    return lineage_scan.lineage_graph(lineage_scan.lineage_events(_traced(spark, sf)))[0]


_NET = """net AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT 'org' || (s_suppkey % 9) || '-ca', 'peer' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT 'k' || s_suppkey, 'backend-service' FROM supplier WHERE s_suppkey % 4 = 1 UNION SELECT '.env', 'backend-service' FROM supplier WHERE s_suppkey % 4 = 2
  UNION SELECT 'lib-' || l_suppkey, 'app' || (l_orderkey % 50) FROM lineitem UNION SELECT 'root-' || n_name, 'npm-app' FROM nation)"""


def _network(spark, sf):
    n = table(spark, sf, "nation")
    imports = n.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("dst"))
    k = F.col("s_suppkey")
    s = k.cast("string")
    paths = F.when(k % 4 == 0, F.concat(F.lit("net/organizations/peerOrganizations/org"), (k % 9).cast("string"), F.lit("/peers/peer"), s, F.lit("/msp/x.pem"))).when(k % 4 == 1, F.concat(F.lit("app/wallet/k"), s, F.lit(".id"))).when(k % 4 == 2, F.concat(F.lit("d"), s, F.lit("/.env"))).otherwise(F.concat(F.lit("src/m"), s, F.lit(".py")))
    deps = _deps(spark, sf).select("package", "manifest_path", "ecosystem").unionByName(n.select(F.concat(F.lit("root-"), "n_name").alias("package"), F.lit("package.json").alias("manifest_path"), F.lit("npm").alias("ecosystem")))
    return graph.built(imports, table(spark, sf, "supplier").select(paths.alias("file_path")), deps)


@query(f"WITH {_NET} SELECT src, dst FROM net")
def dependency_network(spark, sf):
    return _network(spark, sf)


_PASS = "t{i} AS (SELECT t.node_id, greatest(max(t.tier), coalesce(max(CASE WHEN t.tier <= s.tier AND s.tier < 3 THEN s.tier + 1 END), max(t.tier))) AS tier FROM t{h} t LEFT JOIN net ON dst = t.node_id LEFT JOIN t{h} s ON s.node_id = src GROUP BY 1)"


@query(
    f"""WITH {_NET}, nd AS (SELECT src AS node_id FROM net UNION SELECT dst FROM net UNION SELECT 'alone'), g AS (SELECT node_id, (SELECT count(*) FROM net WHERE dst = node_id) AS i, (SELECT count(*) FROM net WHERE src = node_id) AS o FROM nd),
    t0 AS (SELECT node_id, CASE WHEN node_id = 'app7' OR contains(node_id, '-ca') OR (i = 0 AND o > 0) THEN 0 WHEN starts_with(node_id, 'peer') THEN 1 WHEN i > 0 AND o > 0 THEN 2 WHEN i + o > 0 THEN 3 ELSE 4 END AS tier FROM g), {", ".join(_PASS.format(i=i, h=i - 1) for i in (1, 2, 3))}
    SELECT node_id, CAST(tier AS INTEGER) AS tier FROM t3"""
)
def flow_tiers(spark, sf):
    e = _network(spark, sf)
    n = _nodes(e).unionByName(spark.createDataFrame([("alone",)], "node_id string"))
    return graph.flow_tiers(n.select("node_id", (F.col("node_id") == "app7").alias("superspreader"), F.col("node_id").startswith("peer").alias("has_crypto")), e)


@query(
    f"""WITH {estate.ASSETS_SQL}, nd AS (SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN lower(replace(p_name, ' ', '_')) || ':x' WHEN 1 THEN 'mod_' || (p_partkey % 300) ELSE 'none' || p_partkey END AS node_id, CASE WHEN p_partkey % 6 = 5 THEN 'svc' || (p_partkey % 40) || '/src/mod_' || (p_partkey % 300) || '.py' END AS file_path, p_partkey % 9 AS r0 FROM part)
    SELECT asset_id, greatest(1, coalesce(n.r0, 1)) AS r0 FROM assets a LEFT JOIN nd n ON n.node_id = a.component_name OR n.node_id = regexp_extract(a.file_path, '([^/]+?)(\\.[^./]*)?$', 1) OR n.file_path = a.file_path QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ord NULLS LAST) = 1"""
)
def graph_r0_of_assets(spark, sf):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(":x"))).when(k % 3 == 1, F.concat(F.lit("mod_"), s(k % 300))).otherwise(F.concat(F.lit("none"), s(k)))
    path = F.when(k % 6 == 5, F.concat(F.lit("svc"), s(k % 40), F.lit("/src/mod_"), s(k % 300), F.lit(".py")))
    nodes = table(spark, sf, "part").select(k.alias("ord"), name.alias("node_id"), path.alias("file_path"), (k % 9).alias("r0"))
    return graph.resolved_r0(estate.assets(spark, sf), nodes).select("asset_id", "r0")


# ------------------------------------------------------------- Python sources

#: (call, algorithm, role, key size, weakness)
_PY_CALLS = [
    ("hashlib.md5(x)", "MD5", "HASH", 128, "CWE-328"), ("hashlib.new('sha' + '-1')", "SHA-1", "HASH", 160, "CWE-328"), ("hashlib.sha384(x)", "SHA384", "HASH", 256, None), ("hmac.new(k, m)", "HMAC-SHA256", "HASH", 256, None),
    ("algorithms.TripleDES(k)", "3DES", "ENCRYPTION", 192, "CWE-327"), ("hashes.SHA256()", "SHA-256", "HASH", 256, None), ("aead.AESGCM(k)", "AES-256-GCM", "ENCRYPTION", 256, None), ("rsa.generate_private_key(e, 2048)", "RSA-2048", "SIGNATURE", 2048, "CWE-326"),
    ("ec.generate_private_key(c)", "ECDSA-P256", "SIGNATURE", 256, "CWE-326"), ("box.encrypt(m)", "AES-256-GCM", "ENCRYPTION", 256, None), ("key.sign(m)", "ECDSA-P256", "SIGNATURE", 256, "CWE-326"), ("DES.new(k)", "DES", "ENCRYPTION", 64, "CWE-327"),
    ("Fernet(k)", "AES-256-GCM", "ENCRYPTION", 256, None), ("print(m)", None, None, None, None),
]


@query(f"SELECT DISTINCT 'm' || l_orderkey || '_' || l_linenumber || '.py' AS path, CAST(2 AS INTEGER) AS line_no, algorithm, primitive_type, CAST(key_size AS INTEGER) AS key_size, cwe FROM lineitem JOIN (VALUES {_values([(i, *c[1:]) for i, c in enumerate(_PY_CALLS)])}) v(i, algorithm, primitive_type, key_size, cwe) ON i = (l_orderkey * 7 + l_linenumber) % {len(_PY_CALLS)} WHERE algorithm IS NOT NULL")
def python_findings(spark, sf):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    path = F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".py"))
    text = F.concat(F.lit("import hashlib\nv = "), pick([c[0] for c in _PY_CALLS], k % len(_PY_CALLS)), F.lit("\n"))
    files = table(spark, sf, "lineitem").select(path.alias("path"), text.alias("content"))
    return python_code.findings(python_code.python_facts(files))


# ------------------------------------------------------------- manifests, endpoints, rankings

_MANIFESTS = [
    ("package.json", '{"dependencies":{"elliptic":"{v}","left-pad":"1"}}', "npm", "elliptic", "{v}"), ("Cargo.toml", '[dependencies]\nsha2 = "{v}"\n', "cargo", "sha2", "{v}"), ("go.mod", "module x\nrequire golang.org/x/crypto v{v}\n", "go", "golang.org/x/crypto", "v{v}"),
    ("requirements.txt", "cryptography=={v}\ncryptography>=1\n", "pypi", "cryptography", None), ("build.gradle.kts", "implementation(\"com.google.crypto.tink:tink:{v}\")\n", "maven", "com.google.crypto.tink:tink", "{v}"), ("notes.md", "elliptic", None, None, None),
]


@query(f"SELECT 'p' || s_suppkey || '/' || f AS manifest_path, e AS ecosystem, p AS package FROM supplier JOIN (VALUES {_values([(i, c[0], c[2], c[3]) for i, c in enumerate(_MANIFESTS)])}) v(i, f, e, p) ON i = s_suppkey % {len(_MANIFESTS)} WHERE e IS NOT NULL")
def manifest_discovery(spark, sf):
    k = F.col("s_suppkey")
    files = table(spark, sf, "supplier").select(F.concat(F.lit("p"), k.cast("string"), F.lit("/"), pick([m[0] for m in _MANIFESTS], k % len(_MANIFESTS))).alias("path"), F.replace(pick([m[1] for m in _MANIFESTS], k % len(_MANIFESTS)), F.lit("{v}"), k.cast("string")).alias("content"))
    return texts.manifests(files).select("manifest_path", "ecosystem", "package")


_STATUS = [("POST_QUANTUM", "MIGRATED_PQC", "PQC_NATIVE", "LOW"), ("CLASSICAL_ASYMMETRIC", "DEPENDS_ON_ALG", "CLASSICAL_ONLY", "HIGH"), ("BLOCKCHAIN_CORE", "VULNERABLE_CLASSICAL", "CLASSICAL_ONLY", "HIGH"), ("SYMMETRIC_OR_HASH", "SAFE_SYMMETRIC", "TRANSITION", "LOW"), ("BLOCKCHAIN_CORE", "CLASSICAL_HYBRID", "TRANSITION", "MEDIUM"), ("OTHER", "UNKNOWN", "TRANSITION", "LOW")]


@query(f"SELECT p_partkey, s AS status, r AS risk FROM part JOIN (VALUES {_values([(i, c[2], c[3]) for i, c in enumerate(_STATUS)])}) v(i, s, r) ON i = p_partkey % {len(_STATUS)}")
def dependency_statuses(spark, sf):
    at = F.col("p_partkey") % len(_STATUS)
    return table(spark, sf, "part").select("p_partkey", texts.dependency_status(pick([c[0] for c in _STATUS], at), pick([c[1] for c in _STATUS], at)).alias("d")).select("p_partkey", "d.status", "d.risk")


_TARGETS = [
    ("https://Api{k}.example.com:8443/v1?x", "api{k}.example.com", 8443, False), ("http://h{k}.org/a", "h{k}.org", 80, False), ("h{k}.org:25/x", "h{k}.org", 25, False), ("[2001:db8::{k}]:99", "2001:db8::{k}", 99, True), ("[::{k}]", "::{k}", 443, True),
    ("fe80::{k}:1", "fe80::{k}:1", 443, True), ("10.0.0.{k}", "10.0.0.{k}", 443, True), (" host{k}#x ", "host{k}", 443, False), ("h{k}:port", "h{k}", 443, False), ("https://u:p@s{k}/x", "s{k}", 443, False), ("/only/path", None, None, None),
]


@query(f"SELECT c_custkey, replace(h, '{{k}}', CAST(c_custkey AS VARCHAR)) AS host, CAST(p AS INTEGER) AS port, a AS is_address FROM customer JOIN (VALUES {', '.join('(' + ', '.join(['NULL' if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else repr(x) for x in (i, *c[1:])]) + ')' for i, c in enumerate(_TARGETS))}) v(i, h, p, a) ON i = c_custkey % {len(_TARGETS)}")
def endpoint_targets(spark, sf):
    k = F.col("c_custkey")
    t = F.replace(pick([c[0] for c in _TARGETS], k % len(_TARGETS)), F.lit("{k}"), k.cast("string"))
    return table(spark, sf, "customer").select("c_custkey", texts.endpoint(t).alias("e")).select("c_custkey", "e.host", "e.port", "e.is_address")


@query(
    "WITH RECURSIVE " + catalog._CLOSURE + ", b AS (SELECT node_id, count(dst) AS r0, round(CAST(100.0::DOUBLE * (count(dst) + 1) / (SELECT count(*) FROM n) AS DECIMAL(18,6)), 1)::DOUBLE AS share_pct FROM n LEFT JOIN c ON c.src = node_id GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY share_pct DESC, r0 DESC, node_id) AS INTEGER) AS rank, node_id, r0 FROM b QUALIFY rank <= 25"
)
def blast_ranking(spark, sf):
    e = _edges(spark, sf)
    r0 = reach.reached(e)
    return views.ranked_nodes(graph.blast_of(r0).join(r0, "node_id"), 25).select("rank", "node_id", "r0")


@query(f"WITH {estate.CLASSIFIED_SQL} SELECT asset_id, regexp_matches(u, 'RSA|ECDSA|ECDH|ED25519|ASYMMETRIC|UNTRUSTED-PRNG|CLEARTEXT-HTTP|IMPROPER-SSL|DUMMY-CERT|DUMMY-HOSTNAME|DYNAMIC_UNRESOLVED|SECURE-PRNG') AS needs_design FROM classified")
def semantic_only(spark, sf):
    return estate.assets(spark, sf).select("asset_id", views.needs_design(F.col("algorithm")).alias("needs_design"))
