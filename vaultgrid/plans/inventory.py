"""Queries of lookups, asset making, ledgers, views and evidence; imported by the entry for its registrations.

Inputs are derived row by row from the driver's tables, so that a query sees
many different cases; the same derivation stands in its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules, seeds
from ..operators import commitment, evidence, factory, graph, guidance, ledger, lookups, posture, registry, scoring, simulation, views
from . import catalog, estate
from .catalog import _edges, _leaf_rows, _lineage, query, scored
from .estate import ASSETS_SQL, CLASSIFIED_SQL, SCORED_SQL, pick, table


def _values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else f"'{v}'" for v in values) + "]"


_SIGS = "sigs(ord, id, ecosystem, namespace, contract, symbol, normalized_alg, primitive_type, key_size, quantum_level, default_risk, cwe) AS (VALUES " + _values([(i, *r) for i, r in enumerate(seeds.SIGNATURES)]) + ")"
_CWES = "cwes(ord, finding, cwe_id, cwe_name) AS (VALUES " + _values([(i, *r) for i, r in enumerate(seeds.CWES)]) + ")"
_N = len(seeds.SIGNATURES)

# ------------------------------------------------------------- lookups

_ECOSYSTEMS = [r[1] for r in seeds.SIGNATURES]
_SPACES = [r[2] for r in seeds.SIGNATURES]
_CONTRACTS = [r[3] for r in seeds.SIGNATURES]
_SYMBOLS = [r[4] for r in seeds.SIGNATURES]
_ALGORITHMS = [r[5] for r in seeds.SIGNATURES]


def _calls(spark, sf):
    """Calls as a scanner sees them: whole namespaces, their ends, other cases, other symbols."""
    k = F.col("p_partkey")
    at = k % _N
    space = pick(_SPACES, at)
    shown = F.when(k % 3 == 0, space).when(k % 3 == 1, F.element_at(F.split(space, "[/.]"), -1)).otherwise(F.upper(space))
    return table(spark, sf, "part").select(
        k.alias("call_id"), F.when(k % 5 == 0, F.upper(pick(_ECOSYSTEMS, at))).otherwise(pick(_ECOSYSTEMS, at)).alias("ecosystem"), shown.alias("namespace"), pick(_CONTRACTS, at).alias("contract"),
        pick(_SYMBOLS, F.when(k % 11 == 0, at + 1).otherwise(at) % _N).alias("symbol"), pick(_ALGORITHMS, at).alias("algorithm"),
    )


_CALLS = f"""calls AS (SELECT p_partkey AS call_id, CASE WHEN p_partkey % 5 = 0 THEN upper(e) ELSE e END AS ecosystem, CASE p_partkey % 3 WHEN 0 THEN s WHEN 1 THEN string_split_regex(s, '[/.]')[-1] ELSE upper(s) END AS namespace, c AS contract,
  {_list(_SYMBOLS)}[(CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 1 ELSE p_partkey END) % {_N} + 1] AS symbol, a AS algorithm
  FROM (SELECT p_partkey, {_list(_ECOSYSTEMS)}[p_partkey % {_N} + 1] AS e, {_list(_SPACES)}[p_partkey % {_N} + 1] AS s, {_list(_CONTRACTS)}[p_partkey % {_N} + 1] AS c, {_list(_ALGORITHMS)}[p_partkey % {_N} + 1] AS a FROM part))"""


@query(
    f"""WITH {_SIGS}, {_CALLS} SELECT call_id, id, normalized_alg, default_risk FROM calls c LEFT JOIN sigs s ON lower(c.ecosystem) = s.ecosystem AND c.symbol = s.symbol AND contains(lower(s.namespace), lower(c.namespace))
    QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY ord NULLS LAST) = 1"""
)
def signature_of_call(spark, sf):
    return lookups.by_call(_calls(spark, sf), lookups.signatures(spark)).select("call_id", "id", "normalized_alg", "default_risk")


@query(f"WITH {_SIGS}, {_CALLS} SELECT call_id, id, quantum_level FROM calls c LEFT JOIN sigs s ON lower(c.ecosystem) = s.ecosystem AND c.symbol = s.symbol AND c.contract = s.contract QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY ord NULLS LAST) = 1")
def signature_of_contract(spark, sf):
    return lookups.by_contract(_calls(spark, sf), lookups.signatures(spark), ["id", "quantum_level"]).select("call_id", "id", "quantum_level")


@query(
    f"""WITH {_SIGS}, {_CALLS} SELECT call_id, id, normalized_alg, default_risk FROM calls c LEFT JOIN sigs s ON upper(normalized_alg) = upper(trim(algorithm)) OR contains(upper(id), '.' || upper(trim(algorithm)))
    QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY quantum_level DESC NULLS LAST, ord NULLS LAST) = 1"""
)
def signature_of_algorithm(spark, sf):
    return lookups.by_algorithm(_calls(spark, sf), lookups.signatures(spark)).select("call_id", "id", "normalized_alg", "default_risk")


@query(f"WITH {_SIGS}, n AS (SELECT 'part.' || p_partkey AS id, p_name AS symbol, p_brand AS normalized_alg FROM part WHERE p_size = 7 UNION ALL SELECT 'python.hashlib.md5', 'md5sum', 'MD5') SELECT id, symbol, normalized_alg FROM sigs WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, symbol, normalized_alg FROM n")
def register_signatures(spark, sf):
    p = table(spark, sf, "part").where("p_size = 7").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("normalized_alg"))
    new = p.unionByName(spark.createDataFrame([("python.hashlib.md5", "md5sum", "MD5")], "id string, symbol string, normalized_alg string"))
    return lookups.register(lookups.signatures(spark).select("ord", "id", "symbol", "normalized_alg"), new).select("id", "symbol", "normalized_alg")


# ------------------------------------------------------------- assets of findings

_FOUND = ["MD5", "RSA-1024", "AES-ECB", "SHA-256", "ED25519", "tlsv1.2", "ML-KEM-768", "X509", "3DES", "GOST"]
_GIVEN = [None, "CWE-338", "STATIC-IV", "9999", "CWE-99999", "", "TIMING-SIDE-CHANNEL", None, "md5", None]
_CODE = ["h = md5(x)", "sign_token(rsa)", "cache.set(k)", "mode = config.get('m')", "verify_checksum(f)", "SSLContext()", "encrypt(x)", "provider.make()", "db.session.add(r)", "z"]
_PATH = ["src/a.py", "tests/b.py", "svc/c.go", "lib/test_d.py", "x/E.java", "x/ETest.java", "y/f.rs", "spec/g.rb", "h.ts", "i.spec.ts"]
_FROM = ["E2_REACHABLE", "E0_UNCONFIRMED", "E1_STATIC"]


def _findings(spark, sf):
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    l = table(spark, sf, "lineitem").withColumn("k", k)  # noqa: E741
    at = lambda d: F.floor(F.col("k") / d) % 10
    return l.select(
        F.col("k").alias("seq"), F.concat(F.lit("comp_"), pick(["etag", "jwt", "key", "weak-kdf", "plain"], F.col("k") % 5)).alias("component_name"), pick(_FOUND, at(1)).alias("algorithm"), F.lit(None).cast("int").alias("key_size"),
        pick(["HASH", "SIGNATURE", "ENCRYPTION", "KEY_EXCHANGE"], F.col("k") % 4).alias("primitive_type"), pick(_PATH, at(3)).alias("file_path"), (F.col("k") % 500 + 1).cast("int").alias("line_number"),
        pick(_FROM, F.col("k") % 3).alias("evidence_level"), F.lit("scan").alias("evidence_source"), pick(_CODE, at(7)).alias("matched_code"), F.lit("py").alias("language"), pick(_GIVEN, at(11)).alias("cwe"),
        F.when(F.col("k") % 2 == 0, F.lit("uses UNTRUSTED-PRNG here")).otherwise("").alias("description"),
    )


_FINDINGS = f"""f AS (SELECT k AS seq, 'comp_' || ['etag', 'jwt', 'key', 'weak-kdf', 'plain'][k % 5 + 1] AS component_name, {_list(_FOUND)}[k % 10 + 1] AS algorithm, ['HASH', 'SIGNATURE', 'ENCRYPTION', 'KEY_EXCHANGE'][k % 4 + 1] AS primitive_type,
  {_list(_PATH)}[(k // 3) % 10 + 1] AS file_path, {_list(_FROM)}[k % 3 + 1] AS evidence_level, {_list(_CODE)}[(k // 7) % 10 + 1] AS matched_code, {_list(_GIVEN)}[(k // 11) % 10 + 1] AS cwe, CASE WHEN k % 2 = 0 THEN 'uses UNTRUSTED-PRNG here' ELSE '' END AS description
  FROM (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS k FROM lineitem))"""
_TEST_PATHS = [rules_path for rules_path in ("tests/b.py", "lib/test_d.py", "x/ETest.java", "spec/g.rb", "i.spec.ts")]
_AGILE = {"mode = config.get('m')": 1, "SSLContext()": 3, "provider.make()": 2}
_INTENT_OF_CODE = {"sign_token(rsa)": "AUTHENTICATION_SIGNATURE", "cache.set(k)": "OPERATIONAL_UTILITY", "verify_checksum(f)": "INTEGRITY_CHECKSUM", "encrypt(x)": "CONFIDENTIALITY_ENVELOPE", "db.session.add(r)": "CONFIDENTIALITY_ENVELOPE"}
_MATCH = """SELECT v, arg_min({'i': cwe_id, 'n': cwe_name}, r) AS x FROM (SELECT v, cwe_id, cwe_name, (CASE WHEN upper(finding) = v THEN 0 WHEN upper(cwe_id) = v THEN 1 ELSE 2 END) * 1000000 + (CASE WHEN upper(finding) = v OR upper(cwe_id) = v THEN 0 ELSE 100 - length(finding) END) * 1000 + ord AS r
  FROM names JOIN cwes ON upper(finding) = v OR upper(cwe_id) = v OR contains(v, upper(finding))) GROUP BY v"""


@query(
    f"""WITH {_CWES}, {_FINDINGS}, names AS (SELECT DISTINCT upper(trim(v)) AS v FROM (SELECT cwe AS v FROM f UNION SELECT algorithm FROM f UNION SELECT component_name FROM f UNION SELECT description FROM f) WHERE trim(v) <> ''), m AS ({_MATCH}),
    j AS (SELECT f.*, coalesce(a.x, b.x, c.x, d.x) AS x FROM f LEFT JOIN m a ON a.v = upper(trim(cwe)) LEFT JOIN m b ON b.v = upper(trim(algorithm)) LEFT JOIN m c ON c.v = upper(trim(component_name)) LEFT JOIN m d ON d.v = upper(trim(description)))
    SELECT 'ASSET-' || CASE WHEN seq < 100 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END AS asset_id, CASE WHEN file_path IN ({", ".join(repr(p) for p in _TEST_PATHS)}) THEN 'TEST_FIXTURE' ELSE 'PRODUCTION' END AS scope,
    CASE WHEN component_name = 'comp_etag' THEN 'OPERATIONAL_UTILITY' WHEN component_name = 'comp_jwt' THEN 'AUTHENTICATION_SIGNATURE' {" ".join(f"WHEN matched_code = '{c}' THEN '{i}'" for c, i in _INTENT_OF_CODE.items())}
      WHEN primitive_type = 'SIGNATURE' THEN 'AUTHENTICATION_SIGNATURE' WHEN primitive_type = 'HASH' THEN 'INTEGRITY_CHECKSUM' ELSE 'CONFIDENTIALITY_ENVELOPE' END AS intent_class,
    CAST(CASE WHEN algorithm = 'ML-KEM-768' THEN 5 WHEN matched_code = 'SSLContext()' OR algorithm = 'tlsv1.2' THEN 3 WHEN matched_code = 'provider.make()' THEN 2 WHEN contains(matched_code, 'config.get') THEN 1 ELSE 0 END AS INTEGER) AS agility_level,
    CASE WHEN evidence_level = 'E0_UNCONFIRMED' THEN 'LOW' ELSE 'HIGH' END AS x_confidence,
    coalesce(x.i, CASE WHEN cwe <> '' THEN CASE WHEN starts_with(cwe, 'CWE-') THEN cwe ELSE 'CWE-' || cwe END END) AS cwe_id,
    CASE WHEN x IS NOT NULL THEN x.n WHEN cwe <> '' THEN CASE WHEN description <> '' THEN description ELSE 'Cryptographic Weakness' END END AS cwe_name FROM j""".replace("'mode = config.get('m')'", "'mode = config.get(''m'')'").replace("[\"mode", "['mode")
)
def assets_of_findings(spark, sf):
    return factory.assets_of(_findings(spark, sf)).select("asset_id", "scope", "intent_class", "agility_level", "x_confidence", "cwe_id", "cwe_name")


# ------------------------------------------------------------- ledgers and streams

_ITEMS = ["src/a{}.so", "node_modules/b{}.dll", "keys/c{}.p12", "d{}.txt", "build", "x/e{}.JKS", "deep/venv", "f{}.class", ".git", "g{}/h.bin"]
_ITEM_KIND = ["UNINSPECTED_BINARY", None, "ENCRYPTED_KEYSTORE", None, "EXCLUDED_DIR", "ENCRYPTED_KEYSTORE", "EXCLUDED_DIR", "UNINSPECTED_BINARY", "EXCLUDED_DIR", "UNINSPECTED_BINARY"]


def _paths(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(F.replace(pick(_ITEMS, k % 10), F.lit("{}"), k.cast("string")).alias("path"), (k % 10).isin(4, 6, 8).alias("is_dir"))


_BOUNDARIES = f"(SELECT DISTINCT replace({_list(_ITEMS)}[s_suppkey % 10 + 1], '{{}}', CAST(s_suppkey AS VARCHAR)) AS item_path, {_list(_ITEM_KIND)}[s_suppkey % 10 + 1] AS category FROM supplier)"


@query(f"SELECT item_path, category FROM {_BOUNDARIES} WHERE category IS NOT NULL ORDER BY item_path LIMIT 100")
def boundary_ledger(spark, sf):
    return ledger.boundaries(_paths(spark, sf))


@query(f"SELECT category, count(*) AS items FROM {_BOUNDARIES} WHERE category IS NOT NULL GROUP BY 1")
def unknowns_by_category(spark, sf):
    return ledger.boundaries(_paths(spark, sf), 1 << 30).groupBy("category").agg(F.count("*").alias("items"))


@query(f"SELECT item_path, category FROM {_BOUNDARIES} WHERE category IN ('UNINSPECTED_BINARY') AND contains(lower(item_path), 'a1')")
def unknowns_search(spark, sf):
    rows = ledger.boundaries(_paths(spark, sf), 1 << 30).select(F.col("item_path").alias("id"), "item_path", "category", F.lit("a reason").alias("reason"))
    return views.unknowns(rows, "UNINSPECTED_BINARY", "A1").select("item_path", "category")


@query(
    f"""WITH {ASSETS_SQL}, inf AS (SELECT event_id, 'svc' || (user_id % 40) || '/src/mod_' || (event_id % 300) || '.py' AS file_path, CAST(event_id % 500 + 1 AS INTEGER) AS inf_line FROM events),
    m AS (SELECT event_id FROM assets a JOIN inf ON a.file_path = inf.file_path AND abs(a.line_number - inf_line) <= 5 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY event_id) = 1)
    SELECT file_path || ':' || inf_line AS item_path, 'UNCONFIRMED_DATAFLOW' AS category FROM inf WHERE event_id NOT IN (SELECT event_id FROM m) ORDER BY event_id LIMIT 90"""
)
def unconfirmed_inferences(spark, sf):
    from ..operators import correlate

    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("svc"), (F.col("user_id") % 40).cast("string"), F.lit("/src/mod_"), (F.col("event_id") % 300).cast("string"), F.lit(".py")).alias("file_path"), (F.col("event_id") % 500 + 1).cast("int").alias("line_number"))
    met = correlate.band_join(estate.assets(spark, sf), e.withColumnRenamed("line_number", "inf_line"), "file_path", "line_number", "inf_line", 5, "asset_id", ["event_id"])
    return ledger.unconfirmed(e, met.where("event_id IS NOT NULL"), "event_id", 60)


@query(
    f"""WITH {ASSETS_SQL}, u AS (SELECT 0 AS stream, algorithm, file_path, asset_seq AS place FROM assets WHERE asset_seq % 2 = 0 UNION ALL SELECT 1, upper(event_type), 'trace/' || user_id, event_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 2, n_name, 'conf/' || n_nationkey, n_nationkey FROM nation)
    SELECT 'ASSET-' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS asset_id, CAST(stream AS INTEGER) AS stream, algorithm, file_path FROM (SELECT *, row_number() OVER (ORDER BY stream, place) AS n FROM u)"""
)
def united_streams(spark, sf):
    a = estate.assets(spark, sf).where("asset_seq % 2 = 0").select("algorithm", "file_path", F.col("asset_seq").alias("at"))
    b = table(spark, sf, "events").where("event_id % 3 = 0").select(F.upper("event_type").alias("algorithm"), F.concat(F.lit("trace/"), F.col("user_id").cast("string")).alias("file_path"), F.col("event_id").alias("at"))
    c = table(spark, sf, "nation").select(F.col("n_name").alias("algorithm"), F.concat(F.lit("conf/"), F.col("n_nationkey").cast("string")).alias("file_path"), F.col("n_nationkey").alias("at"))
    numbered = ledger.united([a, b, c], ["at"], registry.numbered)
    return factory.asset_ids(numbered, "ASSET", "seq").select("asset_id", "stream", "algorithm", "file_path")


@query(
    f"""WITH {ASSETS_SQL}, run AS (SELECT event_id AS run_seq, ['AES-128', 'CAMELLIA', 'GOST'][event_id % 3 + 1] AS algorithm, ['ENCRYPTION', 'ENCRYPTION', 'HASH'][event_id % 3 + 1] AS primitive_type FROM events)
    SELECT run_seq, algorithm FROM run r WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.primitive_type = r.primitive_type AND (upper(a.algorithm) = r.algorithm OR (r.algorithm LIKE '%AES%' AND upper(a.algorithm) LIKE '%AES%')))"""
)
def unmatched_runtime(spark, sf):
    from ..operators import correlate

    at = F.col("event_id") % 3
    run = table(spark, sf, "events").select(F.col("event_id").alias("run_seq"), pick(["AES-128", "CAMELLIA", "GOST"], at).alias("algorithm"), pick(["ENCRYPTION", "ENCRYPTION", "HASH"], at).alias("primitive_type"))
    return correlate.runtime_match(run, estate.assets(spark, sf)).where("asset_id IS NULL").select("run_seq", "algorithm")


@query(
    """WITH a AS (SELECT n_nationkey AS ord, n_name AS service, n_regionkey AS value FROM nation), b AS (SELECT n_nationkey + 100 AS ord, n_name AS service, n_regionkey * 10 AS value FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT r_regionkey + 500, r_name, r_regionkey FROM region)
    SELECT service, CAST(CASE WHEN service IN (SELECT service FROM a) THEN 0 ELSE 1 END AS INTEGER) AS map_no, coalesce(a.ord, b.ord) AS ord, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (service)"""
)
def merged_maps(spark, sf):
    n = table(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("service"), F.col("n_regionkey").alias("value"))
    b = n.where("n_nationkey % 4 = 1").select((F.col("n_nationkey") + 100).alias("ord"), F.col("n_name").alias("service"), (F.col("n_regionkey") * 10).alias("value"))
    b = b.unionByName(table(spark, sf, "region").select((F.col("r_regionkey") + 500).alias("ord"), F.col("r_name").alias("service"), F.col("r_regionkey").alias("value")))
    return ledger.merged(a, b, "service", "ord").select("service", "map_no", "ord", "value")


_SERVICES = [(1, "svc1/", "PUBLIC", 1.0), (2, "mod-1", "INTERNAL", 0.2), (3, "MOD_29", "AIRGAPPED", 0.0), (4, "blush_thistle", "INTERNAL", 0.05)]


@query(
    f"""WITH {ASSETS_SQL}, s(ord, service, exposure, capture) AS (VALUES {_values(_SERVICES)}) SELECT asset_id, service, coalesce(exposure, exposure_profile) AS exposure_profile, coalesce(capture, p_hndl)::DOUBLE AS p_hndl FROM assets
    LEFT JOIN s ON contains(lower(component_name), lower(service)) OR contains(lower(file_path), lower(service)) OR contains(replace(lower(component_name), '-', ''), replace(lower(service), '-', '')) QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ord NULLS LAST) = 1"""
)
def asset_exposures(spark, sf):
    services = spark.createDataFrame(_SERVICES, "ord int, service string, exposure string, capture double")  # fixed rows
    return ledger.exposed(estate.assets(spark, sf), services).select("asset_id", "service", "exposure_profile", "p_hndl")


@query(f"WITH {ASSETS_SQL} SELECT asset_id, CASE WHEN contains(file_path, 'svc7/') THEN 'svc7/' END AS service, 'INTERNAL' AS exposure_profile, CASE WHEN contains(file_path, 'svc7/') THEN 0.4 ELSE 0.3 END::DOUBLE AS p_hndl FROM assets")
def uniform_exposure(spark, sf):
    services = spark.createDataFrame([(1, "nowhere", "INTERNAL", 0.3), (2, "svc7/", "INTERNAL", 0.4)], "ord int, service string, exposure string, capture double")  # fixed rows
    return ledger.exposed(estate.assets(spark, sf), services).select("asset_id", "service", "exposure_profile", "p_hndl")


# ------------------------------------------------------------- views

_CATEGORY = "CASE WHEN is_pqc THEN 'PQC' WHEN regexp_matches(algorithm, '(?i)md5|sha-?1$|des|rc4|rsa-1024|ecb') THEN 'DEPRECATED' ELSE 'CLASSICAL' END"


def _categorised(spark, sf):
    return scored(spark, sf).withColumn("category", posture.category(F.col("algorithm"), F.col("is_pqc")))


@query(f"WITH {SCORED_SQL} SELECT asset_id, {_CATEGORY} AS category FROM scored WHERE {_CATEGORY} = 'DEPRECATED' AND scope = 'PRODUCTION' AND asset_seq % 2 = 0 AND (contains(lower(asset_id), '1') OR contains(lower(component_name), '1') OR contains(lower(algorithm), '1') OR contains(lower(file_path), '1'))")
def inventory_filter(spark, sf):
    a = _categorised(spark, sf).withColumns({"cwe_id": F.when(F.col("asset_seq") % 2 == 0, "").otherwise("CWE-327"), "cwe_name": F.lit(None).cast("string"), "target": F.lit("none")})
    return views.inventory(a, "DEPRECATED", "PRODUCTION", "NONE", "1").select("asset_id", "category")


_DEPS = """deps AS (SELECT l_orderkey AS dep_id, 'app' || (l_orderkey % 50) || '/pom.xml' AS manifest_path, l_linestatus AS ecosystem, 'lib-' || l_suppkey AS package, CASE l_returnflag WHEN 'A' THEN 'VULNERABLE_CLASSICAL' ELSE 'SAFE_SYMMETRIC' END AS readiness,
  CASE WHEN l_linenumber = 1 THEN 'TEST_FIXTURE' ELSE 'PRODUCTION' END AS scope, CASE WHEN l_partkey % 7 = 0 THEN 'CVE-2020-' || (l_partkey % 100) END AS cve_id FROM lineitem)"""


def _deps(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("dep_id"), F.concat(F.lit("app"), (F.col("l_orderkey") % 50).cast("string"), F.lit("/pom.xml")).alias("manifest_path"), F.col("l_linestatus").alias("ecosystem"), F.concat(F.lit("lib-"), F.col("l_suppkey").cast("string")).alias("package"),
        F.when(F.col("l_returnflag") == "A", "VULNERABLE_CLASSICAL").otherwise("SAFE_SYMMETRIC").alias("readiness"), F.when(F.col("l_linenumber") == 1, "TEST_FIXTURE").otherwise("PRODUCTION").alias("scope"), F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("CVE-2020-"), (F.col("l_partkey") % 100).cast("string"))).alias("cve_id"),
    )


@query(f"WITH {_DEPS} SELECT dep_id, package, cve_id FROM deps WHERE readiness = 'VULNERABLE_CLASSICAL' AND scope = 'PRODUCTION' AND cve_id IS NOT NULL AND (contains(lower(package), '1') OR contains(lower(ecosystem), '1') OR contains(lower(manifest_path), '1') OR contains(lower(cve_id), '1'))")
def dependency_filter(spark, sf):
    rows = _deps(spark, sf).withColumn("status", F.col("readiness"))
    return views.dependencies(rows, "VULNERABLE_CLASSICAL", "PRODUCTION", "VULNERABLE", "1").select("dep_id", "package", "cve_id")


@query(f"WITH {_DEPS} SELECT manifest_path, count(*) AS packages, count(*) FILTER (readiness = 'VULNERABLE_CLASSICAL') AS vulnerable, string_agg(package, ',' ORDER BY package) AS listed FROM deps GROUP BY 1")
def dependencies_by_manifest(spark, sf):
    return views.by_manifest(_deps(spark, sf))


@query(f"WITH {SCORED_SQL} SELECT asset_id FROM scored WHERE risk_level = 'LOW' AND (contains(lower(algorithm), 'sha') OR contains(lower(file_path), 'sha') OR contains(lower(component_name), 'sha'))")
def simulation_filter(spark, sf):
    return views.simulated(scored(spark, sf).withColumn("risk_category", F.col("risk_level")), "LOW", "SHA").select("asset_id")


@query(f"WITH {CLASSIFIED_SQL} SELECT asset_id, {_CATEGORY} <> 'PQC' AND NOT regexp_matches(u, 'ML-DSA|ML-KEM|DILITHIUM|KYBER|LWE|RISTRETTO|PEDERSEN|JWT-HMAC|HMAC-SHA256') AND u NOT IN ('AES-256-GCM', 'AES-256') AND regexp_matches(u, 'ECDSA|RSA|MD5|SHA1|DES|CBC|DH') AS remediable FROM classified")
def remediable_assets(spark, sf):
    c = scoring.classified(estate.assets(spark, sf))
    return c.select("asset_id", views.remediable(posture.category(F.col("algorithm"), F.col("is_pqc")), F.col("algorithm")).alias("remediable"))


@query(f"WITH {ASSETS_SQL} SELECT asset_id FROM assets WHERE list_has_any(string_split(file_path, '/'), ['svc3', 'tests', 'mod_5.py'])")
def folder_restriction(spark, sf):
    return estate.assets(spark, sf).where(views.in_folders(F.col("file_path"), ["svc3", "tests", "mod_5.py"])).select("asset_id")


@query(f"WITH {SCORED_SQL} SELECT CAST(row_number() OVER (ORDER BY CASE risk_level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 99 END, asset_seq) AS INTEGER) AS rank, asset_id, risk_level FROM scored QUALIFY rank <= 100")
def risk_priority(spark, sf):
    first = scored(spark, sf).orderBy(views.risk_order(F.col("risk_level")), "asset_seq").limit(100)
    return first.select(F.row_number().over(W.orderBy(views.risk_order(F.col("risk_level")), "asset_seq")).alias("rank"), "asset_id", "risk_level")


@query("SELECT CAST(row_number() OVER (ORDER BY CASE WHEN starts_with(s_name, 'Supplier#00001') THEN 0 ELSE 1 END, lower(s_name), s_name) AS INTEGER) AS rank, s_suppkey FROM supplier QUALIFY rank <= 40")
def pinned_projects(spark, sf):
    keys = views.pinned_first(table(spark, sf, "supplier"), "s_name", "Supplier#00001")
    return table(spark, sf, "supplier").orderBy(*keys).limit(40).select(F.row_number().over(W.orderBy(*keys)).alias("rank"), "s_suppkey")


@query(
    f"""WITH {SCORED_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER ({_CATEGORY} = 'PQC') AS pqc, count(*) FILTER ({_CATEGORY} = 'CLASSICAL') AS classical, count(*) FILTER ({_CATEGORY} = 'DEPRECATED') AS deprecated FROM scored WHERE scope = 'PRODUCTION'),
    r AS (SELECT *, CAST(trunc(greatest(5.0::DOUBLE, least(100.0::DOUBLE, (pqc + greatest(0, classical - critical - high)) / n::DOUBLE * 100.0 - (critical * 35.0 + high * 15.0 + deprecated * 20.0) / n::DOUBLE))) AS INTEGER) AS raw, CAST(trunc(greatest(8.0::DOUBLE, least(55.0::DOUBLE, 60.0 - critical / n::DOUBLE * 50.0))) AS INTEGER) AS cap FROM c)
    SELECT n, critical, high, pqc, classical, deprecated, round(CAST(pqc / n::DOUBLE * 100.0 AS DECIMAL(18,6)), 1)::DOUBLE AS migrated_pct, CASE WHEN critical > 0 THEN least(cap, raw) WHEN high > 0 THEN least(75, raw) ELSE raw END AS readiness FROM r"""
)
def readiness_capped(spark, sf):
    return views.capped_readiness(_categorised(spark, sf))


@query(f"WITH {SCORED_SQL} SELECT coalesce(portfolio, '*') AS portfolio, round(CAST((count(*) FILTER (risk_level = 'CRITICAL') * 2.5 + count(*) FILTER (risk_level = 'HIGH') * 1.5)::DOUBLE / greatest(1, count(*)) AS DECIMAL(18,6)), 2)::DOUBLE AS friction_score FROM scored GROUP BY ROLLUP (portfolio)")
def friction_scores(spark, sf):
    return views.friction(scored(spark, sf), "portfolio")


@query(
    """WITH r AS (SELECT CASE WHEN o_orderkey % 5 < 4 THEN (o_orderkey % 97)::DOUBLE / 100 END AS breach, ['CRITICAL', 'HIGH', 'LOW', 'MEDIUM'][o_orderkey % 4 + 1] AS risk_category, CAST(2028 + o_orderkey % 9 AS INTEGER) AS var_year FROM orders)
    SELECT count(*) AS assets, count(breach) AS simulated, round(CAST(avg(breach) * 100 AS DECIMAL(18,6)), 2)::DOUBLE AS mean_pct, round(CAST(max(breach) * 100 AS DECIMAL(18,6)), 2)::DOUBLE AS max_pct, count(*) FILTER (risk_category = 'CRITICAL' OR coalesce(breach, 0) > 0.3) AS critical, count(*) FILTER (risk_category = 'HIGH') AS high,
    min(var_year) FILTER (risk_category IN ('CRITICAL', 'HIGH')) AS var_year FROM r"""
)
def simulation_figures(spark, sf):
    k = F.col("o_orderkey")
    r = table(spark, sf, "orders").select(F.when(k % 5 < 4, (k % 97).cast("double") / 100).alias("breach"), pick(["CRITICAL", "HIGH", "LOW", "MEDIUM"], k % 4).alias("risk_category"), (F.lit(2028) + k % 9).cast("int").alias("var_year"))
    return views.simulation_figures(r)


@query(f"WITH {SCORED_SQL} SELECT asset_id, round(CAST(least(0.999::DOUBLE, greatest(0.01::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + exp(((z_regulatory_year - 2026) - (x_years_effective + 2.0)) / 1.8::DOUBLE)))) AS DECIMAL(18,9)), 6)::DOUBLE AS probability, round(CAST(exp(-0.5::DOUBLE * ((deadline_year - z_regulatory_year) / 2.4::DOUBLE) * ((deadline_year - z_regulatory_year) / 2.4::DOUBLE)) / (2.4::DOUBLE * sqrt(2 * pi())) AS DECIMAL(18,9)), 6)::DOUBLE AS density FROM scored")
def what_if_breach(spark, sf):
    six = lambda c: F.round(c.cast("decimal(18,9)"), 6).cast("double")
    z = F.col("z_regulatory_year").cast("double")
    return scored(spark, sf).select("asset_id", six(views.what_if(z, F.col("x_years_effective"), F.lit(2.0), 2026)).alias("probability"), six(views.collapse_density(F.col("deadline_year"), z)).alias("density"))


@query("WITH " + catalog._EDGES + " SELECT node_id, CAST(sum(up) AS BIGINT) AS upstream, CAST(sum(down) AS BIGINT) AS downstream FROM (SELECT dst AS node_id, 1 AS up, 0 AS down FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY 1")
def graph_neighbours(spark, sf):
    return views.neighbours(_edges(spark, sf))


@query("WITH " + catalog._EDGES + ", d AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT node_id, degree FROM d ORDER BY degree DESC, node_id LIMIT 1")
def busiest_node(spark, sf):
    return views.busiest(graph.degrees(_edges(spark, sf)))


@query("WITH " + catalog._EDGES + ", n AS (SELECT 'S' || s_suppkey AS node_id FROM supplier UNION ALL SELECT 'Z' || n_nationkey FROM nation) SELECT node_id FROM n WHERE node_id IN (SELECT src FROM e UNION SELECT dst FROM e)")
def connected_nodes(spark, sf):
    node = lambda t, c, p: table(spark, sf, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("node_id"))
    return graph.connected_only(node("supplier", "s_suppkey", "S").unionAll(node("nation", "n_nationkey", "Z")), _edges(spark, sf))


@query("WITH c AS (SELECT n_name AS node, n_regionkey AS r, p_type AS algorithm FROM nation JOIN part ON p_partkey % 25 = n_nationkey) SELECT node, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms, count(DISTINCT algorithm) AS n FROM c GROUP BY 1")
def algorithms_by_node(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("node"), F.col("n_nationkey").alias("k"))
    p = table(spark, sf, "part").select((F.col("p_partkey") % 25).alias("k"), F.col("p_type").alias("algorithm"))
    return graph.algorithms(p.join(F.broadcast(n), "k"), "node", "algorithm")  # 25 rows


@query(f"WITH {catalog._LINEAGE}, f AS (SELECT target_id AS hub, min(source_id) AS input FROM le WHERE edge_type = 'FEEDS' GROUP BY 1), s AS (SELECT source_id AS hub, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS sinks FROM le WHERE edge_type = 'REACHES' GROUP BY 1) SELECT hub, input, sinks FROM f FULL JOIN s USING (hub)")
def variable_flows(spark, sf):
    return views.variable_flows(_lineage(spark, sf))


@query(f"WITH {catalog._LINEAGE}, h AS (SELECT DISTINCT source_id AS node_id FROM le WHERE source_id LIKE 'nx:1%') SELECT source_id, target_id, edge_type FROM le WHERE source_id IN (SELECT node_id FROM h)")
def lineage_filter(spark, sf):
    e = _lineage(spark, sf)
    hubs = e.select(F.col("source_id").alias("node_id")).distinct().withColumn("source_type", F.when(F.col("node_id").startswith("nx:1"), "DATABASE").otherwise("ENV"))
    return views.lineage(hubs, e, e.select(F.col("target_id").alias("node_id")).distinct(), "DATABASE")[1]


@query(f"WITH {catalog._LINEAGE}, n AS (SELECT source_id AS node_id FROM le UNION SELECT target_id FROM le), c AS (SELECT node_id, CASE left(node_id, 3) WHEN 'in:' THEN 'INGRESS' WHEN 'out' THEN 'EGRESS' ELSE 'NEXUS' END AS category FROM n) SELECT node_id, category, CAST(CASE category WHEN 'INGRESS' THEN 0 WHEN 'NEXUS' THEN 1 ELSE 2 END AS INTEGER) AS layer, CAST(row_number() OVER (PARTITION BY category ORDER BY node_id) - 1 AS INTEGER) AS place FROM c")
def lineage_layout(spark, sf):
    e = _lineage(spark, sf)
    n = e.select(F.col("source_id").alias("node_id")).union(e.select(F.col("target_id").alias("node_id"))).distinct()
    kind = F.when(F.col("node_id").startswith("in:"), "INGRESS").when(F.col("node_id").startswith("out"), "EGRESS").otherwise("NEXUS")
    return views.layered(n.withColumn("category", kind), "category", "node_id", {"INGRESS": 0, "NEXUS": 1, "EGRESS": 2})


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents)
    SELECT doc_id AS path, line_no, (SELECT count(*) FROM l b WHERE b.doc_id = a.doc_id AND abs(b.line_no - a.line_no) <= 5) AS around, md5(string_agg(b.text, chr(10) ORDER BY b.line_no)) AS digest FROM l a JOIN l b USING (doc_id) WHERE abs(a.line_no - b.line_no) <= 5 GROUP BY doc_id, a.line_no, line_no""".replace("SELECT doc_id AS path, line_no, (SELECT count(*) FROM l b WHERE b.doc_id = a.doc_id AND abs(b.line_no - a.line_no) <= 5) AS around,", "SELECT doc_id AS path, a.line_no AS line_no, count(*) AS around,").replace("GROUP BY doc_id, a.line_no, line_no", "GROUP BY doc_id, a.line_no"))
def context_windows(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "text")
    got = views.context_lines(lines)
    return got.select("path", "line_no", F.size(F.split("context", "\n")).cast("long").alias("around"), F.md5("context").alias("digest"))


@query("SELECT md5(CAST(p_size AS VARCHAR)) AS fingerprint, min('certs/' || p_partkey || '.pem') AS path, count(*) AS copies, coalesce(string_agg('certs/' || p_partkey || '.pem', ',' ORDER BY 'certs/' || p_partkey || '.pem')[length(min('certs/' || p_partkey || '.pem')) + 2:], '') AS replicas FROM part GROUP BY 1")
def certificate_replicas(spark, sf):
    return views.replicas(table(spark, sf, "part").select(F.md5(F.col("p_size").cast("string")).alias("fingerprint"), F.concat(F.lit("certs/"), F.col("p_partkey").cast("string"), F.lit(".pem")).alias("path")))


@query("WITH a AS (SELECT s_suppkey AS ecosystem, s_name AS package, CASE WHEN s_suppkey % 3 = 0 THEN 'CVE-1-' || s_suppkey END AS c FROM supplier), d AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem) SELECT l_orderkey, l_linenumber, c AS cve_id FROM d LEFT JOIN a ON ecosystem = l_suppkey")
def package_advisories(spark, sf):
    s = table(spark, sf, "supplier")
    feed = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.array(F.concat(F.lit("CVE-1-"), F.col("s_suppkey").cast("string")), F.lit("GHSA-x"))).alias("alias"), F.lit(1).alias("o"))
    return registry.advisories(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), feed, "l_suppkey").select("l_orderkey", "l_linenumber", "cve_id")


# ------------------------------------------------------------- simulation joined to the inventory


@query(f"WITH {SCORED_SQL}, sim AS (SELECT asset_id, ['CRITICAL', 'LOW', NULL][asset_seq % 3 + 1] AS risk_category FROM scored WHERE asset_seq % 4 <> 0) SELECT s.asset_id, coalesce(risk_category, risk_level) AS risk FROM scored s LEFT JOIN sim USING (asset_id)")
def simulated_risk(spark, sf):
    s = scored(spark, sf)
    sim = s.where("asset_seq % 4 <> 0").select("asset_id", pick(["CRITICAL", "LOW", None], F.col("asset_seq") % 3).alias("risk_category"))
    return simulation.overridden(s, sim).select("asset_id", "risk")


# ------------------------------------------------------------- evidence


def _root_and_proofs(spark, sf):
    leaves = _leaf_rows(spark, sf)
    n = leaves.count()
    return commitment.root(leaves, n).first()["root"], commitment.proofs(leaves, n)


@query(f"WITH {ASSETS_SQL} SELECT asset_id, asset_seq % 10 <> 0 AS leaf_holds, asset_seq % 15 <> 7 AS path_holds FROM assets")
def proof_packages(spark, sf):
    root, proofs = _root_and_proofs(spark, sf)
    packages = evidence.packages(proofs, scored(spark, sf), root, commitment.SALT)
    n = F.regexp_extract("asset_id", r"(\d+)$", 1).cast("long")
    touched = packages.withColumn("algorithm", F.when(n % 10 == 0, F.concat("algorithm", F.lit("X"))).otherwise(F.col("algorithm"))).withColumn("expected_root", F.when(n % 15 == 7, F.sha2("expected_root", 256)).otherwise(F.col("expected_root")))
    return evidence.package_holds(touched)


_STATUSES = ["VERIFIED", "INVALID_TYPE", "MISSING_PAYLOAD", "NO_SIGNATURE", "TAMPERED", "ROOT_MISMATCH", "NO_SUBJECT"]
_STATEMENT = """'{"subject":[{"digest":{"sha256":"' || sha256(CAST(o_orderkey AS VARCHAR)) || '"}}]}'"""


@query(f"SELECT o_orderkey, {_list(_STATUSES)}[o_orderkey % 7 + 1] AS status, base64(encode(CASE WHEN o_orderkey % 7 = 6 THEN '{{}}' ELSE {_STATEMENT} END)) AS payload FROM orders")
def envelope_checks(spark, sf):
    k = F.col("o_orderkey")
    at = k % 7
    digest = F.sha2(k.cast("string"), 256)
    o = table(spark, sf, "orders").select("o_orderkey", digest.alias("root"), F.when(at == 6, "{}").otherwise(F.concat(F.lit('{"subject":[{"digest":{"sha256":"'), digest, F.lit('"}}]}'))).alias("statement"))
    e = evidence.envelopes(o).withColumns(
        {
            "kept": F.col("payload"), "payloadType": F.when(at == 1, "text/plain").otherwise(F.col("payloadType")), "payload": F.when(at == 2, "").otherwise(F.col("payload")),
            "signed_sha256": F.when(at == 3, "").when(at == 4, F.sha2("pae_sha256", 256)).otherwise(F.col("pae_sha256")), "root": F.when(at == 5, F.concat(F.lit("0x"), F.sha2("root", 256))).otherwise(F.concat(F.lit("0X"), F.upper("root"))),
        }
    )
    return evidence.envelope_status(e, F.replace(F.col("root"), F.lit("0X"), F.lit("0x"))).select("o_orderkey", "status", F.col("kept").alias("payload"))


@query(
    f"""WITH {SCORED_SQL}, c AS (SELECT count(*) AS assets, (SELECT count(*) FROM {_BOUNDARIES} WHERE category IS NOT NULL) AS unknowns FROM scored)
    SELECT 'np-' || left(sha256('{{"assets_count": ' || assets || ', "merkle_root": "ab", "target": "estate", "unknowns_count": ' || unknowns || '}}'), 16) AS certificate_id, assets, unknowns, 'FAILED' AS legacy, (SELECT string_agg(DISTINCT f, ',' ORDER BY f) FROM scored, (SELECT unnest(['DES', '3DES', 'TRIPLEDES', 'RC4', 'ARCFOUR', 'MD4', 'MD5', 'SHA1-SIGNATURE']) AS f) WHERE contains(upper(algorithm), f)) AS forbidden_found,
    'PASSED' AS asymmetric, 'PASSED' AS boundaries, false AS certified, true AS holds FROM c"""
)
def negative_certificate(spark, sf):
    unknowns = ledger.boundaries(_paths(spark, sf), 1 << 30)
    advised = guidance.advised(scored(spark, sf))
    cert = evidence.certificate(advised, unknowns, "estate", "ab", F.coalesce(F.col("target"), F.lit("")) != "")
    return cert.withColumn("holds", evidence.certificate_holds(cert, "ab", "estate"))


# ------------------------------------------------------------- registry


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def registry_newest(spark, sf):
    projects = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("created_at"))
    return registry.newest(projects, "created_at", 20).select("id", "name")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey = 7")
def registry_point(spark, sf):
    return registry.by_key(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id", 7)


@query(
    """WITH b AS (SELECT o_custkey AS project_id, o_orderkey AS scan_id, o_orderstatus AS s FROM orders) SELECT c_custkey AS id, CASE WHEN last.s IS NULL THEN 'IDLE' WHEN last.s = 'O' THEN 'SCANNING' WHEN last.s = 'F' THEN 'READY' ELSE 'FAILED' END AS status, coalesce(n, 0) AS scans
    FROM customer LEFT JOIN (SELECT project_id, arg_max(s, scan_id) AS s, count(*) AS n FROM b GROUP BY 1) last ON project_id = c_custkey"""
)
def registry_scans(spark, sf):
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("IDLE").alias("status"))
    scans = table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("scan_id"), pick_status(F.col("o_orderstatus")).alias("status"))
    return registry.with_scans(projects, scans)


def pick_status(c):
    return F.when(c == "O", "SCANNING").when(c == "F", "READY").otherwise("FAILED")
