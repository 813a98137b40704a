"""Every query of the estate engine by name, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed, rules
from ..operators import commitment, correlate, graph, portfolio, posture, reach, scoring, simulation
from ..sources import texts
from . import estate
from .estate import ASSETS_SQL, CLASSIFIED_SQL, ITEMS_SQL, SCORED_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "MANUAL_REVIEW_REQUIRED"]
BUDGET = 10.0


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.scored(estate.assets(spark, sf))


# ------------------------------------------------------------- classification and scoring


@query(f"WITH {SCORED_SQL} SELECT risk_level, count(*) AS assets, min(y_max_years) AS least_runway FROM scored WHERE scope = 'PRODUCTION' GROUP BY 1")
def risk_summary(spark, sf):
    return posture.risk_counts(scored(spark, sf).where("scope = 'PRODUCTION'"))


@query(f"WITH {CLASSIFIED_SQL} SELECT asset_id, asset_kind, cipher_mode, bits, is_pqc, is_broken, safe_name FROM classified")
def classify_assets(spark, sf):
    return scoring.classified(estate.assets(spark, sf)).select("asset_id", "asset_kind", "cipher_mode", "bits", "is_pqc", "is_broken", "safe_name")


@query(f"WITH {SCORED_SQL} SELECT asset_id, x_years_effective, z_regulatory_year, z_regulatory_phase, y_max_years, deadline_year, risk_level, crypto_shredding_viable, agility_factor, r_q_score FROM scored")
def score_assets(spark, sf):
    return scored(spark, sf).select("asset_id", "x_years_effective", "z_regulatory_year", "z_regulatory_phase", "y_max_years", "deadline_year", "risk_level", "crypto_shredding_viable", "agility_factor", "r_q_score")


_KINDS = """SELECT asset_id, CAST(CASE WHEN asset_kind = 'POST_QUANTUM' THEN CASE u WHEN 'ML-KEM-768' THEN 192 WHEN 'ML-DSA-87' THEN 256 WHEN 'KYBER512' THEN 128 ELSE 192 END
  WHEN asset_kind = 'CLASSICAL_ASYMMETRIC' THEN CASE WHEN bits >= 3072 THEN 128 WHEN bits >= 2048 THEN 112 ELSE 80 END WHEN asset_kind = 'ELLIPTIC_CURVE' THEN bits // 2 WHEN asset_kind = 'SYMMETRIC' THEN bits ELSE 0 END AS INTEGER) AS security_bits,
  CAST(CASE WHEN asset_kind = 'POST_QUANTUM' THEN CASE u WHEN 'ML-KEM-768' THEN 2272 WHEN 'ML-DSA-87' THEN 7219 WHEN 'KYBER512' THEN 1568 ELSE 32 END WHEN asset_kind IN ('CLASSICAL_ASYMMETRIC', 'ELLIPTIC_CURVE') THEN (bits // 8) * 2 ELSE 0 END AS INTEGER) AS flight_bytes FROM classified"""


@query(f"WITH {CLASSIFIED_SQL} {_KINDS}")
def strength_and_flight(spark, sf):
    c = scoring.classified(estate.assets(spark, sf))
    k, a, b = F.col("asset_kind"), F.col("algorithm"), F.col("bits")
    return c.select("asset_id", rules.security_bits(k, a, b).alias("security_bits"), rules.flight_bytes(k, a, b, F.col("key_size")).alias("flight_bytes"))


@query(f"WITH {CLASSIFIED_SQL} SELECT asset_id, CASE WHEN intent_class IS NULL THEN '' ELSE CASE primitive_type WHEN 'SIGNATURE' THEN 'AUTHENTICATION_SIGNATURE' WHEN 'HASH' THEN 'INTEGRITY_CHECKSUM' ELSE 'CONFIDENTIALITY_ENVELOPE' END END AS intent, CAST(CASE WHEN regexp_matches(lower(algorithm), 'ml-dsa|ml-kem|kyber|slh-dsa') THEN 5 WHEN asset_seq % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS agility FROM classified")
def intent_and_agility(spark, sf):
    a = estate.assets(spark, sf)
    line = F.when(F.col("asset_seq") % 3 == 0, "mode = os.getenv('MODE')").otherwise("digest = hash_of(x)")
    empty = F.lit("")
    return a.select("asset_id", rules.intent_of(empty, empty, empty, F.col("primitive_type")).alias("intent"), rules.agility_of(line, empty, F.col("algorithm")).alias("agility"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, CASE l_returnflag WHEN 'A' THEN 'GENERIC-KDF' WHEN 'N' THEN 'GENERIC-AEAD-CIPHER' ELSE 'GENERIC-ASYMMETRIC-SIGNER' END AS shape FROM lineitem""")
def signature_shapes(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    args = F.when(F.col("l_returnflag") == "A", F.array(F.lit("password"), F.lit("salt"), F.lit("rounds"))).when(F.col("l_returnflag") == "N", F.array(F.lit("key"), F.lit("nonce"), F.lit("data"), F.lit("aad"))).otherwise(F.array(F.lit("privKey"), F.lit("msg_hash")))
    return l.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", rules.signature_shape(args).alias("shape"))


# ------------------------------------------------------------- aggregates


@query(f"WITH {SCORED_SQL}, d AS (SELECT unnest({LEVELS}) AS risk_level) SELECT d.risk_level, count(asset_id) AS assets FROM d LEFT JOIN scored s ON s.risk_level = d.risk_level AND scope = 'PRODUCTION' GROUP BY 1")
def risk_distribution(spark, sf):
    return posture.distribution(scored(spark, sf).where("scope = 'PRODUCTION'"), "risk_level", LEVELS)


@query(f"WITH {ASSETS_SQL}, d AS (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS agility_level) SELECT d.agility_level, count(asset_id) AS assets FROM d LEFT JOIN assets a ON a.agility_level = d.agility_level GROUP BY 1")
def agility_distribution(spark, sf):
    return posture.distribution(estate.assets(spark, sf), "agility_level", list(range(8)))


@query(f"WITH {ASSETS_SQL}, d AS (SELECT unnest({[*estate.INTENTS, 'NONE']}) AS intent_class) SELECT d.intent_class, count(asset_id) AS assets FROM d LEFT JOIN assets a ON a.intent_class = d.intent_class GROUP BY 1")
def intent_distribution(spark, sf):
    return posture.distribution(estate.assets(spark, sf), "intent_class", [*estate.INTENTS, "NONE"])


@query(f"WITH {SCORED_SQL} SELECT coalesce(risk_level, '*') AS risk_level, coalesce(scope, '*') AS scope, CAST(grouping(risk_level, scope) AS INTEGER) AS level, count(*) AS assets FROM scored GROUP BY CUBE (risk_level, scope)")
def posture_cube(spark, sf):
    return posture.summary_cube(scored(spark, sf))


@query(
    f"""WITH {SCORED_SQL}, g AS (SELECT portfolio, count(*) AS assets, count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (is_broken) AS broken FROM scored GROUP BY ROLLUP (portfolio))
    SELECT coalesce(portfolio, '*') AS portfolio, assets, critical, high, broken, greatest(5, least(100, 100 - 12 * critical - 6 * high - 8 * broken)) AS clamped_score,
    round(CAST(100.0::DOUBLE * (assets - critical) / assets AS DECIMAL(18,6)), 1)::DOUBLE AS share_score FROM g"""
)
def readiness_scores(spark, sf):
    return posture.readiness(scored(spark, sf), "portfolio")


@query(f"WITH {ASSETS_SQL} SELECT algorithm, count(*) AS assets FROM assets GROUP BY 1 ORDER BY assets DESC, algorithm LIMIT 5")
def top_algorithms(spark, sf):
    return posture.top_algorithms(estate.assets(spark, sf))


@query(f"WITH {CLASSIFIED_SQL} SELECT CASE WHEN is_pqc THEN 'PQC' WHEN regexp_matches(algorithm, '(?i)md5|sha-?1$|des|rc4|rsa-1024|ecb') THEN 'DEPRECATED' ELSE 'CLASSICAL' END AS category, scope, count(*) AS assets FROM classified GROUP BY 1, 2")
def category_by_scope(spark, sf):
    c = scoring.classified(estate.assets(spark, sf))
    return c.groupBy(posture.category(F.col("algorithm"), F.col("is_pqc")).alias("category"), "scope").agg(F.count("*").alias("assets"))


@query(f"WITH {SCORED_SQL} SELECT 'HIGH' AS threshold, count(*) AS assets, count(*) FILTER (risk_level IN ('CRITICAL', 'HIGH')) AS violations, count(*) FILTER (risk_level IN ('CRITICAL', 'HIGH')) <= 5 AS passed, CAST(CASE WHEN count(*) FILTER (risk_level IN ('CRITICAL', 'HIGH')) <= 5 THEN 0 ELSE 1 END AS INTEGER) AS exit_code FROM scored WHERE scope = 'PRODUCTION'")
def quality_gate(spark, sf):
    return posture.gate(scored(spark, sf).where("scope = 'PRODUCTION'"), "high", 5)


@query(f"WITH {SCORED_SQL} SELECT CAST(row_number() OVER (ORDER BY y_max_years, asset_seq) AS INTEGER) AS rank, asset_id, algorithm, x_tier, y_max_years, z_regulatory_year, risk_level FROM scored ORDER BY y_max_years, asset_seq LIMIT 50")
def backlog(spark, sf):
    return posture.backlog(scored(spark, sf), 50)


@query(f"WITH {ASSETS_SQL} SELECT '3DES,DES,MD5' AS forbidden_found, false AS claim_legacy, count(*) AS assets, count(*) FILTER (primitive_type IN ('KEY_EXCHANGE', 'SIGNATURE')) AS asymmetric FROM assets")
def negative_proof(spark, sf):
    return posture.negative_proof(scored(spark, sf))


_RATIOS = "round(CAST(CASE WHEN {b} = 0 THEN NULL ELSE ({a})::DOUBLE / ({b})::DOUBLE END AS DECIMAL(18,6)), 4)::DOUBLE"


@query(
    "WITH p AS (SELECT d.source, d.lang, quality = 0 AS e, regexp_matches(coalesce(text, ''), '[#*$%&|]{3}') AS f FROM documents d JOIN labels USING (doc_id)), g AS (SELECT source, lang, CAST(grouping(source, lang) AS INTEGER) AS level, count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (NOT e AND NOT f) AS tn, count(*) FILTER (e AND NOT f) AS fn FROM p GROUP BY GROUPING SETS ((source), (lang), ())) "
    + "SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, level, tp, fp, tn, fn, "
    + ", ".join(_RATIOS.format(a=a, b=b) + f" AS {n}" for n, a, b in (("precision", "tp", "(tp + fp)"), ("recall", "tp", "(tp + fn)"), ("specificity", "tn", "(tn + fp)"), ("f1", "2 * tp", "(2 * tp + fp + fn)"), ("accuracy", "tp + tn", "(tp + fp + tn + fn)")))
    + " FROM g"
)
def detection_confusion(spark, sf):
    pairs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("source", "lang", (F.col("quality") == 0).alias("e"), F.coalesce("text", F.lit("")).rlike(r"[#*$%&|]{3}").alias("f"))
    return posture.confusion(pairs, "e", "f", ["source", "lang"])


# ------------------------------------------------------------- filters and searches


@query(f"WITH {SCORED_SQL} SELECT asset_id, algorithm, file_path, risk_level FROM scored WHERE scope = 'PRODUCTION' AND risk_level = 'CRITICAL' AND (contains(lower(algorithm), 'rsa') OR contains(lower(file_path), 'mod_1') OR contains(lower(component_name), 'rsa'))")
def inventory_search(spark, sf):
    hit = F.contains(F.lower("algorithm"), F.lit("rsa")) | F.contains(F.lower("file_path"), F.lit("mod_1")) | F.contains(F.lower("component_name"), F.lit("rsa"))
    return scored(spark, sf).where((F.col("scope") == "PRODUCTION") & (F.col("risk_level") == "CRITICAL") & hit).select("asset_id", "algorithm", "file_path", "risk_level")


_PATHS = ["src/a.py", "docs/a.py", "lib/.hidden/a.py", "node_modules/x.js", "a/requirements-dev.txt", "a/notes.txt", "keys/demo-keypair.json", "tests/a.py", "src/test_a.py", "pkg/a_test.go", "app/FooTest.java", "web/a.spec.ts", "src/main.rs", "config/.env.sample"]
_SCAN = [True, False, False, False, True, False, False, True, True, True, True, True, True, False]
_TEST = [False, False, False, False, False, False, False, True, True, True, True, True, False, False]


@query(f"SELECT p_partkey, {_PATHS}[p_partkey % 14 + 1] AS path, {str(_SCAN).lower()}[p_partkey % 14 + 1] AS scanned, {str(_TEST).lower()}[p_partkey % 14 + 1] AS test_path FROM part")
def path_filters(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", estate.pick(_PATHS, F.col("p_partkey") % 14).alias("path"))
    return p.select("p_partkey", "path", rules.should_scan(F.col("path")).alias("scanned"), rules.is_test_path(F.col("path")).alias("test_path"))


@query(
    """SELECT page_id, starts_with(lower(url), 'http://') AND NOT contains(lower(url), 'w3.org') AS cleartext,
    CASE WHEN regexp_matches(url, '^[a-z]+://') THEN regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) END AS host, CAST(CASE WHEN starts_with(url, 'https') THEN 443 ELSE 80 END AS INTEGER) AS port FROM pages"""
)
def endpoints(spark, sf):
    u = F.col("url")
    clear = F.lower(u).startswith("http://") & ~F.contains(F.lower(u), F.lit("w3.org"))
    host = F.when(u.rlike("^[a-z]+://"), F.regexp_extract(u, r"^[a-z]+://([^/:?#]+)", 1))
    return table(spark, sf, "pages").select("page_id", clear.alias("cleartext"), host.alias("host"), F.when(u.startswith("https"), 443).otherwise(80).cast("int").alias("port"))


# ------------------------------------------------------------- joins


@query(
    f"""WITH {ASSETS_SQL}, a AS (SELECT *, ['click()', 'purchase(x)', 'h = view', ''][asset_seq % 4 + 1] AS matched_code FROM assets), inf AS (SELECT event_id, 'svc' || (user_id % 40) || '/src/mod_' || (event_id % 300) || '.py' AS file_path, CAST(event_id % 500 + 1 AS INTEGER) AS inf_line, event_type FROM events)
    SELECT asset_id, event_id, event_type, inf_line FROM a LEFT JOIN inf ON a.file_path = inf.file_path AND (abs(a.line_number - inf_line) <= 5 OR contains(matched_code, event_type))
    QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY event_id NULLS LAST) = 1"""
)
def nearest_inference(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("svc"), (F.col("user_id") % 40).cast("string"), F.lit("/src/mod_"), (F.col("event_id") % 300).cast("string"), F.lit(".py")).alias("file_path"), (F.col("event_id") % 500 + 1).cast("int").alias("inf_line"), "event_type")
    a = estate.assets(spark, sf).withColumn("matched_code", estate.pick(["click()", "purchase(x)", "h = view", ""], F.col("asset_seq") % 4))
    return correlate.first_inference(a, e, "inf_line", "event_type", "event_id").select("asset_id", "event_id", "event_type", "inf_line")


@query(
    f"""WITH {ASSETS_SQL}, ent AS (SELECT n_nationkey AS ord, 'mod_' || (n_nationkey * 7) || '.' AS entity, ['ARCHIVAL', 'SHORT_TERM', 'OPERATIONAL'][n_nationkey % 3 + 1] AS tier FROM nation)
    SELECT asset_id, entity, coalesce(tier, x_tier) AS x_tier FROM assets LEFT JOIN ent ON contains(component_name, entity) OR contains(file_path, entity)
    QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ord NULLS LAST) = 1"""
)
def entity_lifespans(spark, sf):
    n = F.col("n_nationkey")
    dim = table(spark, sf, "nation").select(n.alias("ord"), F.concat(F.lit("mod_"), (n * 7).cast("string"), F.lit(".")).alias("entity"), estate.pick(["ARCHIVAL", "SHORT_TERM", "OPERATIONAL"], n % 3).alias("tier"))
    out = correlate.contained_first(estate.assets(spark, sf), dim, ["component_name", "file_path"], "entity", "asset_id", "ord")
    return out.select("asset_id", "entity", F.coalesce("tier", "x_tier").alias("x_tier"))


@query(
    f"""WITH {ASSETS_SQL}, run AS (SELECT event_id AS run_seq, ['AES-128', 'SHA-512', 'RSA-4096', 'CAMELLIA', 'MD5'][event_id % 5 + 1] AS algorithm, ['ENCRYPTION', 'HASH', 'SIGNATURE', 'ENCRYPTION', 'HASH'][event_id % 5 + 1] AS primitive_type FROM events),
    fam AS (SELECT *, CASE WHEN upper(algorithm) LIKE '%AES%' THEN 'AES' WHEN upper(algorithm) LIKE '%RSA%' THEN 'RSA' WHEN upper(algorithm) LIKE '%DES%' THEN 'DES' WHEN regexp_matches(upper(algorithm), 'SHA|MD5|DIGEST') THEN 'DIGEST' ELSE upper(algorithm) END AS k FROM assets),
    s AS (SELECT k, primitive_type AS p, arg_min(asset_id, asset_seq) AS asset_id, min(asset_seq) AS asset_seq FROM fam GROUP BY 1, 2)
    SELECT run_seq, algorithm, primitive_type, asset_id, asset_seq FROM run LEFT JOIN s ON p = primitive_type AND k = CASE algorithm WHEN 'AES-128' THEN 'AES' WHEN 'SHA-512' THEN 'DIGEST' WHEN 'RSA-4096' THEN 'RSA' WHEN 'MD5' THEN 'DIGEST' ELSE algorithm END"""
)
def runtime_correlation(spark, sf):
    at = F.col("event_id") % 5
    run = table(spark, sf, "events").select(F.col("event_id").alias("run_seq"), estate.pick(["AES-128", "SHA-512", "RSA-4096", "CAMELLIA", "MD5"], at).alias("algorithm"), estate.pick(["ENCRYPTION", "HASH", "SIGNATURE", "ENCRYPTION", "HASH"], at).alias("primitive_type"))
    return correlate.runtime_match(run, estate.assets(spark, sf))


@query(f"WITH {ASSETS_SQL} SELECT portfolio, algorithm, primitive_type, arg_min(asset_id, asset_seq) AS asset_id, min(asset_seq) AS asset_seq FROM assets GROUP BY 1, 2, 3")
def dedup_first_seen(spark, sf):
    return correlate.dedup_first(estate.assets(spark, sf).select("portfolio", "algorithm", "primitive_type", "asset_id", "asset_seq"), ["portfolio", "algorithm", "primitive_type"], "asset_seq")


@query(f"WITH {ASSETS_SQL} SELECT asset_id, file_path FROM assets a WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 2000 = a.asset_seq AND e.event_type = 'click')")
def unmatched_assets(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'click'").select((F.col("event_id") % 2000).alias("asset_seq"))
    return estate.assets(spark, sf).join(e, "asset_seq", "left_anti").select("asset_id", "file_path")


# ------------------------------------------------------------- windows and portfolios


def _items(spark, sf):
    return scoring.portfolio_items(scored(spark, sf).withColumn("r0", (F.col("asset_seq") % 8 + 1).cast("long")))


@query(f"WITH {ITEMS_SQL} SELECT asset_id, r0, delta_r, cost_dev_weeks, efficiency FROM items")
def portfolio_items(spark, sf):
    return _items(spark, sf).select("asset_id", "r0", "delta_r", "cost_dev_weeks", "efficiency")


_RUNNING = """SELECT portfolio, asset_id, CAST(row_number() OVER w AS INTEGER) AS rank, sum(CASE WHEN delta_r > 0 THEN CAST(cost_dev_weeks AS DECIMAL(18,2)) ELSE 0 END) OVER w::DOUBLE AS cumulative_weeks,
  CASE WHEN sum(CAST(delta_r AS DECIMAL(18,2))) OVER (PARTITION BY portfolio) > 0 THEN round(CAST((sum(CAST(delta_r AS DECIMAL(18,2))) OVER w)::DOUBLE / (sum(CAST(delta_r AS DECIMAL(18,2))) OVER (PARTITION BY portfolio))::DOUBLE * 100 AS DECIMAL(18,6)), 1)::DOUBLE ELSE 100.0::DOUBLE END AS cumulative_pct
  FROM items WINDOW w AS (PARTITION BY portfolio ORDER BY efficiency DESC, delta_r DESC, cost_dev_weeks, asset_seq ROWS UNBOUNDED PRECEDING)"""


@query(f"WITH {ITEMS_SQL} {_RUNNING}".replace("OVER w::DOUBLE", "OVER w"))
def running_portfolio(spark, sf):
    return portfolio.running(_items(spark, sf), "portfolio").select("portfolio", "asset_id", "rank", F.col("cumulative_weeks").cast("decimal(38,2)").alias("cumulative_weeks"), "cumulative_pct")


@query(
    f"""WITH {ITEMS_SQL}, live AS (SELECT * FROM items WHERE delta_r > 0), p AS (
    SELECT portfolio, CAST(row_number() OVER w AS INTEGER) AS point, (sum(CAST(cost_dev_weeks AS DECIMAL(18,2))) OVER w)::DOUBLE AS cost,
    least(100.0::DOUBLE, round(CAST((sum(CAST(delta_r AS DECIMAL(18,2))) OVER w)::DOUBLE / (sum(CAST(delta_r AS DECIMAL(18,2))) OVER (PARTITION BY portfolio))::DOUBLE * 100 AS DECIMAL(18,6)), 1)::DOUBLE) AS risk_pct, asset_id
    FROM live WINDOW w AS (PARTITION BY portfolio ORDER BY efficiency DESC, delta_r DESC, cost_dev_weeks, asset_seq ROWS UNBOUNDED PRECEDING))
    SELECT * FROM p UNION ALL SELECT DISTINCT portfolio, CAST(0 AS INTEGER), 0.0::DOUBLE, 0.0::DOUBLE, 'origin' FROM items"""
)
def efficient_frontier(spark, sf):
    return portfolio.frontier(_items(spark, sf), "portfolio")


_LIVE = """ranked AS (SELECT *, greatest(1, CAST(round(cost_dev_weeks * 100) AS BIGINT)) AS cents, row_number() OVER (PARTITION BY portfolio ORDER BY efficiency DESC, delta_r DESC, cost_dev_weeks, asset_seq) AS n FROM items WHERE delta_r > 0)"""


@query(
    f"""WITH RECURSIVE {ITEMS_SQL}, {_LIVE}, dp AS (
      SELECT DISTINCT portfolio, CAST(0 AS BIGINT) AS n, list_transform(range(0, {round(BUDGET * 100) + 1}), lambda c: {{'v': 0.0::DOUBLE, 'ids': ''}}) AS best FROM ranked
      UNION ALL SELECT dp.portfolio, r.n, list_transform(range(0, {round(BUDGET * 100) + 1}), lambda c: CASE WHEN c >= r.cents AND best[c - r.cents + 1].v + r.delta_r > best[c + 1].v THEN {{'v': best[c - r.cents + 1].v + r.delta_r, 'ids': best[c - r.cents + 1].ids || ',' || r.asset_id || ','}} ELSE best[c + 1] END)
      FROM dp JOIN ranked r ON r.portfolio = dp.portfolio AND r.n = dp.n + 1),
    done AS (SELECT portfolio, best[{round(BUDGET * 100) + 1}].ids AS ids FROM dp QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY n DESC) = 1)
    SELECT portfolio, asset_id, delta_r, cost_dev_weeks, coalesce(delta_r > 0 AND contains(ids, ',' || asset_id || ','), false) AS is_selected FROM items LEFT JOIN done USING (portfolio)"""
)
def optimal_portfolio(spark, sf):
    return portfolio.optimal(_items(spark, sf), "portfolio", BUDGET).select("portfolio", "asset_id", "delta_r", "cost_dev_weeks", "is_selected")


@query(
    f"""WITH RECURSIVE {ITEMS_SQL}, {_LIVE}, g AS (
      SELECT DISTINCT portfolio, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS spent, CAST([] AS VARCHAR[]) AS ids FROM items
      UNION ALL SELECT g.portfolio, r.n, CASE WHEN spent + cents <= {round(BUDGET * 100)} THEN spent + cents ELSE spent END, CASE WHEN spent + cents <= {round(BUDGET * 100)} THEN list_append(ids, asset_id) ELSE ids END FROM g JOIN ranked r ON r.portfolio = g.portfolio AND r.n = g.n + 1)
    SELECT portfolio, spent / 100 AS weeks, CAST(len(ids) AS BIGINT) AS selected, array_to_string(ids, ',') AS asset_ids FROM g QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY n DESC) = 1"""
)
def greedy_portfolio(spark, sf):
    return portfolio.greedy(_items(spark, sf), "portfolio", BUDGET)


@query("SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_purchase, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS from_end FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 25")
def tail_and_fill(spark, sf):
    w = W.partitionBy("user_id").orderBy("event_id")
    filled = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    at = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", filled.alias("last_purchase"), at.alias("from_end")).where("from_end <= 25")


# ------------------------------------------------------------- simulation


@query()
def stochastic_breach(spark, sf):
    return simulation.stochastic(scored(spark, sf)).select("asset_id", "breach", "p50", "p95", "var_year", "risk_category")


@query()
def stochastic_estate(spark, sf):
    return simulation.estate(simulation.stochastic(scored(spark, sf)))


@query("SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.05) AS p05, quantile_cont(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY 1")
def percentiles(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.percentile("l_quantity", F.lit(p)).alias(n) for p, n in ((0.5, "p50"), (0.05, "p05"), (0.95, "p95"))])


# ------------------------------------------------------------- commitment


def _leaf_rows(spark, sf):
    return commitment.leaves(scored(spark, sf).withColumn("leaf", F.col("asset_seq")), "leaf")


_LEAF = "sha256('id:' || asset_id || '|comp:' || component_name || '|path_hash:' || left(sha256(file_path), 16) || '|alg:' || upper(algorithm) || '|key_size:' || coalesce(key_size, 0) || '|primitive:' || primitive_type || '|x_tier:' || x_tier || '|risk:' || risk_level || '|y_max:' || CAST(CAST(y_max_years AS DECIMAL(18,2)) AS VARCHAR) || '|salt:INVENTORY_SALT')"


@query(f"WITH {SCORED_SQL} SELECT asset_seq AS idx, asset_id, {_LEAF} AS digest FROM scored")
def merkle_leaves(spark, sf):
    return _leaf_rows(spark, sf)


@query(
    f"""WITH RECURSIVE {SCORED_SQL}, leaves AS (SELECT asset_seq AS idx, {_LEAF} AS digest FROM scored), t AS (
      SELECT 0 AS level, list(digest ORDER BY idx) AS d FROM leaves
      UNION ALL
      SELECT level + 1, list_transform(range(1, (len(d) + 1) // 2 + 1), lambda i: sha256(unhex(d[2 * i - 1]) || unhex(coalesce(d[2 * i], d[2 * i - 1])))) FROM t WHERE len(d) > 1)
    SELECT CAST(level AS INTEGER) AS height, d[1] AS root FROM t WHERE len(d) = 1"""
)
def merkle_root(spark, sf):
    leaves = _leaf_rows(spark, sf)
    return commitment.root(leaves, leaves.count())


@query(f"WITH {ASSETS_SQL} SELECT asset_id, true AS proven, CAST(ceil(log2((SELECT count(*) FROM assets))) AS INTEGER) AS steps FROM assets")
def merkle_proofs(spark, sf):
    leaves = _leaf_rows(spark, sf)
    n = leaves.count()
    root = commitment.root(leaves, n).first()["root"]
    proven = commitment.proofs(leaves, n)
    return proven.select("asset_id", commitment.verified(F.col("digest"), F.col("path"), F.lit(root)).alias("proven"), F.size("path").alias("steps"))


# ------------------------------------------------------------- graphs


def _edges(spark, sf) -> DataFrame:
    """Region to nation to supplier, supplier to part's brand: an acyclic chain of dependencies."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = table(spark, sf, "nation").select(node("R", "n_regionkey").alias("src"), node("N", "n_nationkey").alias("dst"))
    b = table(spark, sf, "supplier").select(node("N", "s_nationkey").alias("src"), node("S", "s_suppkey").alias("dst"))
    c = table(spark, sf, "lineitem").select(node("S", "l_suppkey").alias("src"), node("P", "l_partkey").alias("dst")).distinct()
    return a.unionByName(b).unionByName(c)


_EDGES = """e AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem)"""
_CLOSURE = _EDGES + ", c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src), n AS (SELECT src AS node_id FROM e UNION SELECT dst FROM e)"


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id"))).distinct()


@query(f"WITH RECURSIVE {_CLOSURE} SELECT node_id, count(dst) AS r0 FROM n LEFT JOIN c ON c.src = node_id GROUP BY 1")
def graph_reach(spark, sf):
    e = _edges(spark, sf)
    return reach.reached(e)


@query(f"WITH RECURSIVE {_CLOSURE} SELECT node_id, count(dst) + 1 AS radius, round(CAST(100.0::DOUBLE * (count(dst) + 1) / (SELECT count(*) FROM n) AS DECIMAL(18,6)), 1)::DOUBLE AS share_pct FROM n LEFT JOIN c ON c.src = node_id GROUP BY 1")
def graph_blast(spark, sf):
    e = _edges(spark, sf)
    return graph.blast_of(reach.reached(e))


@query(f"WITH {_EDGES} SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def graph_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf))


@query(
    f"""WITH RECURSIVE {_CLOSURE}, r AS (SELECT node_id, count(dst) AS r0 FROM n LEFT JOIN c ON c.src = node_id GROUP BY 1), i AS (SELECT dst AS node_id, count(*) AS k FROM e GROUP BY 1)
    SELECT node_id, r0, coalesce(k, 0) AS providers, CASE WHEN left(node_id, 1) = 'N' AND r0 >= 2 THEN 'ANCHOR' WHEN left(node_id, 1) = 'N' THEN 'SAFE' WHEN left(node_id, 1) IN ('R', 'S') AND r0 >= 2 THEN 'SUPERSPREADER' WHEN left(node_id, 1) IN ('R', 'S') THEN 'CRYPTO' WHEN r0 > 0 THEN 'INTERMEDIARY' ELSE 'CONSUMER' END AS node_class FROM r LEFT JOIN i USING (node_id)"""
)
def graph_classes(spark, sf):
    e = _edges(spark, sf)
    n = _nodes(e)
    kinds = n.select("node_id", F.left("node_id", F.lit(1)).isin("R", "S").alias("vulnerable"), (F.left("node_id", F.lit(1)) == "N").alias("safe"))
    return graph.classes(kinds, reach.reached(e), e)


_LINEAGE = """ing AS (SELECT DISTINCT 'f' || (user_id % 50) AS f, 'in:' || event_type AS id FROM events WHERE event_type IN ('click', 'view')), nex AS (SELECT DISTINCT 'f' || (user_id % 50) AS f, 'nx:' || (user_id % 50) AS id FROM events), egr AS (SELECT DISTINCT 'f' || (user_id % 50) AS f, 'out:' || event_type AS id FROM events WHERE event_type NOT IN ('click', 'view')),
  le AS (SELECT DISTINCT i.id AS source_id, n.id AS target_id, 'FEEDS' AS edge_type FROM ing i JOIN nex n USING (f) UNION SELECT DISTINCT n.id, e.id, 'REACHES' FROM nex n JOIN egr e USING (f))"""


def _lineage(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("file_path"), "event_type", (F.col("user_id") % 50).alias("u"))
    inward = F.col("event_type").isin("click", "view")
    ingress = e.where(inward).select("file_path", F.concat(F.lit("in:"), "event_type").alias("node_id")).distinct()
    nexus = e.select("file_path", F.concat(F.lit("nx:"), F.col("u").cast("string")).alias("node_id")).distinct()
    egress = e.where(~inward).select("file_path", F.concat(F.lit("out:"), "event_type").alias("node_id")).distinct()
    return graph.flows(ingress, nexus, egress)


@query(f"WITH {_LINEAGE} SELECT source_id, target_id, edge_type FROM le")
def lineage_edges(spark, sf):
    return _lineage(spark, sf)


@query(f"WITH {_LINEAGE} SELECT source_id AS hub, count(DISTINCT target_id) AS consumers, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS spokes FROM le GROUP BY 1")
def lineage_hubs(spark, sf):
    return graph.hubs(_lineage(spark, sf))


# ------------------------------------------------------------- texts


def _files(spark, sf, body, name, keep="true"):
    return table(spark, sf, "supplier").where(keep).select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string"), F.lit("/" + name)).alias("path"), body.alias("content"))


def _key():
    return F.col("s_suppkey").cast("string")


@query(
    """WITH d AS (SELECT 'p' || s_suppkey || '/package.json' AS manifest_path, s_suppkey AS k FROM supplier)
    SELECT manifest_path, 'npm' AS ecosystem, 'elliptic' AS package, '^6.' || k AS version, 'PRODUCTION' AS scope, 'CLASSICAL_ASYMMETRIC' AS category, 'MIGRATE_TO_HYBRID' AS advice FROM d
    UNION ALL SELECT manifest_path, 'npm', 'node-forge', '2.' || k, 'PRODUCTION', 'CLASSICAL_ASYMMETRIC', 'MIGRATE_TO_HYBRID' FROM d UNION ALL SELECT manifest_path, 'npm', '@types/bcrypt', '5', 'TEST_FIXTURE', 'SYMMETRIC_OR_HASH', 'MAINTAIN' FROM d"""
)
def npm_dependencies(spark, sf):
    body = F.concat(F.lit('{"dependencies":{"elliptic":"^6.'), _key(), F.lit('","node-forge":"1.0","left-pad":"1"},"devDependencies":{"node-forge":"2.'), _key(), F.lit('","@types/bcrypt":"5"}}'))
    known = texts.with_rules(texts.npm(_files(spark, sf, body, "package.json")))
    return known.select("manifest_path", "ecosystem", "package", "version", "scope", "category", texts.advice(F.col("category"), F.col("readiness")).alias("advice"))


@query(
    """WITH d AS (SELECT s_suppkey AS k FROM supplier) SELECT 'p' || k || '/Cargo.toml' AS manifest_path, 'cargo' AS ecosystem, 'sha2' AS package, '0.10.' || k AS version, 'PRODUCTION' AS scope FROM d
    UNION ALL SELECT 'p' || k || '/Cargo.toml', 'cargo', 'aes', '0.8', 'TEST_FIXTURE' FROM d UNION ALL SELECT 'p' || k || '/go.mod', 'go', 'golang.org/x/crypto', 'v0.' || k, 'PRODUCTION' FROM d
    UNION ALL SELECT 'p' || k || '/requirements.txt', 'pypi', 'cryptography', '4.' || k, 'PRODUCTION' FROM d UNION ALL SELECT 'p' || k || '/requirements.txt', 'pypi', 'oqs', 'latest', 'PRODUCTION' FROM d
    UNION ALL SELECT 'p' || k || '/pom.xml', 'maven', 'org.jasypt:jasypt', '1.' || k, 'TEST_FIXTURE' FROM d"""
)
def line_manifests(spark, sf):
    k = _key()
    cargo = texts.cargo(_files(spark, sf, F.concat(F.lit('[package]\nname = "x"\n[dependencies]\nsha2 = "0.10.'), k, F.lit('"\nserde = "1"\n[dev-dependencies]\naes = { version = "0.8", features = [] }\n')), "Cargo.toml"))
    go = texts.go_mod(_files(spark, sf, F.concat(F.lit("module x\n\ngo 1.22\nrequire (\n\tgolang.org/x/crypto v0."), k, F.lit("\n\tgithub.com/pkg/errors v1\n)\n")), "go.mod"))
    req = texts.requirements(_files(spark, sf, F.concat(F.lit("# deps\ncryptography>=4."), k, F.lit(" ; python_version > '3'\noqs\nrequests==2 # no\n")), "requirements.txt"))
    pom = texts.maven(_files(spark, sf, F.concat(F.lit("<project><properties><j.v>1."), k, F.lit("</j.v></properties><dependencies><dependency><groupId>org.jasypt</groupId><artifactId>jasypt</artifactId><version>${j.v}</version><scope>test</scope></dependency></dependencies></project>")), "pom.xml"))
    return texts.with_rules(cargo.unionByName(go).unionByName(req).unionByName(pom)).select("manifest_path", "ecosystem", "package", "version", "scope")


@query(
    """WITH d AS (SELECT 'p' || s_suppkey || '/site.conf' AS path FROM supplier), v(line_no, directive, algorithm, key_size, risk_level) AS (VALUES (3, 'ssl_protocols', 'TLSV1', NULL, 'HIGH'), (3, 'ssl_protocols', 'TLSV1.3', NULL, 'LOW'), (3, 'ssl_protocols', 'SSLV3', NULL, 'CRITICAL'),
    (4, 'ssl_ciphers', 'AES256-GCM', 256, 'LOW'), (4, 'ssl_ciphers', 'DES-CBC3-SHA', NULL, 'CRITICAL'), (4, 'ssl_ciphers', 'EXPORT40', NULL, 'HIGH'), (6, 'ssl_ecdh_curve', 'X25519', 256, 'HIGH'))
    SELECT path, CAST(line_no AS INTEGER) AS line_no, directive, algorithm, CAST(key_size AS INTEGER) AS key_size, risk_level FROM d, v"""
)
def tls_directives(spark, sf):
    body = F.lit("server {\n  listen 443;\n  ssl_protocols TLSv1 TLSv1.3 SSLv3;\n  ssl_ciphers 'AES256-GCM:!aNULL:DES-CBC3-SHA:EXPORT40';\n\n  ssl_ecdh_curve X25519;\n}\n")
    return texts.tls_directives(_files(spark, sf, body, "site.conf"))


@query(
    """WITH d AS (SELECT 'p' || s_suppkey || '/schema.sql' AS path FROM supplier), m AS (SELECT 'p' || s_suppkey || '/schema.prisma' AS path FROM supplier)
    SELECT path, entity, x_tier, years::DOUBLE AS years, reason FROM d, (VALUES ('orders', 'OPERATIONAL', 7.0, 'retention'), ('logins', 'SHORT_TERM', 1.0, 'expiry'), ('patient_files', 'ARCHIVAL', 10.0, 'archival'), ('otp_codes', 'SHORT_TERM', 1.0, 'short_lived'), ('kept_days', 'EPHEMERAL', 0.08, 'retention')) v(entity, x_tier, years, reason)
    UNION ALL SELECT path, entity, x_tier, years::DOUBLE, reason FROM m, (VALUES ('ballot', 'ARCHIVAL', 10.0, 'archival'), ('invoice', 'SHORT_TERM', 1.5, 'retention')) v(entity, x_tier, years, reason)"""
)
def schema_lifespans(spark, sf):
    ddl = F.lit(
        "CREATE TABLE orders (id INT); -- retention: 7 years\nCREATE TABLE IF NOT EXISTS `logins` (id INT,\n expires_at TIMESTAMP);\nCREATE TABLE patient_files (id INT);\nCREATE TABLE otp_codes (c INT);\nCREATE TABLE misc (c INT);\nCREATE TABLE kept_days (\n a INT -- retention: 30 days\n);\n"
    )
    models = F.lit("model Ballot { id Int }\nmodel Invoice {\n // retention: 18 months\n id Int\n}\nmodel Plain { id Int }\n")
    return texts.ddl_lifespans(_files(spark, sf, ddl, "schema.sql")).unionByName(texts.model_lifespans(_files(spark, sf, models, "schema.prisma")))


@query(
    """WITH d AS (SELECT 'p' || s_suppkey || '/k8s.yaml' AS path FROM supplier) SELECT path, CAST(ord AS INTEGER) AS ord, service, exposure_profile, p_hndl::DOUBLE AS p_hndl FROM d, (VALUES (1, 'web', 'PUBLIC', 1.0), (2, 'db', 'INTERNAL', 0.05), (3, 'api', 'PUBLIC', 1.0)) v(ord, service, exposure_profile, p_hndl)
    UNION ALL SELECT replace(path, 'k8s', 'compose'), CAST(ord AS INTEGER), service, exposure_profile, p_hndl::DOUBLE FROM d, (VALUES (1, 'front', 'PUBLIC', 1.0), (2, 'admin', 'INTERNAL', 0.2), (3, 'cache', 'INTERNAL', 0.01)) v(ord, service, exposure_profile, p_hndl)"""
)
def service_exposures(spark, sf):
    k8s = F.lit("kind: Service\nmetadata: {name: Web}\nspec: {type: LoadBalancer}\n---\nkind: Service\nmetadata: {name: db}\nspec: {}\n---\nkind: Ingress\nspec:\n  rules:\n  - http: {paths: [{backend: {service: {name: api}}}]}\n")
    compose = F.lit("services:\n  front:\n    ports: ['80:80']\n  admin:\n    ports: ['127.0.0.1:90:90']\n  cache: {image: x}\n")
    return texts.exposures(_files(spark, sf, k8s, "k8s.yaml").unionByName(_files(spark, sf, compose, "compose.yaml")))


def _trace_lines(spark, sf):
    e = table(spark, sf, "events")
    at = F.col("event_id") % 4
    line = F.concat(estate.pick(["EVP_ENCRYPT_INIT: ", "EVP_DIGEST_INIT: ", "SSL_CIPHER_LIST: ", "OTHER: "], at), F.lit("pid="), F.col("user_id").cast("string"), F.lit(" comm="), "event_type", estate.pick([" cipher=aes-256-gcm", "", " str=ECDHE-RSA:AES", " x=1"], at))
    return e.select("event_id", line.alias("value"))


@query(
    """SELECT event_id, ['encrypt', 'digest', 'ssl'][event_id % 4 + 1] AS event, ['AES-256-GCM', 'OPENSSL-EVP-DIGEST', 'ECDHE-RSA'][event_id % 4 + 1] AS algorithm, CAST(user_id AS VARCHAR) AS pid, event_type AS comm,
    CAST(CASE WHEN event_id % 4 = 0 THEN 256 END AS INTEGER) AS key_size, ['ENCRYPTION', 'HASH', 'KEY_EXCHANGE'][event_id % 4 + 1] AS primitive_type FROM events WHERE event_id % 4 < 3"""
)
def trace_events(spark, sf):
    return texts.trace_events(_trace_lines(spark, sf)).select("event_id", "event", "algorithm", "pid", "comm", "key_size", "primitive_type")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def property_histogram(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query(
    "SELECT suite, m.mss, CAST(ceil(flight / m.mss::DOUBLE) AS BIGINT) AS segments, flight <= m.mss AS fits FROM (VALUES "
    + ", ".join(f"('{k}', {v})" for k, v in fixed.FLIGHT_BYTES.items())
    + ") s(suite, flight), (SELECT DISTINCT CAST(p_size * 40 + 500 AS BIGINT) AS mss FROM part) m"
)
def flight_segments(spark, sf):
    suites = spark.createDataFrame(list(fixed.FLIGHT_BYTES.items()), "suite string, flight long")  # 8 fixed rows
    mss = table(spark, sf, "part").select((F.col("p_size") * 40 + 500).cast("long").alias("mss")).distinct()
    return mss.join(F.broadcast(suites), F.lit(True)).select("suite", "mss", F.ceil(F.col("flight") / F.col("mss")).cast("long").alias("segments"), (F.col("flight") <= F.col("mss")).alias("fits"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(regexp_replace(upper(c_mktsegment), '[_/ .:]+', '-', 'g'), '^-|-$', '', 'g') AS key FROM customer")
def name_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", rules.slug(F.col("c_name")).alias("slug"), rules.normal_key(F.col("c_mktsegment")).alias("key"))
