"""Golden values and small cases of the estate operators."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from vaultgrid.functions import rules
from vaultgrid.operators import commitment, correlate, graph, portfolio, posture, scoring, simulation


def asset(spark, **given):
    row = {
        "asset_id": "A", "asset_seq": 1, "algorithm": "RSA-2048", "key_size": 2048, "primitive_type": "KEY_EXCHANGE", "x_tier": "OPERATIONAL", "has_crypto_shredding": False,
        "intent_class": "CONFIDENTIALITY_ENVELOPE", "agility_level": 0, "p_hndl": 1.0,
    } | given
    return spark.createDataFrame([tuple(row.values())], "asset_id string, asset_seq long, algorithm string, key_size int, primitive_type string, x_tier string, has_crypto_shredding boolean, intent_class string, agility_level int, p_hndl double")


def score(spark, **given):
    return scoring.scored(asset(spark, **given)).first()


def test_deadlines_by_role(spark):
    assert score(spark)["z_regulatory_year"] == 2030
    assert score(spark, primitive_type="SIGNATURE")["z_regulatory_year"] == 2031
    assert score(spark, algorithm="AES-256-GCM", key_size=256, primitive_type="ENCRYPTION")["z_regulatory_year"] == 2050


def test_runway_and_levers(spark):
    assert score(spark, x_tier="ARCHIVAL")["y_max_years"] == -6.0
    assert score(spark, x_tier="ARCHIVAL")["risk_level"] == "CRITICAL"
    shredded = score(spark, x_tier="ARCHIVAL", has_crypto_shredding=True)
    assert (shredded["x_years_effective"], shredded["y_max_years"], shredded["risk_level"]) == (1.5, 2.5, "HIGH")
    review = score(spark, x_tier="HUMAN_REVIEW", has_crypto_shredding=True)
    assert (review["z_regulatory_year"], review["y_max_years"], review["risk_level"]) == (2030, 2.5, "MANUAL_REVIEW_REQUIRED")
    broken = score(spark, algorithm="RSA-1024", key_size=1024, x_tier="EPHEMERAL")
    assert (broken["z_regulatory_year"], broken["y_max_years"], broken["risk_level"]) == (2026, 0.0, "CRITICAL")


def test_suppression_and_opaque(spark):
    assert score(spark, intent_class="OPERATIONAL_UTILITY")["r_q_score"] == 0.0
    assert score(spark, p_hndl=0.0)["risk_level"] == "LOW"
    assert score(spark, algorithm="IDEA", key_size=None, primitive_type="ENCRYPTION")["risk_level"] == "CRITICAL"


def test_override_lifts_review_by_tier(spark):
    df = asset(spark, x_tier="HUMAN_REVIEW").withColumn("years", F.lit(0.5))
    got = scoring.scored(df, override_years="years").first()
    assert (got["risk_level"], got["z_regulatory_year"], got["x_years_effective"]) == ("MEDIUM", 2030, 0.5)


def test_simulation_golden(spark):
    rows = [(10.0, 2.0, 2030.0, 1.0, (0.898, -4.95, -9.45, 2040)), (5.0, 2.0, 2031.0, 1.0, (0.446, 0.47, -3.29, 2034)), (1.5, 2.0, 2030.0, 1.0, (0.041, 3.65, 0.08, 2030)), (0.1, 2.0, 2026.0, 1.0, (0.083, 3.70, -0.26, 2029))]
    for x, y, z, p, want in rows:
        assert simulation.simulate(x, y, z, p, 5000, 42, 2026) == want


def test_knapsack_beats_greedy_trap(spark):
    items = spark.createDataFrame([("p", "trap", 1, 10.0, 4.0, 2.5), ("p", "opt1", 2, 7.0, 3.0, 2.333), ("p", "opt2", 3, 7.0, 3.0, 2.333)], "portfolio string, asset_id string, asset_seq long, delta_r double, cost_dev_weeks double, efficiency double")
    best = portfolio.optimal(items, "portfolio", 6.0)
    assert {r["asset_id"] for r in best.where("is_selected").collect()} == {"opt1", "opt2"}
    assert portfolio.greedy(items, "portfolio", 6.0).first()["asset_ids"] == "trap"


def test_reach_of_dag_and_cycle(spark):
    edges = [("common", "auth"), ("common", "pay"), ("auth", "gate"), ("pay", "gate"), ("pay", "report")]
    nodes = spark.createDataFrame([(n,) for n in ("common", "auth", "pay", "gate", "report", "alone")], "node_id string")
    closure = graph.reach(spark.createDataFrame(edges, "src string, dst string"))
    r0 = {r["node_id"]: r["r0"] for r in graph.reach_counts(nodes, closure).collect()}
    assert r0 == {"common": 4, "auth": 1, "pay": 2, "gate": 0, "report": 0, "alone": 0}
    ring = graph.reach(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")], "src string, dst string"))
    assert {(r["src"], r["dst"]) for r in ring.collect()} == set(itertools.permutations("abc", 2))
    kinds = nodes.withColumn("vulnerable", F.col("node_id") == "common").withColumn("safe", F.lit(False))
    got = {r["node_id"]: r["node_class"] for r in graph.classes(kinds, graph.reach_counts(nodes, closure), spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got["common"] == "SUPERSPREADER" and got["pay"] == "INTERMEDIARY" and got["alone"] == "CONSUMER"


@pytest.mark.parametrize("fold", [2, 10])
def test_merkle_of_odd_sizes(spark, monkeypatch, fold):
    monkeypatch.setattr(commitment, "FOLD", fold)
    for n in (1, 2, 5, 7, 17, 21):
        digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        level = digests
        while len(level) > 1:
            level = [hashlib.sha256(bytes.fromhex(a) + bytes.fromhex(b)).hexdigest() for a, b in zip(level[::2], level[1::2] + level[-1:] * (len(level) % 2))]
        leaves = spark.createDataFrame([(i, str(i), d) for i, d in enumerate(digests)], "idx long, asset_id string, digest string")
        got = commitment.root(leaves, n).first()
        assert (got["height"], got["root"]) == ((n - 1).bit_length(), level[0])
        ok = commitment.proofs(leaves, n).select(commitment.verified(F.col("digest"), F.col("path"), F.lit(level[0])).alias("ok"), commitment.verified(F.sha2("digest", 256), F.col("path"), F.lit(level[0])).alias("bad")).collect()
        assert all(r["ok"] and not r["bad"] for r in ok) and len(ok) == n
    assert commitment.root(leaves, 0).first()["root"] == "0" * 64


def test_band_join_first_match(spark):
    a = spark.createDataFrame([("x", "f", 10), ("y", "f", 100), ("z", "g", 1)], "asset_id string, file_path string, line int")
    b = spark.createDataFrame([("f", 14, 2), ("f", 6, 1), ("f", 16, 0)], "file_path string, at int, ord int")
    got = {r["asset_id"]: r["ord"] for r in correlate.band_join(a, b, "file_path", "line", "at", 5, "asset_id", ["ord"]).collect()}
    assert got == {"x": 1, "y": None, "z": None}


def test_longest_contained(spark):
    a = spark.createDataFrame([(1, "aes"), (2, "my-aes-gcm"), (3, "none")], "id int, package string")
    d = spark.createDataFrame([("aes",), ("aes-gcm",)], "word string")
    got = {r["id"]: r["word"] for r in correlate.longest_contained(a, d, "package", "word", "id").collect()}
    assert got == {1: "aes", 2: "aes-gcm", 3: None}


def test_intent_and_agility(spark):
    row = spark.range(1).select(
        rules.intent_of(F.lit("x"), F.lit("cache.set(k)"), F.lit(""), F.lit("HASH")).alias("a"), rules.intent_of(F.lit("jwt_key"), F.lit(None).cast("string"), F.lit(""), F.lit("HASH")).alias("b"),
        rules.intent_of(F.lit("x"), F.lit(""), F.lit("db.query"), F.lit("HASH")).alias("c"), rules.agility_of(F.lit("tinkConfig.x"), F.lit(None).cast("string"), F.lit("AES")).alias("d"), rules.agility_of(F.lit("os.environ['A']"), F.lit(""), F.lit("AES")).alias("e"),
    ).first()
    assert tuple(row) == ("OPERATIONAL_UTILITY", "AUTHENTICATION_SIGNATURE", "CONFIDENTIALITY_ENVELOPE", 3, 1)


def test_empty_estate(spark):
    none = scoring.scored(asset(spark).where("false"))
    assert posture.risk_counts(none).count() == 0
    assert posture.gate(none).first()["passed"] is True
    assert {r["assets"] for r in posture.distribution(none, "risk_level", ["LOW", "HIGH"]).collect()} == {0}
