"""Reach without pairs on cycles and layers, and running totals of one huge group, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from vaultgrid.operators import graph, portfolio, reach, running


def brute(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    got = {}
    for n in out:
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        got[n] = len(seen - {n})
    return got


def tangle(seed, nodes, links):
    draw = random.Random(seed)
    return [(f"n{draw.randrange(nodes)}", f"n{draw.randrange(nodes)}") for _ in range(links)]


LAYERS = [(f"{k}:{i}", f"{k + 1}:{j}") for k in range(4) for i in range(12) for j in range(i, 12, 1 + i % 3)]
RING = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("e", "f"), ("y", "y")]


@pytest.mark.parametrize("edges", [LAYERS, RING, LAYERS + [("4:3", "1:2"), ("2:5", "2:6"), ("2:6", "2:5")], tangle(0, 60, 70), tangle(1, 40, 120), [(f"h{k // 100}", f"t{k}") for k in range(300)] + [("r", "h0"), ("r", "h1")], []])
def test_reached(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    assert {r["node_id"]: r["r0"] for r in reach.reached(df).collect()} == brute(edges)


def test_masks_hold_blocks_not_pairs(spark, monkeypatch):
    """A tree whose 2,000 leaves all have five ancestors: 10,000 pairs in some hundreds of masks."""
    edges = [("r0", "r1"), ("r1", "r2"), ("r2", "r3")] + [("r3", f"m{i}") for i in range(4)] + [(f"m{i % 4}", f"leaf{i:04}") for i in range(2000)]
    rows = []
    write = reach.Steps.write

    def counted(self, df, name=None):
        out = write(self, df, name)
        if name and name.startswith("masks"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(reach.Steps, "write", counted)
    got = {r["node_id"]: r["r0"] for r in reach.reached(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == brute(edges)
    assert sum(rows) < 500


def test_running_totals_of_one_group(spark):
    """One portfolio with all rows, one with a single row, one without a name: spread over partitions, totals as by a plain loop."""
    draw = random.Random(2)
    rows = [(p, f"a{i}", i, round(draw.choice([0.0, 0.0, 1.25, 3.1, 7.0]), 2), round(draw.random() * 9 + 1, 2), 0.0) for i, p in enumerate(["p"] * 3000 + ["q"] + [None] * 5)]
    rows = [(*r[:5], round(r[3] / r[4], 4)) for r in rows]
    df = spark.createDataFrame(rows, "portfolio string, asset_id string, asset_seq long, delta_r double, cost_dev_weeks double, efficiency double").repartition(8)
    got = {r["asset_seq"]: (r["rank"], round(r["cumulative_weeks"], 2), r["cumulative_pct"]) for r in portfolio.running(df, "portfolio").collect()}
    want = {}
    for p in ("p", "q", None):
        own = sorted((r for r in rows if r[0] == p), key=lambda r: (-r[5], -r[3], r[4], r[2]))
        total, weeks, gain = sum(round(r[3] * 100) for r in own), 0, 0
        for k, r in enumerate(own):
            gain += round(r[3] * 100)
            weeks += round(r[4] * 100) if r[3] > 0 else 0
            want[r[2]] = (k + 1, weeks / 100, pytest.approx(100 * gain / total if total else 100, abs=0.0501))
    assert got == want


def test_no_partition_holds_a_large_group(spark):
    df = spark.range(4000).select(F.lit("p").alias("g"), F.col("id"), F.lit(1).cast("long").alias("v"))
    plan = running.totals(df, "g", [F.col("id")], {"v": F.col("v")})
    assert {(r["rank"], r["so_far_v"], r["all_v"]) for r in plan.collect()} == {(i + 1, i + 1, 4000) for i in range(4000)}


def test_first_inference_of_a_large_file(spark):
    """One file with thousands of assets and inferences: the first by line or by name, as a plain loop finds it, also for names inside others and without letters."""
    from vaultgrid.operators import correlate

    draw = random.Random(4)
    names = ["key", "a", "ke", "keyring", "ü", "", None, "k e"]
    codes = ["keyring()", "x = ke", "", None, "K E", "k ey", "ü", "no"]
    assets = [(f"a{i}", "f" if i % 10 else "g", draw.randrange(20000), codes[i % len(codes)]) for i in range(800)]
    inferences = [("f" if i % 9 else "h", i, draw.randrange(20000), names[draw.randrange(len(names))] if i % 3 else "zz") for i in range(1500)]
    got = correlate.first_inference(spark.createDataFrame(assets, "asset_id string, file_path string, line_number int, matched_code string"), spark.createDataFrame(inferences, "file_path string, ord int, line int, name string"), "line", "name", "ord")
    want = {}
    for a, f, at, code in assets:
        hit = [(o, line, n) for g, o, line, n in inferences if g == f and (abs(line - at) <= 5 or (n and code and n in code))]
        want[a] = min(hit, key=lambda x: x[0])[:2] if hit else (None, None)
    assert {r["asset_id"]: (r["ord"], r["line"]) for r in got.collect()} == want


def joined_rows(df):
    """The most rows that a join of the plan made; its result has to be collected before."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_an_asset_meets_one_node_of_a_name(spark):
    assets = spark.range(400).selectExpr("concat('A', id) AS asset_id", "'c' AS component_name", "'s/m.py' AS file_path")
    nodes = spark.range(300).selectExpr("300 - id AS ord", "if(id % 2 = 0, 'm', 'other') AS node_id", "if(id % 3 = 0, 's/m.py', NULL) AS file_path", "id AS r0")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = graph.resolved_r0(assets, nodes)
        assert {(r["asset_id"], r["r0"]) for r in df.collect()} == {(f"A{i}", 298) for i in range(400)}
        assert joined_rows(df) <= 3 * 400
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
