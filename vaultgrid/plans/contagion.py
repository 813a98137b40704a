"""Portfolios whose reach comes from the dependency network, registered by import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, portfolio, reach, scoring
from .catalog import _LIVE, BUDGET, query, scored
from .estate import ITEMS_SQL, SCORED_SQL, table

# a part spreads to its suppliers, these to their nations and regions; an asset stands for the first part whose file it is in
_SPREAD = """, e AS (SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
  c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src), n AS (SELECT src AS node_id, count(DISTINCT dst) AS r FROM c GROUP BY 1),
  far AS (SELECT file_path, arg_min(coalesce(r, 0), asset_seq) AS r FROM scored LEFT JOIN n ON node_id = 'P' || asset_seq GROUP BY 1)"""
_REACH_ITEMS = "RECURSIVE " + SCORED_SQL + _SPREAD + ITEMS_SQL[len(SCORED_SQL) :].replace("CAST(asset_seq % 8 + 1 AS BIGINT) AS r0", "CAST(greatest(1, (SELECT r FROM far WHERE far.file_path = scored.file_path)) AS BIGINT) AS r0")


def _items(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "lineitem").select(name("P", "l_partkey").alias("src"), name("S", "l_suppkey").alias("dst")).distinct()
    edges = edges.unionByName(table(spark, sf, "supplier").select(name("S", "s_suppkey").alias("src"), name("N", "s_nationkey").alias("dst")))
    edges = edges.unionByName(table(spark, sf, "nation").select(name("N", "n_nationkey").alias("src"), name("R", "n_regionkey").alias("dst")))
    scores = scored(spark, sf)
    nodes = scores.select(F.col("asset_seq").alias("ord"), name("P", "asset_seq").alias("node_id"), "file_path").join(reach.reached(edges), "node_id", "left").na.fill(0, ["r0"])
    return scoring.portfolio_items(graph.resolved_r0(scores, nodes))


@query(f"WITH {_REACH_ITEMS} SELECT asset_id, r0, delta_r, cost_dev_weeks, efficiency FROM items")
def reach_items(spark, sf):
    """Gain and cost of assets by what their nodes reach in the network."""
    return _items(spark, sf).select("asset_id", "r0", "delta_r", "cost_dev_weeks", "efficiency")


@query(
    f"""WITH {_REACH_ITEMS}, {_LIVE}, g AS (
      SELECT DISTINCT portfolio, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS spent, CAST([] AS VARCHAR[]) AS ids FROM items
      UNION ALL SELECT g.portfolio, r.n, CASE WHEN spent + cents <= {round(BUDGET * 100)} THEN spent + cents ELSE spent END, CASE WHEN spent + cents <= {round(BUDGET * 100)} THEN list_append(ids, asset_id) ELSE ids END FROM g JOIN ranked r ON r.portfolio = g.portfolio AND r.n = g.n + 1)
    SELECT portfolio, spent / 100 AS weeks, CAST(len(ids) AS BIGINT) AS selected, array_to_string(ids, ',') AS asset_ids FROM g QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY n DESC) = 1"""
)
def reach_portfolio(spark, sf):
    return portfolio.greedy(_items(spark, sf), "portfolio", BUDGET)


@query(
    f"""WITH {_REACH_ITEMS}, {_LIVE}, dp AS (
      SELECT DISTINCT portfolio, CAST(0 AS BIGINT) AS n, list_transform(range(0, {round(BUDGET * 100) + 1}), lambda c: {{'v': 0.0::DOUBLE, 'ids': ''}}) AS best FROM ranked
      UNION ALL SELECT dp.portfolio, r.n, list_transform(range(0, {round(BUDGET * 100) + 1}), lambda c: CASE WHEN c >= r.cents AND best[c - r.cents + 1].v + r.delta_r > best[c + 1].v THEN {{'v': best[c - r.cents + 1].v + r.delta_r, 'ids': best[c - r.cents + 1].ids || ',' || r.asset_id || ','}} ELSE best[c + 1] END)
      FROM dp JOIN ranked r ON r.portfolio = dp.portfolio AND r.n = dp.n + 1),
    done AS (SELECT portfolio, best[{round(BUDGET * 100) + 1}].ids AS ids FROM dp QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY n DESC) = 1),
    s AS (SELECT *, coalesce(delta_r > 0 AND contains(ids, ',' || asset_id || ','), false) AS taken FROM items LEFT JOIN done USING (portfolio))
    SELECT portfolio, count(*) AS items, count(*) FILTER (taken) AS selected, coalesce(sum(CAST(delta_r AS DECIMAL(18,2))) FILTER (taken), 0)::DOUBLE AS gained, sum(CAST(delta_r AS DECIMAL(18,2)))::DOUBLE AS total, coalesce(sum(CAST(cost_dev_weeks AS DECIMAL(18,2))) FILTER (taken), 0)::DOUBLE AS weeks FROM s GROUP BY 1"""
)
def reach_portfolio_totals(spark, sf):
    """What the exact choice gains of each portfolio's whole risk, and what it costs."""
    items = portfolio.optimal(_items(spark, sf), "portfolio", BUDGET)
    cents = lambda c: F.col(c).cast("decimal(18,2)")
    taken = lambda c: F.coalesce(F.sum(F.when(F.col("is_selected"), cents(c))), F.lit(0)).cast("double")
    return items.groupBy("portfolio").agg(F.count("*").alias("items"), F.count_if("is_selected").alias("selected"), taken("delta_r").alias("gained"), F.sum(cents("delta_r")).cast("double").alias("total"), taken("cost_dev_weeks").alias("weeks"))
