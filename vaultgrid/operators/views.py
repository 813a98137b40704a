"""Filters, sorts and figures of the estate's views: each one filter or one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A filter that lets everything through.
ALL = "ALL"


def search(query: str, columns: list[str]) -> Column:
    """Whether any column holds the query, in any case; an empty query finds everything, a null column nothing."""
    if not query:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False)) for c in columns])


def chosen(column: str, value: str) -> Column:
    return F.lit(True) if value == ALL else F.coalesce(F.col(column) == value, F.lit(False))


INVENTORY_COLUMNS = ["asset_id", "component_name", "algorithm", "primitive_type", "scope", "cwe_id", "cwe_name", "target", "file_path"]


def inventory(assets: DataFrame, category: str = ALL, scope: str = ALL, cwe: str = ALL, query: str = "") -> DataFrame:
    """Assets by category, scope, weakness (NONE: those without) and a search over nine columns."""
    weak = F.coalesce("cwe_id", F.lit("")) == "" if cwe == "NONE" else chosen("cwe_id", cwe)
    return assets.where(chosen("category", category) & chosen("scope", scope) & weak & search(query, INVENTORY_COLUMNS))


def dependencies(rows: DataFrame, status: str = ALL, scope: str = ALL, cve: str = ALL, query: str = "") -> DataFrame:
    flawed = F.coalesce("cve_id", F.lit("")) != ""
    by_cve = flawed if cve == "VULNERABLE" else ~flawed if cve == "CLEAN" else F.lit(True)
    return rows.where(chosen("status", status) & chosen("scope", scope) & by_cve & search(query, ["package", "ecosystem", "manifest_path", "cve_id"]))


def unknowns(rows: DataFrame, category: str = ALL, query: str = "") -> DataFrame:
    return rows.where(chosen("category", category) & search(query, ["id", "item_path", "category", "reason"]))


def simulated(rows: DataFrame, risk: str = ALL, query: str = "") -> DataFrame:
    """LOW also stands for PQC and SAFE."""
    by_risk = F.col("risk_category").isin("LOW", "PQC", "SAFE") if risk == "LOW" else chosen("risk_category", risk)
    return rows.where(F.coalesce(by_risk, F.lit(False)) & search(query, ["asset_id", "algorithm", "component_name", "file_path"]))


def nodes(rows: DataFrame, kind: str = ALL, query: str = "") -> DataFrame:
    """Graph nodes (superspreader, has_crypto, anchor): superspreaders, other nodes with cryptography, or anchors."""
    by_kind = {"SUPERSPREADER": F.col("superspreader"), "HIGH": F.col("has_crypto") & ~F.col("superspreader"), "PQC": F.col("anchor")}.get(kind, F.lit(True))
    return rows.where(by_kind & search(query, ["label", "node_id", "file_path"]))


def lineage(hubs: DataFrame, edges: DataFrame, spokes: DataFrame, source_type: str = ALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hubs of a source type, the edges from them, and the spokes that those reach."""
    if source_type == ALL:
        return hubs, edges, spokes
    hubs = hubs.where(F.col("source_type") == source_type)
    edges = edges.join(hubs.select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    return hubs, edges, spokes.join(edges.select(F.col("target_id").alias("node_id")), "node_id", "left_semi")


# --- fixed values: names that rewriting leaves alone, and names that it knows how to replace
LEFT_ALONE = ["ML-DSA", "ML-KEM", "DILITHIUM", "KYBER", "LWE", "RISTRETTO", "PEDERSEN", "JWT-HMAC", "HMAC-SHA256"]
REPLACEABLE = ["ECDSA", "RSA", "MD5", "SHA1", "DES", "CBC", "DH"]


def remediable(category: Column, algorithm: Column) -> Column:
    a = F.upper(F.coalesce(algorithm, F.lit("")))
    any_of = lambda words: reduce(lambda x, y: x | y, [F.contains(a, F.lit(w)) for w in words])
    return F.coalesce(category != "PQC", F.lit(True)) & ~any_of(LEFT_ALONE) & ~a.isin("AES-256-GCM", "AES-256") & any_of(REPLACEABLE)


# --- fixed values: findings that a change of text alone cannot mend
SEMANTIC = ["RSA", "ECDSA", "ECDH", "ED25519", "ASYMMETRIC", "UNTRUSTED-PRNG", "CLEARTEXT-HTTP", "IMPROPER-SSL", "DUMMY-CERT", "DUMMY-HOSTNAME", "DYNAMIC_UNRESOLVED", "SECURE-PRNG"]


def needs_design(algorithm: Column) -> Column:
    """Whether a finding needs a change of keys, interfaces or protocols, so that no rewriting takes it."""
    return reduce(lambda x, y: x | y, [F.contains(F.upper(F.coalesce(algorithm, F.lit(""))), F.lit(w)) for w in SEMANTIC])


def ranked_nodes(nodes: DataFrame, limit: int) -> DataFrame:
    """The nodes of the largest blast radius, then of the largest reach."""
    keys = [F.desc("share_pct"), F.desc("r0"), F.col("node_id")]
    return nodes.orderBy(*keys).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*keys)))


def in_folders(path: Column, folders: list[str]) -> Column:
    """Whether a part of the path is one of the folders; without folders every path is in."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(f) for f in folders])) if folders else F.lit(True)


def risk_order(level: Column) -> Column:
    return F.when(level == "CRITICAL", 0).when(level == "HIGH", 1).when(level == "MEDIUM", 2).when(level == "LOW", 3).otherwise(99)


def pinned_first(rows: DataFrame, name: str, pinned: str) -> list[Column]:
    """Sort keys: names that start with ``pinned`` first, then by name in any case."""
    return [F.when(F.col(name).startswith(pinned), 0).otherwise(1), F.lower(name), F.col(name)]


def capped_readiness(assets: DataFrame) -> DataFrame:
    """One row: share migrated, and a score of production assets (of all, if none) that critical and high ones cap.

    ``category`` is PQC, CLASSICAL or DEPRECATED.
    """
    prod = F.col("scope") == "PRODUCTION"
    is_ = lambda c, v: F.col(c) == v
    conditions = {"critical": is_("risk_level", "CRITICAL"), "high": is_("risk_level", "HIGH"), "pqc": is_("category", "PQC"), "deprecated": is_("category", "DEPRECATED"), "classical": is_("category", "CLASSICAL")}
    counted = assets.agg(F.count("*").alias("all_n"), F.count_if(prod).alias("prod_n"), *[F.count_if(c).alias(f"all_{k}") for k, c in conditions.items()], *[F.count_if(c & prod).alias(f"prod_{k}") for k, c in conditions.items()])
    of = lambda k: F.when(F.col("prod_n") > 0, F.col(f"prod_{k}")).otherwise(F.col(f"all_{k}"))
    row = counted.select(*[of(k).alias(k) for k in ("n", *conditions)])
    n = F.col("n").cast("double")
    healthy = F.col("pqc") + F.greatest(F.lit(0), F.col("classical") - F.col("critical") - F.col("high"))
    raw = F.greatest(F.lit(5.0), F.least(F.lit(100.0), healthy / n * 100.0 - (F.col("critical") * 35.0 + F.col("high") * 15.0 + F.col("deprecated") * 20.0) / n)).cast("int")
    cap = F.greatest(F.lit(8.0), F.least(F.lit(55.0), 60.0 - F.col("critical") / n * 50.0)).cast("int")
    score = F.when(F.col("n") == 0, 100).when(F.col("critical") > 0, F.least(cap, raw)).when(F.col("high") > 0, F.least(F.lit(75), raw)).otherwise(raw)
    share = F.when(F.col("n") == 0, 0.0).otherwise(F.round((F.col("pqc") / F.greatest(F.lit(1), F.col("n")) * 100.0).cast("decimal(18,6)"), 1).cast("double"))
    return row.select("n", "critical", "high", "pqc", "classical", "deprecated", share.alias("migrated_pct"), score.cast("int").alias("readiness"))


def friction(assets: DataFrame, by: str) -> DataFrame:
    """How hard an estate is to move: critical and high assets per asset, by ``by`` and in all."""
    c, h = F.count_if(F.col("risk_level") == "CRITICAL"), F.count_if(F.col("risk_level") == "HIGH")
    out = assets.rollup(by).agg(F.round(((c * 2.5 + h * 1.5) / F.greatest(F.lit(1), F.count("*"))).cast("decimal(18,6)"), 2).cast("double").alias("friction_score"))
    return out.select(F.coalesce(by, F.lit("*")).alias(by), "friction_score")


def simulation_figures(rows: DataFrame, no_year: int = 2034) -> DataFrame:
    """One row of (breach, risk_category, var_year): mean and largest breach in percent, counts, and the earliest year of the vulnerable."""
    b, risk = F.col("breach"), F.col("risk_category")
    vulnerable = risk.isin("CRITICAL", "HIGH")
    out = rows.agg(
        F.count("*").alias("assets"), F.count("breach").alias("simulated"), F.coalesce(F.avg("breach"), F.lit(0.0)).alias("mean"), F.greatest(F.lit(0.0), F.coalesce(F.max("breach"), F.lit(0.0))).alias("top"),
        F.count_if((risk == "CRITICAL") | (F.coalesce(b, F.lit(0.0)) > 0.3)).alias("critical"), F.count_if(risk == "HIGH").alias("high"), F.min(F.when(vulnerable, F.col("var_year"))).alias("year"),
    )
    percent = lambda c: F.round((F.col(c) * 100).cast("decimal(18,6)"), 2).cast("double")
    return out.select("assets", "simulated", percent("mean").alias("mean_pct"), percent("top").alias("max_pct"), "critical", "high", F.coalesce("year", F.lit(no_year)).cast("int").alias("var_year"))


def what_if(z: Column, x: Column, y: Column, year: int) -> Column:
    """Breach probability of a runway that is short by (x + y) - (z - year): logistic, between 0.01 and 0.999."""
    gap = (z - year) - (x + y)
    return F.least(F.lit(0.999), F.greatest(F.lit(0.01), 1.0 / (1.0 + F.exp(gap / 1.8))))


def collapse_density(at: Column, centre: Column, spread: float = 2.4) -> Column:
    score = (at - centre) / spread
    return F.exp(-0.5 * score * score) / (spread * (2 * 3.141592653589793) ** 0.5)


def by_manifest(deps: DataFrame) -> DataFrame:
    """Dependencies of each manifest, counted and listed in order of their names."""
    return deps.groupBy("manifest_path").agg(F.count("*").alias("packages"), F.count_if(F.col("readiness") == "VULNERABLE_CLASSICAL").alias("vulnerable"), F.array_join(F.array_sort(F.collect_list("package")), ",").alias("listed"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node_id, upstream, downstream): the nodes one hop away, counted on either side."""
    into = edges.select(F.col("dst").alias("node_id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    out = edges.select(F.col("src").alias("node_id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    return into.unionAll(out).groupBy("node_id").agg(F.sum("up").alias("upstream"), F.sum("down").alias("downstream"))


def busiest(degrees: DataFrame) -> DataFrame:
    """The node of the highest degree, the first by name."""
    return degrees.agg(F.max(F.struct("degree")).alias("m"), F.min(F.struct((-F.col("degree")).alias("o"), "node_id")).alias("x")).select(F.col("x.node_id").alias("node_id"), F.col("m.degree").alias("degree"))


def layered(rows: DataFrame, category: str, order: str, columns: dict[str, int]) -> DataFrame:
    """Layout: a column by category, and the place in it from 0."""
    items = [F.lit(x) for pair in columns.items() for x in pair]
    place = F.row_number().over(W.partitionBy(category).orderBy(order)) - 1
    return rows.select("*", F.element_at(F.create_map(*items), F.col(category)).alias("layer"), place.alias("place"))


def variable_flows(edges: DataFrame) -> DataFrame:
    """(hub, input, sinks): what first feeds each hub, and all that it reaches, in order."""
    fed = edges.where("edge_type = 'FEEDS'").groupBy(F.col("target_id").alias("hub")).agg(F.min("source_id").alias("input"))
    sinks = edges.where("edge_type = 'REACHES'").groupBy(F.col("source_id").alias("hub")).agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias("sinks"))
    return fed.join(sinks, "hub", "full_outer")


def context_lines(lines: DataFrame, around: int = 5) -> DataFrame:
    """Lines (path, line_no, text) with the lines up to ``around`` before and after, joined."""
    near = W.partitionBy("path").orderBy("line_no").rangeBetween(-around, around)
    return lines.withColumn("context", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text")).over(near)), lambda x: x["text"]), "\n"))


def replicas(certificates: DataFrame) -> DataFrame:
    """Certificates of one fingerprint as one: the first path, and the others as its replicas."""
    return certificates.groupBy("fingerprint").agg(F.min("path").alias("path"), F.count("*").alias("copies"), F.array_join(F.slice(F.array_sort(F.collect_list("path")), 2, 1_000_000), ",").alias("replicas"))
