"""Dependency graphs: reach, blast radius, node classes, degrees, lineage.

A closure grows by rounds of joins on the frontier, with each round's new pairs
written to the shared folder, so lineage stays short and executors may be lost.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The cluster's shared folder; one of our own only on a local master where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vaultgrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def reach(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(src, dst, hops): every node reachable from src in one hop or more, src itself left out."""
    spark = edges.sparkSession
    root = f"{shared_dir(spark)}/reach-{uuid.uuid4().hex}"
    step = edges.select("src", "dst").where("src <> dst").distinct()
    step.withColumn("hops", F.lit(1)).write.parquet(f"{root}/1")
    step = spark.read.parquet(f"{root}/1").select("src", "dst")
    hop = step.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for k in range(2, most_rounds + 1):
        front, known = spark.read.parquet(f"{root}/{k - 1}").select("src", "dst"), spark.read.parquet(*[f"{root}/{i}" for i in range(1, k)]).select("src", "dst")
        new = front.join(hop, "dst").select("src", F.col("next").alias("dst")).where("src <> dst").distinct().join(known, ["src", "dst"], "left_anti")
        new.withColumn("hops", F.lit(k)).write.parquet(f"{root}/{k}")
        if spark.read.parquet(f"{root}/{k}").isEmpty():
            return spark.read.parquet(*[f"{root}/{i}" for i in range(1, k)])
    raise RuntimeError("the closure does not end")


def reach_counts(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(node_id, r0): distinct nodes reachable from each node."""
    counts = closure.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("long").alias("r0"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select(F.col("dst").alias("node_id")))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def classes(nodes: DataFrame, r0: DataFrame, edges: DataFrame, threshold: int = 2) -> DataFrame:
    """Nodes (node_id, vulnerable, safe) with r0 and a class."""
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("into"))
    out = nodes.join(r0, "node_id", "left").join(into, "node_id", "left").withColumn("r0", F.coalesce("r0", F.lit(0)))
    kind = (
        F.when(F.col("safe") & ~F.col("vulnerable") & (F.col("r0") >= threshold), "ANCHOR")
        .when(F.col("safe") & ~F.col("vulnerable"), "SAFE")
        .when(F.col("vulnerable") & (F.col("r0") >= threshold), "SUPERSPREADER")
        .when(F.col("vulnerable"), "CRYPTO")
        .when(F.col("r0") > 0, "INTERMEDIARY")
        .otherwise("CONSUMER")
    )
    return out.select("node_id", "r0", F.coalesce("into", F.lit(0)).cast("long").alias("providers"), kind.alias("node_class"))


def blast(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blast radius: reachable nodes and the node itself, and their share of all nodes."""
    return blast_of(reach_counts(nodes, closure))


def blast_of(r0: DataFrame) -> DataFrame:
    """The same from counts (node_id, r0) of all nodes."""
    total = r0.agg(F.count("*").alias("total"))
    counted = r0.crossJoin(F.broadcast(total))  # one row
    share = F.round((100.0 * (F.col("r0") + 1) / F.col("total")).cast("decimal(18,6)"), 1).cast("double")
    return counted.select("node_id", (F.col("r0") + 1).alias("radius"), share.alias("share_pct"))


def connected_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id")))
    return nodes.join(ends, "node_id", "left_semi")


def flows(ingress: DataFrame, nexus: DataFrame, egress: DataFrame) -> DataFrame:
    """Lineage edges inside each file: every ingress to every nexus, every nexus to every egress."""
    a = ingress.select("file_path", F.col("node_id").alias("source_id")).join(nexus.select("file_path", F.col("node_id").alias("target_id")), "file_path").withColumn("edge_type", F.lit("FEEDS"))
    b = nexus.select("file_path", F.col("node_id").alias("source_id")).join(egress.select("file_path", F.col("node_id").alias("target_id")), "file_path").withColumn("edge_type", F.lit("REACHES"))
    return a.unionByName(b).select("source_id", "target_id", "edge_type").distinct()


def hubs(edges: DataFrame) -> DataFrame:
    """Hub and spoke: consumers of each source, counted and listed in order."""
    return edges.groupBy(F.col("source_id").alias("hub")).agg(F.countDistinct("target_id").alias("consumers"), F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias("spokes"))


def algorithms(rows: DataFrame, node: str, algorithm: str) -> DataFrame:
    """Each node's distinct algorithms, in order."""
    return rows.groupBy(node).agg(F.array_join(F.array_sort(F.collect_set(algorithm)), ",").alias("algorithms"), F.countDistinct(algorithm).alias("n"))


#: The node that keys of wallets and environment files belong to.
SERVICE = "backend-service"


def built(imports: DataFrame, assets: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Edges (src, dst) of the dependency network, from a provider to what depends on it.

    ``imports``: src, dst; ``assets``: file_path; ``dependencies``: package,
    manifest_path, ecosystem. An organisation's authority provides its entities;
    keys and environment files provide the service; a package provides the folder
    that declares it, or the ecosystem's application.
    """
    parts = F.split("file_path", "/")
    at = F.array_position(parts, "organizations").cast("int")  # from 1; 0: none
    of = lambda i: F.get(parts, at + i)
    entity = (at > 0) & of(2).isin("orderers", "peers", "users") & of(3).isNotNull()
    key = (at == 0) & F.arrays_overlap(parts, F.array(F.lit("wallet"), F.lit("keys")))
    env = (at == 0) & ~key & F.col("file_path").endswith(".env")
    stem = F.regexp_extract("file_path", r"([^/]+?)(\.[^./]*)?$", 1)
    src = F.when(entity, F.concat(of(1), F.lit("-ca"))).when(key, stem).when(env, ".env")
    dst = F.when(entity, of(3)).when(key | env, SERVICE)
    owned = assets.select(src.alias("src"), dst.alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    folder = F.regexp_extract("manifest_path", r"([^/]+)/[^/]+$", 1)
    declared = dependencies.where("package <> ''").select(F.col("package").alias("src"), F.when(folder == "", F.concat("ecosystem", F.lit("-app"))).otherwise(folder).alias("dst"))
    return imports.select("src", "dst").unionByName(owned).unionByName(declared).distinct()


def resolved_r0(assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``assets`` with r0: of the first node (ord, node_id, file_path, r0) that is named like the component or the file, or has its path; at least 1."""
    stem = F.regexp_extract("file_path", r"([^/]+?)(\.[^./]*)?$", 1)
    probes = assets.select("asset_id", F.explode(F.array_distinct(F.array(F.struct(F.lit("id").alias("k"), F.col("component_name").alias("v")), F.struct(F.lit("id").alias("k"), stem.alias("v")), F.struct(F.lit("path").alias("k"), F.col("file_path").alias("v"))))).alias("p")).select("asset_id", "p.k", "p.v")
    names = nodes.select(F.lit("id").alias("k"), F.col("node_id").alias("v"), "ord", "r0").unionByName(nodes.select(F.lit("path").alias("k"), F.col("file_path").alias("v"), "ord", "r0")).where("v IS NOT NULL")
    # only the first node of a name can count: a row for each name, so that no asset meets all of them
    names = names.groupBy("k", "v").agg(F.min(F.struct("ord", "r0")).alias("n")).select("k", "v", "n.*")
    first = probes.join(names, ["k", "v"]).groupBy("asset_id").agg(F.min(F.struct("ord", "r0")).alias("x"))
    found = first.select(F.col("asset_id").alias("__id"), F.col("x.r0").alias("__r0"))
    return assets.drop("r0").join(found, F.col("asset_id") == F.col("__id"), "left").withColumn("r0", F.greatest(F.lit(1), F.coalesce("__r0", F.lit(1))).cast("long")).drop("__id", "__r0")


def flow_tiers(nodes: DataFrame, edges: DataFrame, passes: int = 3) -> DataFrame:
    """(node_id, tier) of nodes (node_id, superspreader, has_crypto): 0 for origins to 4 for the isolated.

    After the first guess each pass moves a node behind the last one before it
    that stands as far or farther, all nodes at once.
    """
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("__in"))
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("__out"))
    rows = nodes.join(into, "node_id", "left").join(out, "node_id", "left").na.fill(0, ["__in", "__out"])
    origin = F.col("superspreader") | F.contains("node_id", F.lit("-ca")) | ((F.col("__in") == 0) & (F.col("__out") > 0))
    first = F.when(origin, 0).when(F.col("has_crypto"), 1).when((F.col("__in") > 0) & (F.col("__out") > 0), 2).when(F.col("__in") + F.col("__out") > 0, 3).otherwise(4)
    tiers = rows.select("node_id", first.alias("tier"))
    for _ in range(passes):
        before = edges.join(tiers.select(F.col("node_id").alias("src"), F.col("tier").alias("__s")), "src").select(F.col("dst").alias("__to"), "__s").where("__s < 3")
        pushed = tiers.join(before, F.col("node_id") == F.col("__to"), "left").groupBy("node_id").agg(F.max("tier").alias("tier"), F.max(F.when(F.col("tier") <= F.col("__s"), F.col("__s") + 1)).alias("__t"))
        tiers = pushed.select("node_id", F.greatest("tier", F.coalesce("__t", F.col("tier"))).alias("tier"))
    return tiers
