"""How many nodes each node reaches, exactly, without a row a pair.

Nodes on cycles reach the same nodes, so strongly connected components stand for
their nodes: where peeling leaves stops, links that lie on no cycle are trimmed,
colours (the largest node that reaches a node) spread until nothing changes, and
what reaches a colour's node within its colour is a component. The condensed
graph has levels: a component is ready when all that it links to are done.

Targets are bits. Nodes are numbered so that nodes with the same first provider
stand together; 64 neighbours in this order are a block. A component holds, for
each block that it reaches into, one mask; level by level the masks of what it
links to are joined by or. Each link is followed once, counts are the bits of
the masks, and rows are blocks reached, not nodes reached.

Every step is a written table in the shared folder, dropped when the next needs
it no more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import shared_dir

BITS = 64


class Steps:
    """Written tables that cut lineage; dropped by name, or when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.kept = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(self.root))
        self.fs.deleteOnExit(self.path(self.root))

    def write(self, df: DataFrame, name: str | None = None) -> DataFrame:
        self.kept += 1
        folder = f"{self.root}/{name or self.kept}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self.path(f"{self.root}/{name}"), True)


def ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()


def trimmed(links: DataFrame, steps: Steps, name: str) -> tuple[DataFrame, int]:
    """Links between nodes that have a link in and one out, again and again; and how many there are."""
    n, k = links.count(), 0
    while n:
        to, back = links.select(F.col("b").alias("a")).distinct(), links.select(F.col("a").alias("b")).distinct()
        fewer = steps.write(links.join(to, "a", "left_semi").join(back, "b", "left_semi").select("a", "b"), f"{name}-trim{k}")
        steps.drop(f"{name}-trim{k - 1}")
        left, k = fewer.count(), k + 1
        if left == n:
            return fewer, n
        links, n = fewer, left
    return links, 0


def cycles(links: DataFrame, steps: Steps) -> DataFrame:
    """(id, comp) of all nodes on cycles: comp is the largest node of the strongly connected component."""
    found, k = [], 0
    while True:
        links, n = trimmed(links, steps, f"core{k}")
        if not n:
            break
        colour, moved, r = steps.write(ends(links).withColumn("colour", F.col("id")), f"colour{k}-0"), True, 0
        while moved:
            r += 1
            into = links.join(colour.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.max("colour").alias("other"))
            new = colour.join(into, "id", "left").select("id", F.greatest("colour", F.coalesce("other", "colour")).alias("colour"), (F.col("other") > F.col("colour")).alias("moved"))
            new = steps.write(new, f"colour{k}-{r}")
            steps.drop(f"colour{k}-{r - 1}")
            moved, colour = not new.where("moved").isEmpty(), new.select("id", "colour")
        of = lambda c: colour.select(F.col("id").alias(c), F.col("colour").alias(f"{c}_colour"))
        within = steps.write(links.join(of("a"), "a").join(of("b"), "b").where("a_colour = b_colour").select("a", "b"), f"within{k}")
        part = steps.write(colour.where("id = colour").select("id", F.col("colour").alias("comp")), f"part{k}-0")
        front, r = part, 0
        parts = [part]
        while not front.isEmpty():
            r += 1
            back = within.join(front.select(F.col("id").alias("b"), "comp"), "b").select(F.col("a").alias("id"), "comp").distinct()
            for p in parts:
                back = back.join(p, "id", "left_anti")
            front = steps.write(back, f"part{k}-{r}")
            parts.append(front)
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        whole = steps.write(whole, f"comps{k}")
        found.append(whole)
        gone = whole.select("id")
        rest = within.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        links = steps.write(rest, f"rest{k}")
        steps.drop(f"within{k}", f"colour{k}-{r}", *[f"part{k}-{i}" for i in range(len(parts))])
        k += 1
    out = steps.spark.createDataFrame([], "id long, comp long")
    for x in found:
        out = out.unionByName(x)
    return out


def levels(links: DataFrame, steps: Steps, name: str) -> tuple[list[DataFrame], DataFrame | None]:
    """The links by the level of where they begin, lowest first; and the links of nodes that reach a cycle, if there are any."""
    out, k, left = [], 0, links
    n = left.count()
    while n:
        tails = left.select(F.col("a").alias("b")).distinct()
        open_ = steps.write(left.join(tails, "b", "left_semi").select("a", "b"), f"{name}-open{k}")
        fewer = open_.count()
        if fewer == n:  # every link leads to a node that has one itself
            return out, open_
        waiting = open_.select("a").distinct()
        again = links.join(tails.withColumnRenamed("b", "a"), "a", "left_semi")
        out.append(steps.write(again.join(waiting, "a", "left_anti").select("a", "b"), f"{name}-level{k}"))
        left, n, k = open_, fewer, k + 1
    return out, None


def reached(edges: DataFrame) -> DataFrame:
    """(node_id, r0) of every node of the edges (src, dst): how many other nodes it reaches."""
    steps = Steps(edges.sparkSession, "reach")
    e = steps.write(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    first = e.groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("provider"))
    every = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id"))).where("node_id IS NOT NULL").distinct()
    nodes = steps.write(every.join(first, "node_id", "left").orderBy("provider", "node_id").select("node_id", F.monotonically_increasing_id().alias("id")), "nodes")
    number = lambda c, to: nodes.select(F.col("node_id").alias(c), F.col("id").alias(to))
    links = steps.write(e.join(number("src", "a"), "src").join(number("dst", "b"), "dst").select("a", "b"), "links")
    by_level, stuck = levels(links, steps, "plain")
    comps = None
    if stuck is not None:
        comps = steps.write(cycles(stuck, steps), "comps")
        for c in ("a", "b"):
            links = links.join(comps.select(F.col("id").alias(c), F.col("comp").alias("__comp")), c, "left").withColumn(c, F.coalesce("__comp", c)).drop("__comp")
        links = steps.write(links.where("a <> b").distinct().select("a", "b"), "condensed")
        by_level, _ = levels(links, steps, "condensed")
    member = nodes.select("id", F.col("id").alias("comp")) if comps is None else nodes.select("id").join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    bit = F.expr(f"shiftleft(1L, cast(id % {BITS} AS int))")
    own = steps.write(member.groupBy("comp", F.shiftright("id", 6).alias("block")).agg(F.bit_or(bit).alias("mask")), "own")
    rows = own
    tables = []
    for k, level in enumerate(by_level):
        masks = level.join(rows.withColumnRenamed("comp", "b"), "b").groupBy(F.col("a").alias("comp"), "block").agg(F.bit_or("mask").alias("mask"))
        tables.append(steps.write(masks, f"masks{k}"))
        rows = rows.unionByName(tables[-1])
    counts = steps.spark.createDataFrame([], "comp long, n long")
    for t in tables:
        counts = counts.unionByName(t.groupBy("comp").agg(F.sum(F.bit_count("mask").cast("long")).alias("n")))
    size = own.groupBy("comp").agg(F.sum(F.bit_count("mask").cast("long")).alias("size"))
    told = steps.write(size.join(counts, "comp", "left").select("comp", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("r0")), "told")
    out = steps.write(nodes.join(member, "id").join(told, "comp").select("node_id", "r0"), "out")
    steps.drop("edges", "links", "condensed", "own", "told", *[f"masks{k}" for k in range(len(tables))], *[f"{n}-{w}{k}" for n in ("plain", "condensed") for w in ("open", "level") for k in range(len(by_level) + 1)])
    return out
