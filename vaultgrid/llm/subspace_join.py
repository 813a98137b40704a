"""Near-duplicate vectors within a label, by a pigeonhole join over subspaces.

Bound. Unit vectors with cosine t or more are at most 2 - 2t apart, squared. A
rotation keeps distances; the rotated components are dealt to blocks, and each
block gets a budget, its share of 2 - 2t in proportion to its share of the
variance. A pair over budget in every block would be too far apart, so a pair
that links is within budget in some block. The rotation (principal axes of a
bounded sample, dealt so that blocks have about equal variance) only decides how
well blocks separate; results do not depend on it.

Range joins. In each block a label's vectors are put into cells, twice the
block's range wide, of as many of its components as their number asks for. A
vector has its home in one cell and asks in every cell that its range touches. A
task gets the homes and askers of one cell, at most ``CELL`` of each (a larger
cell is dealt out: homes by hash to shares, all askers to all shares, in shares
too), finds pairs within the block's budget by one matrix product, and verifies
the union of candidates exactly: a pair counts in the first block in which it is
within budget, if its cosine in double precision is t or more.

Results. Rows of one label with equal vectors are one class, whose copies count
as links of each other and go through the join once. A task tells of each vector
how many links it found and one vector that they join it to: a few numbers a
vector, never a row a pair. Sums of the counts are exact; the joins are followed
to components by hooking and jumping over tables.

Defined cases: vectors that are null, zero or hold null or non-finite components,
and rows with a null label, link with nothing; nor do vectors of different
lengths. Repeated rows link with each other. A null id is never a component's id
unless it is alone, and counts as a link. An empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hashed_sample, lean, table
from .multi_index import usable
from .ngram_join import connected

COSINE = 0.93
#: Blocks of a vector, vectors of a cell in a task, components that a cell is cut by at most.
BLOCKS, CELL, CUTS = 8, 8192, 4
#: Rows that the rotation is fitted on, and pairs that are verified at a time.
SAMPLE, CHECKED = 8192, 1 << 15
#: What rounding can change in a squared distance of unit vectors, and more, in doubles and in floats; distances compared at a time.
SLACK, FLOAT_SLACK = 1e-9, 1e-5
COMPARED = 1 << 21


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; this changes no bit of a cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.square(x).sum(1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt(np.square(a).sum(1)) * np.sqrt(np.square(b).sum(1)))


class Blocks:
    """A rotation of vectors of one length, its blocks of components and their budgets."""

    def __init__(self, width: int, sample: np.ndarray | None, budget: float, blocks: int = BLOCKS):
        variance, self.turn = np.ones(width), None
        if sample is not None and len(sample) > 1:
            away = sample - sample.mean(0)
            variance, axes = np.linalg.eigh(away.T @ away)
            variance, self.turn = np.maximum(variance, 0), np.ascontiguousarray(axes)
        n = min(blocks, width, max(int((variance > 1e-6 * variance.sum()).sum()), 1))
        load, self.parts = np.zeros(n), [[] for _ in range(n)]
        for i in np.argsort(-variance, kind="stable").tolist():  # the next axis goes to the block with the least variance
            b = int(np.lexsort((np.array([len(p) for p in self.parts]), load))[0])
            self.parts[b].append(i)
            load[b] += variance[i]
        share = load / load.sum() if load.sum() > 0 else np.full(n, 1 / n)
        self.budget = budget * share + SLACK
        self.range = np.sqrt(self.budget)

    def turned(self, u: np.ndarray) -> np.ndarray:
        """The rotated vectors, each the same bits in whichever batch it comes, as the first block of a pair must be."""
        if self.turn is None:
            return u
        out = np.zeros_like(u)
        for i, row in enumerate(self.turn):
            out += u[:, i : i + 1] * row
        return out

    def cells(self, y: np.ndarray, b: int, cuts: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their cell in block b, whether it is their home), for every cell that their ranges touch."""
        parts, r = self.parts[b][:cuts], self.range[b]
        z, wide = y[:, parts], 2 * r
        low, home = np.floor((z - r) / wide), np.floor(z / wide)
        out = []
        for step in product(range(3), repeat=len(parts)):
            cell = low + step
            off = np.maximum(np.maximum(cell * wide - z, z - (cell + 1) * wide), 0)
            rows = np.flatnonzero(np.square(off).sum(1) <= r * r * (1 + 1e-9))
            if len(rows):
                out.append((rows, cell[rows].astype(np.int64), (cell[rows] == home[rows]).all(1)))
        return out

    def first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first block in which the rotated pairs are within budget."""
        d = np.square(a - b)
        within = np.stack([sum(d[:, i] for i in p) <= t for p, t in zip(self.parts, self.budget)])
        return within.argmax(0)


    def halves(self, y: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Factors, in floats, whose product is above 0 for pairs within budget in block b (and for few others): (budget - distance) / 2."""
        z = y[:, self.parts[b]].astype(np.float32)
        size, ones = np.square(z).sum(1, keepdims=True) / 2, np.ones((len(z), 1), np.float32)
        return np.concatenate([z, np.float32((self.budget[b] + FLOAT_SLACK) / 2) - size, ones], 1), np.concatenate([z, ones, -size], 1)


class Plans:
    """The blocks of each vector length; lengths that the sample lacks are not rotated."""

    def __init__(self, samples: dict[int, np.ndarray], budget: float, blocks: int):
        self.budget, self.blocks = budget, blocks
        self.known = {width: Blocks(width, x, budget, blocks) for width, x in samples.items()}

    def of(self, width: int) -> Blocks:
        if width not in self.known:
            self.known[width] = Blocks(width, None, self.budget, self.blocks)
        return self.known[width]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


ASKED = "cell long, block int, home boolean"
#: Stands for all blocks.
EVERY = -1


def _celled(shared, names: list[str]):
    """For each vector a row for each block and cell that it asks in; ``cuts`` tells how many components its label's cells are cut by.

    A label that is not cut is one cell, in which a task joins all blocks.
    """

    def run(batches):
        for whole in batches:
            widths = whole.column(names.index("width")).to_numpy()
            for width in np.unique(widths).tolist():
                for batch in pa.Table.from_batches([whole.filter(pa.array(widths == width))]).combine_chunks().to_batches(CELL):
                    blocks = shared.value.of(width)
                    y = blocks.turned(unit(_matrix(batch.column(names.index("vec")))))
                    cuts = batch.column(names.index("cuts")).to_numpy()
                    for c in np.unique(cuts).tolist():
                        of = np.flatnonzero(cuts == c)
                        if not c:
                            kept = [x.take(pa.array(of)) for x in batch.columns]
                            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.zeros(len(of), np.int64)), pa.array(np.full(len(of), EVERY, np.int32)), pa.array(np.ones(len(of), bool))], [*names, "cell", "block", "home"])
                            continue
                        for b in range(len(blocks.parts)):
                            for rows, cell, home in blocks.cells(y[of], b, c):
                                key = np.zeros(len(rows), np.int64)
                                for column in cell.T:  # at most CUTS numbers of 16 bits: a range is above 2**-15
                                    key = (key << 16) + column + (1 << 15)
                                kept = [x.take(pa.array(of[rows])) for x in batch.columns]
                                yield pa.RecordBatch.from_arrays([*kept, pa.array(key), pa.array(np.full(len(rows), b, np.int32)), pa.array(home)], [*names, "cell", "block", "home"])

    return run


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each vector's component, from the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(shared, least: float):
    """(node, n, other) of the vectors of one share of a cell: the links that an asker found, and one vector of its component."""

    def run(key, rows):
        home, block, width = rows["home"].to_numpy(), rows["block"][0].as_py(), rows["width"][0].as_py()
        node, copies, x = rows["node"].to_numpy(), rows["copies"].to_numpy(), _matrix(rows["vec"].combine_chunks())
        blocks = shared.value.of(width)
        y = blocks.turned(unit(x))
        joined = range(len(blocks.parts)) if block == EVERY else [block]
        at, asks = np.flatnonzero(home), np.flatnonzero(rows["asks"].to_numpy())
        count, root = np.zeros(len(node), np.int64), np.arange(len(node))
        sides = [blocks.halves(y, b) for b in joined]
        whole = len(at) == len(asks) == len(node)  # each pair is met once, not once from either side
        step = max(COMPARED // max(len(at), 1), 1)
        for k in range(0, len(asks), step):
            some, homes = asks[k : k + step], at[k:] if whole else at
            near = np.zeros((len(some), len(homes)), bool)
            for left, right in sides:
                near |= left[some] @ right[homes].T > 0
            i, j = np.nonzero(near)
            i, j = some[i], homes[j]
            other = i < j if whole else node[i] != node[j]
            i, j = i[other], j[other]
            for m in range(0, len(i), CHECKED):
                a, b = i[m : m + CHECKED], j[m : m + CHECKED]
                links = cosines(x[a], x[b]) >= least
                if block != EVERY:
                    links &= blocks.first(y[a], y[b]) == block
                a, b = a[links], b[links]
                np.add.at(count, a, copies[b])
                if whole:
                    np.add.at(count, b, copies[a])
                a, b = root[a], root[b]
                if (a != b).any():
                    root = roots_of(len(node), a, b)[root]
        told = np.flatnonzero((count > 0) | (root != np.arange(len(node))))
        return pa.table({"node": node[told], "n": count[told], "other": node[root[told]]})

    return run


def dealt(celled: DataFrame, most: int) -> DataFrame:
    """``celled`` with ``share`` and ``asks``: the homes and the askers of a large cell in shares of about ``most``, each with each."""
    key = ["label", "width", "block", "cell"]
    sizes = celled.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count("*").alias("askers")).where((F.col("homes") > 0) & (F.col("askers") > 1))
    sizes = sizes.select(*key, F.ceil(F.col("homes") / most).cast("int").alias("across"), F.ceil(F.col("askers") / most).cast("int").alias("down"))
    rows = celled.join(sizes, key)
    one, two = F.pmod(F.xxhash64("node"), F.col("across")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("down")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # as a home: its share across, every share down; as an asker: every share across, its share down
    places = F.concat(
        F.filter(F.transform(every("down"), lambda d: F.struct(one.alias("i"), d.alias("j"), F.lit(True).alias("home"), (d == two).alias("asks"))), lambda _: F.col("home")),
        F.filter(F.transform(every("across"), lambda a: F.struct(a.alias("i"), two.alias("j"), F.lit(False).alias("home"), F.lit(True).alias("asks"))), lambda p: ~(F.col("home") & (p["i"] == one))),
    )
    rows = rows.withColumn("p", F.explode(places))
    return rows.select(*key, F.col("p.i").alias("i"), F.col("p.j").alias("j"), "node", "copies", "vec", F.col("p.home").alias("home"), F.col("p.asks").alias("asks"))


def links(classes: DataFrame, scratch: Scratch, cosine: float, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """(node, n, other): parts of the number of links of a class (node, label, vec, copies), and classes of its component."""
    spark = classes.sparkSession
    classes = classes.withColumn("width", F.size("vec"))
    sample = hashed_sample(classes, F.xxhash64("label", "vec"), ["node"], SAMPLE).select("vec").toArrow()["vec"].to_pylist()
    by_width: dict[int, list] = {}
    for v in sample:
        by_width.setdefault(len(v), []).append(v)
    plans = Plans({w: unit(np.array(v, np.float64)) for w, v in by_width.items()}, 2 - 2 * cosine, blocks)
    shared = spark.sparkContext.broadcast(plans)  # a rotation for each length of the sample
    # a label's cells are cut by one more component each time it is three times as large
    sizes = classes.groupBy("label", "width").agg(F.count("*").alias("size"))
    cuts = F.least(F.lit(CUTS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / cell) / np.log2(3).item()))).cast("int")
    sized = classes.join(sizes.select("label", "width", cuts.alias("cuts"), "size").where("size > 1").drop("size"), ["label", "width"])
    names = ["label", "width", "node", "copies", "vec", "cuts"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.select(*names).schema.fields)
    celled = scratch.write(sized.select(*names).mapInArrow(lean(_celled(shared, names)), f"{schema}, {ASKED}"), "cells")
    grouped = dealt(celled, cell).groupBy("label", "width", "block", "cell", "i", "j")
    return grouped.applyInArrow(_linked(shared, cosine), "node long, n long, other long")


def components(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "subspaces")
    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    given = scratch.write(given.select("*", (usable(F.col("vec")) & F.col("label").isNotNull()).alias("good"), F.monotonically_increasing_id().alias("row")), "given")
    good = given.where("good")
    classes = scratch.write(good.groupBy("label", "vec").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("id").alias("smallest")), "classes")
    found = scratch.write(links(classes.select("node", "label", "vec", "copies"), scratch, cosine, blocks, cell), "links")
    scratch.drop("cells")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    parts = connected(joined, scratch, "components").select(F.col("cls").alias("node"), F.col("label").alias("part"))
    named = classes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    smallest = scratch.write(named.groupBy("part").agg(F.min("smallest").alias("component_id")), "smallest")
    told = named.join(smallest, "part").join(counts, "node", "left").select("label", "vec", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = good.join(told, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = given.where(~F.col("good")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op11_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: The same by SQL, on tables small enough for all pairs of a label.
OP11_SQL = """WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: coalesce(CAST(x AS DOUBLE), 0)) AS v, label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good FROM embeddings),
g AS (SELECT r, vec_id, label, len(v) AS w, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE good),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND a.w = b.w AND a.r <> b.r WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
reached AS (SELECT r AS a, r AS b FROM e UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.r) AS n_links, min(o.vec_id) AS component_id, e.vec_id IS NOT DISTINCT FROM min(o.vec_id) AS kept FROM e JOIN reached ON reached.a = e.r JOIN e o ON o.r = reached.b GROUP BY e.r, e.vec_id"""
