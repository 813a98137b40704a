"""Exact n-gram Jaccard join with prefix filters under several global orders.

A document's set holds the 64-bit hashes of its 4-word shingles; documents with
equal sets are one class, named by a 63-bit hash of the set. Two sets with
100 * intersection >= 85 * union share a token among the first
``n - ceil(0.85 n) + 1`` of each under any order of all tokens. Three orders are
used; they share their first criterion, rare before frequent, and differ in the
hash that breaks ties. A pair links only if its prefixes meet under all three.

Steps. (1) Tasks report tokens that are frequent among their documents; the
summed reports, at most ``HOT`` of them, put frequent tokens last in the orders
(any order is right; this one keeps shared passages out of the prefixes).
(2) Each class tells its prefix under the first order, longer by half, of which
two sets that link share as many tokens as the half has. Tokens that only one
class tells are dropped, classes with too few left, and of the rest the most
frequent that a pair can do without. What remains, (token, class) rows, are the
groups in which pairs can meet. Only classes in a group have their sets built.
(3) In each group the class with the fewest tokens of its own is the pivot, and
all others are measured against it, not against each other. The measure is the
gap, the size of the symmetric difference, which is a metric. A class within
``near`` of the pivot is done with the group once it has met all classes that
the triangle inequality leaves as its partners; those meet it through their
differences to the pivot, a few tokens each, from which the gap of any two is
exact. Two classes that link to the pivot are in one component and need no
test. The others of the group go on to a next pivot. (4) When pivots no longer
shrink what is left, the remaining pairs of each group are verified.

No candidates are capped or dropped. Links inside one component may go
unlisted, but none that would join two.

Defined cases: a null or wordless text has an empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is one. A null id is
carried; the component of a document is the smallest id in it, null if none.
Repeated rows are in one class. An empty table gives an empty result; other
columns pass through ``components``, but for input columns named like its
results (n_shingles, component_id, group_id) or with two leading underscores,
which are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Scratch, known_in, lean, small_batches, table
from .sketch import HASHES, Powers, mixed

SHINGLE, PERCENT = 4, 85
#: Tokens that the orders know as frequent, at most; counts in a task, and over all, from which one may be.
HOT, LOCAL_HOT, TOTAL_HOT = 1 << 17, 6, 32
#: Tokens that a task combines at a time.
PENDING = 1 << 22
#: Pivots go on while the pairs left are so many times the rows left, and fall by this share each time.
CROSSING, SHRINK = 2, 0.7
MAX_PIVOTS = 12

_powers = Powers(0xA0761D6478BD642F | 1)


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(_powers.windows(HASHES.of(words), min(k, len(words))) ^ np.uint64(min(k, len(words))))


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little") >> 1


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def least_shared(p: int) -> int:
    """How many tokens the first ``p + least_shared(p) - 1`` of two sets that link have in common, at least."""
    return (p + 1) // 2


def levels(tokens: np.ndarray, hot: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The frequency level of each token; 0 if it is not known as frequent."""
    if not len(hot):
        return np.zeros(len(tokens), np.uint64)
    at = np.searchsorted(hot, tokens).clip(0, len(hot) - 1)
    return np.where(hot[at] == tokens, level[at], 0).astype(np.uint64)


def prefix(tokens: np.ndarray, often: np.ndarray, order: int, length: int) -> np.ndarray:
    """Places of the first ``length`` tokens of a set, in any order: by frequency level, then by the order's hash."""
    if length >= len(tokens):
        return np.arange(len(tokens))
    return np.argpartition(mixed(tokens, 101 + order) >> np.uint64(5) | often << np.uint64(59), length - 1)[:length]


def _frequent(k: int):
    def run(batches):
        parts, held = [], 0

        def flush():
            token = np.sort(np.concatenate(parts))
            parts.clear()
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            n = np.diff(np.append(first, len(token)))
            often = n >= LOCAL_HOT
            return pa.RecordBatch.from_arrays([pa.array(token[first[often]].view(np.int64)), pa.array(n[often])], ["token", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                parts.append(shingles(text.as_py(), k))
                held += len(parts[-1])
                if held > PENDING:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return lean(run, HASHES)


def frequent_tokens(given: DataFrame, scratch: Scratch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens known as frequent, sorted, and their levels (1 to 31, rising with the count)."""
    counts = given.select("text").mapInArrow(_frequent(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= TOTAL_HOT)
    counts = scratch.write(counts.withColumn("bin", F.floor(F.log2("n") * 2).cast("int")), "hot")
    least, total = 0, 0
    for b, c in sorted(counts.groupBy("bin").count().collect(), reverse=True):
        total += c
        if total > HOT:
            least = b + 1
            break
    got = counts.where(F.col("bin") >= least).select("token", "bin").toArrow()
    token, bins = got["token"].to_numpy().view(np.uint64), got["bin"].to_numpy()
    order = np.argsort(token)
    return token[order], np.clip(bins[order] - 8, 1, 31)


#: Classes whose prefix a task knows it has sent.
SENT = 1 << 18


def _described(k: int, percent: int, shared, text_at: int, names: list[str]):
    """A row for each document: its columns but the text, and size, class and prefix of its set; equal sets of a task tell the prefix once."""

    def run(batches):
        hot, level = shared.value
        sent: set[int] = set()
        for batch in batches:
            n, cls, first, common = [], [], [], []
            for text in batch.column(text_at).cast(pa.binary()):
                s = shingles(text.as_py(), k)
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                if not len(s) or cls[-1] in sent:
                    first.append(None)
                    common.append(None)
                    continue
                if len(sent) >= SENT:
                    sent.clear()
                sent.add(cls[-1])
                p = prefix_length(len(s), percent)
                often = levels(s, hot, level)
                at = prefix(s, often, 0, p + least_shared(p) - 1)
                first.append(s[at[often[at] == 0]].view(np.int64))
                common.append(s[at[often[at] > 0]].view(np.int64))
            kept = [(c, x) for i, (c, x) in enumerate(zip(names, batch.columns)) if i != text_at]
            made = [pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(common, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(x for _, x in kept), *made], [*(c for c, _ in kept), "n_shingles", "__cls", "__prefix", "__frequent"])

    return lean(run, HASHES)


def _sets(k: int, percent: int, shared):
    def run(batches):
        hot, level = shared.value
        longs = pa.list_(pa.int64())
        for batch in batches:
            n, cls, columns = [], [], ([], [], [])
            for text in batch.column(0).cast(pa.binary()):
                s = shingles(text.as_py(), k)
                n.append(len(s))
                cls.append(class_of(s))
                p = prefix_length(len(s), percent)
                often = levels(s, hot, level)
                for column, x in zip(columns, (s, s[prefix(s, often, 1, p)], s[prefix(s, often, 2, p)])):
                    column.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), *(pa.array(c, longs) for c in columns)], ["cls", "n", "tokens", "prefix1", "prefix2"])

    return lean(run, HASHES)


def connected(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(cls, label) of all that have a link (a, b): the smallest node of each component, by hooking and jumping on tables."""
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("cls")).agg(F.least("cls", F.min("b")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("cls", "a"), "a").groupBy("b").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("b", "cls"), "cls", "left").select("cls", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = labels.select(F.col("cls").alias("new"), F.col("label").alias("far"))
        new = new.join(jump, "new").select("cls", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved"))
        new = scratch.write(new, f"{name}-{step}")
        moved = new.where("moved").limit(1).count()
        labels = new.select("cls", "label")
        scratch.drop(f"{name}-{step - 2}")
        if not moved:
            return labels


class Stars:
    """Links between the classes of groups (token, cls, n, own), found through pivots."""

    def __init__(self, members: DataFrame, sets: DataFrame, scratch: Scratch, percent: int):
        self.rest, self.sets, self.scratch, self.percent = members, sets, scratch, percent
        self.links: list[DataFrame] = []
        self.asked = 0

    def fits(self, n1: Column, n2: Column) -> Column:
        return F.lit(100) * F.least(n1, n2) >= F.lit(self.percent) * F.greatest(n1, n2)

    def close(self, gap: Column, total: Column) -> Column:
        """Whether sets of ``total`` tokens together that differ in ``gap`` link; for a lower bound of the gap, whether they can."""
        return F.lit(100 - self.percent) * total >= F.lit(100 + self.percent) * gap

    def reach(self, n: Column, np: Column) -> Column:
        """The largest gap to a pivot that a partner of a class near it can have; n is the partner's size."""
        largest = n * (100 / self.percent)
        return (largest + np) / 3 + (n + largest) * ((100 - self.percent) / (100 + self.percent)) + 1e-6

    def of(self, pairs: DataFrame, a: str, b: str, *columns: str) -> DataFrame:
        """These columns of the sets that the pairs name, so that a join does not move all the others."""
        self.asked += 1
        ids = pairs.select(F.col(a).alias("cls")).union(pairs.select(F.col(b).alias("cls"))).distinct()
        ids = self.scratch.write(ids, f"asked{self.asked}")
        return known_in(self.sets.select("cls", *columns), ids, "cls", ids.count())

    def measured(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, p) with sizes, gap, ``linked``, ``near`` (of at least half of the union in common) and, within reach, the difference."""
        sets = self.of(pairs, "a", "p", "tokens", "prefix1", "prefix2")
        left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"), F.col("prefix1").alias("a1"), F.col("prefix2").alias("a2")), "a")
        both = left.join(sets.select(F.col("cls").alias("p"), F.col("tokens").alias("tp"), F.col("prefix1").alias("p1"), F.col("prefix2").alias("p2")), "p")
        candidate = F.arrays_overlap("a1", "p1") & F.arrays_overlap("a2", "p2")
        both = both.withColumn("gap", F.col("n") + F.col("pn") - 2 * F.size(F.array_intersect("ta", "tp")))
        total = F.col("n") + F.col("pn")
        linked = candidate & self.close(F.col("gap"), total)
        difference = F.when(F.col("gap") <= self.reach(F.col("n"), F.col("pn")), F.concat(F.array_except("ta", "tp"), F.array_except("tp", "ta")))
        return both.select("a", "p", "n", "gap", linked.alias("linked"), (3 * F.col("gap") <= total).alias("near"), difference.alias("apart"))

    def among(self, star: DataFrame) -> DataFrame:
        """Links of two classes that meet in a star, one of them near its pivot and not both linked to it."""
        star = star.where(F.col("apart").isNotNull())
        open_ = star.groupBy("p").agg((~F.bool_and("linked") & (F.count("*") > 1)).alias("open")).where("open").select("p")
        star = self.scratch.write(star.join(open_, "p"), f"open{self.asked}")
        star = star.join(self.of(star, "a", "a", "prefix1", "prefix2").withColumnRenamed("cls", "a"), "a")
        other = star.select("p", *(F.col(c).alias(f"{c}_2") for c in ("a", "n", "gap", "linked", "near", "apart", "prefix1", "prefix2")))
        total = F.col("n") + F.col("n_2")
        meet = (
            F.col("near") & ~(F.col("linked") & F.col("linked_2"))
            & F.when(F.col("near_2"), F.col("a") < F.col("a_2")).otherwise(F.col("a") != F.col("a_2"))
            & self.close(F.abs(F.col("gap") - F.col("gap_2")), total)
            & F.arrays_overlap("prefix1", "prefix1_2") & F.arrays_overlap("prefix2", "prefix2_2")
            & self.close(F.col("gap") + F.col("gap_2") - 2 * F.size(F.array_intersect("apart", "apart_2")), total)
        )
        return star.alias("x").join(other.alias("y"), (F.col("x.p") == F.col("y.p")) & meet).select("a", F.col("a_2").alias("b"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: prefixes meet under the other orders, then sets are compared."""
        short = self.of(pairs, "a", "b", "prefix1", "prefix2")
        left = pairs.join(short.select(F.col("cls").alias("a"), F.col("prefix1").alias("a1"), F.col("prefix2").alias("a2")), "a")
        met = left.join(short.select(F.col("cls").alias("b"), F.col("prefix1").alias("b1"), F.col("prefix2").alias("b2")), "b")
        met = self.scratch.write(met.where(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2")).select("a", "b"), "met")
        sets = self.of(met, "a", "b", "n", "tokens")
        full = met.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
        full = full.join(sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
        total = F.col("na") + F.col("nb")
        return full.where(self.close(total - 2 * F.size(F.array_intersect("ta", "tb")), total)).select("a", "b")

    def round(self, k: int) -> None:
        """One pivot a group; classes near it leave the group."""
        first = F.min(F.struct("own", F.xxhash64("cls").alias("hash"), F.col("cls").alias("p"), F.col("n").alias("pn")))
        pivots = self.rest.groupBy("token").agg(first.alias("x"), F.count("*").alias("size")).where("size > 1").select("token", "x.p", "x.pn")
        pivots = self.scratch.write(pivots, f"pivots{k}")
        met = self.rest.join(pivots, "token").where(F.col("cls") != F.col("p"))
        pairs = met.where(F.abs(F.col("n") - F.col("pn")) <= self.reach(F.col("n"), F.col("pn"))).select(F.col("cls").alias("a"), "p", "n", "pn").distinct()
        star = self.scratch.write(self.measured(self.scratch.write(pairs, f"pairs{k}")), f"star{k}")
        self.links.append(star.where("linked").select("a", F.col("p").alias("b")))
        self.links.append(self.scratch.write(self.among(star), f"among{k}"))
        done = star.where("near").select(F.col("a").alias("cls"), "p")
        left = met.join(done, ["cls", "p"], "left_anti").select("token", "cls", "n", "own")
        sizes = left.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
        self.rest = self.scratch.write(left.join(sizes, "token"), f"rest{k}")
        for name in (f"pivots{k}", f"rest{k - 1}"):
            self.scratch.drop(name)

    def run(self) -> DataFrame:
        """All links (a, b), but for some inside a component."""
        before = None
        for k in range(MAX_PIVOTS):
            self.round(k)
            each = self.rest.agg(F.count("*"), F.sum((F.col("size") - 1) / 2)).first()
            rows, pairs = each[0], each[1] or 0
            self.rest = self.rest.drop("size")
            if not rows or k and (pairs <= CROSSING * rows or pairs > SHRINK * before):
                break
            before = pairs
        if rows:
            other = self.rest.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"))
            met = self.rest.join(other, "token").where((F.col("cls") < F.col("b")) & self.fits(F.col("n"), F.col("nb")))
            pairs = self.scratch.write(met.select(F.col("cls").alias("a"), "b").distinct(), "pairs")
            self.links.append(self.scratch.write(self.verified(pairs), "last"))
        out = self.links[0]
        for x in self.links[1:]:
            out = out.unionByName(x)
        return out


def groups_of(made: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(token, cls, n, own): the classes whose prefixes share a token; own is the share of a prefix that nobody shares.

    Of the tokens that a prefix shares with any class, a partner has ``least`` at
    least; so a class with fewer has none, and the ``least - 1`` most frequent
    ones can go: the rarest token of a pair is in neither's share of them.
    """

    def told(prefix: str) -> DataFrame:
        return made.where(F.col(prefix).isNotNull()).select(F.col("__cls").alias("cls"), F.col("n_shingles").alias("n"), F.explode(prefix).alias("token"))

    def shared(each: DataFrame) -> DataFrame:
        # sizes are asked for so that both sides of the join below read one and the same exchange
        found = each.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("often"), F.min("n").alias("size"))
        return found.where((F.col("low") < F.col("high")) & (F.col("size") > 0)).select("token", "often")

    # few classes have a token that is not frequent, so its rows are dealt out once; of the others there are at most HOT, counted in tasks first
    rare = told("__prefix").repartition("token")
    common = told("__frequent")
    members = rare.join(shared(rare).hint("merge"), "token").unionByName(common.join(F.broadcast(shared(common)), "token")).distinct()
    p = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    least = F.floor((p + 1) / 2)
    of = W.partitionBy("cls")
    members = members.withColumns({"hits": F.count("*").over(of), "at": F.row_number().over(of.orderBy("often", "token"))})
    members = members.where(F.col("at") <= F.col("hits") - least + 1).select("token", "cls", "n", (1 - F.col("hits") / (p + least - 1)).alias("own"))
    members = scratch.write(members, "members")
    sizes = members.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token")
    return scratch.write(members.join(sizes, "token"), "groups")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the text, with n_shingles, component_id and group_id (unique to a component; of its own for a wordless row)."""
    if percent < 50:
        raise ValueError("percent must be at least 50")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngrams")
    given = docs.select(F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(frequent_tokens(given, scratch, k))
    clash = [c for c in docs.columns if (c in ("n_shingles", "component_id", "group_id") or c.startswith("__")) and c not in (id_col, text_col)]
    kept = docs.drop(*clash).withColumn("__code", F.xxhash64(text_col))
    fields = [f for f in kept.schema.fields if f.name != text_col] + [T.StructField("n_shingles", T.LongType()), T.StructField("__cls", T.LongType()), T.StructField("__prefix", T.ArrayType(T.LongType())), T.StructField("__frequent", T.ArrayType(T.LongType()))]
    made = scratch.write(kept.mapInArrow(_described(k, percent, shared, kept.columns.index(text_col), kept.columns), T.StructType(fields)), "documents")
    classes = made.where(F.col("__cls").isNotNull()).groupBy(F.col("__cls").alias("cls")).agg(F.min(id_col).alias("smallest"), F.min("__code").alias("code"))
    classes = scratch.write(classes, "classes")
    groups = groups_of(made, scratch, percent)
    active = scratch.write(classes.join(groups.select("cls").distinct(), "cls").select(F.col("code").alias("__code")), "active")
    texts = known_in(kept.select("__code", F.col(text_col).alias("text")), active, "__code", active.count()).dropDuplicates(["__code"])
    longs = "cls long, n long, tokens array<long>, prefix1 array<long>, prefix2 array<long>"
    sets = scratch.write(texts.select("text").mapInArrow(_sets(k, percent, shared), longs), "sets")
    labels = connected(Stars(groups, sets, scratch, percent).run(), scratch, "components")
    named = scratch.write(classes.join(labels, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "smallest"), "named")
    joint = named.groupBy("label").agg(F.min("smallest").alias("component"))
    named = named.join(joint, "label").select(F.col("cls").alias("__cls"), F.col("label").alias("__label"), "component")
    out = made.drop("__prefix", "__frequent", "__code").withColumn("__row", F.monotonically_increasing_id()).join(named.withColumnRenamed("component", "__component"), "__cls", "left")
    own = F.when(F.col("__cls").isNull(), F.col(id_col)).otherwise(F.col("__component"))
    return out.withColumn("component_id", own).withColumn("group_id", F.coalesce("__label", -1 - F.col("__row"))).drop("__cls", "__row", "__label", "__component")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs).select("doc_id", "n_shingles", "component_id")


#: The same by SQL, on tables small enough for all pairs that share a shingle: links, and what a recursion over them reaches.
OP10_SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [md5(array_to_string(ws, ' '))] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: md5(array_to_string(ws[i:i + 3], ' ')))) END AS sh FROM d),
t AS (SELECT r, len(sh) AS n, unnest(sh) AS h FROM s),
links AS (SELECT a.r AS a, b.r AS b FROM t a JOIN t b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT r AS a, r AS b FROM s UNION SELECT reached.a, e.b FROM reached JOIN e ON reached.b = e.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM s JOIN reached ON reached.a = s.r JOIN s o ON o.r = reached.b GROUP BY s.r, s.doc_id, s.sh"""
