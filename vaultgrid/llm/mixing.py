"""Mixing sources to target weights by entropy balancing.

Targets. Sources by code point (null last) weigh 3, 1, 2, repeating, and share
``share`` times all words; a target stops at ``cap`` times its source's words
and the excess is shared again by weight until none is above.

Rates. Of all rates that meet each source's token constraint, the ones closest
in relative entropy to taking every token once are exponential tilts
``exp(lambda_source)``. The dual, the sum over sources of ``S exp(l) - l T``,
is convex; Newton steps over the distributed table of sources solve it.

Copies. A source's documents are dealt by a hash of id and text into blocks of
about ``BLOCK``. In each block, from the longest document to the shortest, a
document gets the whole number of copies that keeps the running sum of words
nearest to the running sum of ``rate * size``; what a block misses is at most
about half its shortest document. No group grows with its source, and reruns
agree, as order and blocks depend on the rows alone (without id: on their place).

Nulls: a null text has size 0 and is taken 0 times its size; a null source is a
source; a null id is dealt like any other. Repeated rows are separate documents.
An empty table gives an empty result. Other columns pass through ``mix``; those
named like what it makes (``MADE``) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Scratch, attach, ranked, table

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents in a block of the rounding.
BLOCK = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, int]:
    """(source, source_size, docs, target) and the number of sources, of (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    per = ranked(totals, [F.col("source").asc_nulls_last()], scratch, "sources")
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    n, words, level = per.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    full, before = share * words / level, -1
    most = F.col("source_size") * cap
    while n:
        above = F.col("weight") * F.lit(full) > most
        held, kept, count = per.agg(F.sum(F.when(above, most).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if count == before or not kept:
            break
        full, before = (share * words - held) / kept, count
    return per.withColumn("target", F.least(F.col("weight") * F.lit(full), most)).drop("rank", "weight"), n


def balanced(targets: DataFrame, scratch: Scratch, tolerance: float = 1e-12, most: int = 60) -> DataFrame:
    """``targets`` with ``rate``: exp of the dual's solution, by Newton steps."""
    at = targets.withColumn("dual", F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.lit(0.0)))
    for step in range(most):
        got = F.col("source_size") * F.exp("dual")
        # the Hessian is diagonal: a document has tokens of one source only
        at = scratch.write(at.withColumn("dual", F.col("dual") - F.greatest(F.lit(-2.0), (got - F.col("target")) / got)), f"newton{step}")
        gap = at.agg(F.max(F.abs(F.col("source_size") * F.exp("dual") - F.col("target")) / F.col("target"))).first()[0]
        if gap is None or gap <= tolerance:
            break
    return at.withColumn("rate", F.coalesce(F.exp("dual"), F.lit(0.0))).drop("dual")


def _rounded(most: int):
    def block(t: pa.Table) -> pa.Table:
        size = t["size"].to_numpy().astype(np.int64)
        order = np.lexsort((t["__turn"].to_numpy(), -size))
        rate, copies, owed = float(t["rate"][0].as_py()), np.zeros(len(size), np.int64), 0.0
        for i in order.tolist():
            s = float(size[i])
            owed += rate * s
            c = min(most, max(0, int(np.floor(owed / s + 0.5)))) if s else 0
            low = int(np.floor(rate + 1e-9))
            copies[i] = c = min(max(c, low), low + 1, most)
            owed -= c * s
        return t.drop_columns(["__turn", "__block"]).append_column("copies", pa.array(copies)).append_column("taken", pa.array(copies * size))

    return block


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    clash = [c for c in docs.columns if c in MADE and c not in (id_col, text_col, source_col)]
    sized = docs.drop(*clash).withColumns({"size": word_count(F.col(text_col)), "__turn": dealing(id_col, text_col)})
    return _mixed(sized, scratch, share, cap, source_col)


#: Names that the operator makes; input columns of these names are replaced.
MADE = ("size", "source_size", "target", "rate", "docs", "copies", "taken")


def dealing(id_col: str, text_col: str) -> Column:
    """What deals a document to its block: id and text; rows without id, however many of one text, are dealt by place."""
    return F.xxhash64(id_col, F.xxhash64(text_col), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))


def _mixed(sized: DataFrame, scratch: Scratch, share: float, cap: float, source_col: str) -> DataFrame:
    targets, n = source_targets(sized.select(F.col(source_col).alias("source"), "size"), scratch, share, cap)
    rates = balanced(targets, scratch).withColumnRenamed("source", "__source")
    with_rate = attach(sized.withColumn("__source", F.col(source_col)), rates, "__source", n)
    block = F.pmod(F.xxhash64("__turn", F.lit("block")), F.ceil(F.col("docs") / F.lit(BLOCK)))
    dealt = with_rate.withColumn("__block", block).drop("docs")
    schema = T.StructType([f for f in dealt.schema.fields if f.name not in ("__turn", "__block")] + [T.StructField("copies", T.LongType()), T.StructField("taken", T.LongType())])
    return dealt.groupBy("__source", "__block").applyInArrow(_rounded(int(cap)), schema).drop("__source")


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), dealing("doc_id", "text").alias("__turn"))
    scratch = Scratch(spark, "mix")
    mixed = _mixed(scratch.write(docs, "sizes"), scratch, 1.5, 2.0, "source")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")
