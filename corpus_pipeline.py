"""A corpus pipeline: quality, near copies, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), with docs in the columns of the table
``documents``, and returns what it keeps, in the same columns; the last returns
packed token pieces. ``run`` writes each stage's rows as Parquet to the shared
scratch folder and reads them again for the next.

In every stage columns beyond those of ``documents`` are left out, whatever
their names; an empty table gives an empty one; null lang, source or n_chars
change nothing but the source that a row is mixed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultgrid.llm import mixing, ngram_join, packing, quality_gam, substring_dedup
from vaultgrid.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document that keeps fewer words than this after its repeated passages go is left out.
LEAST_WORDS = 1
#: Near copies share this percentage of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1; it learns from the labelled ones.

    Null and empty texts are scored like any other; repeated rows go or stay
    together; a score of exactly 0.5 stays. Without labels all score alike.
    """
    model = quality_gam.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality_gam.with_quality(docs.select(*COLUMNS), model).where(F.col("predicted") == 1).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group: the one with the smallest id, an id before null.

    Wordless documents stay. A repeated row is a copy of itself and stays once,
    wordless ones too. Of different texts under the smallest id, one stays.
    """
    scratch = Scratch(spark, "copies")
    grouped = ngram_join.components(docs.select("doc_id", "text", F.xxhash64("text").alias("code")), k=NEAR_WORDS, percent=NEAR_PERCENT)
    first = grouped.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "code")).alias("x"))
    first = scratch.write(first.select(F.col("x.doc_id").alias("id"), F.col("x.code").alias("code")), "kept")
    kept = docs.select(*COLUMNS).join(first, docs["doc_id"].eqNullSafe(first["id"]) & (F.xxhash64(docs["text"]) == first["code"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that an earlier document has; emptied documents go.

    Null, empty and short texts stay as they are; a null id neither removes nor
    loses words; rows that repeat id and text do not remove each other. n_chars
    is counted anew where words went.
    """
    cut = substring_dedup.dedup_substrings(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = cut.where((F.col("n_words") - F.col("n_removed") >= LEAST_WORDS) | (F.col("n_removed") == 0))
    kept = kept.withColumn("text", text)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Null and wordless texts add no words, however often they are taken; a null
    source is a source; repeated rows are separate documents.
    """
    taken = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; a null text is empty, one token; repeated rows are separate documents."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", passages),
    ("entropy mixing", mixed),
    ("configuration packing", packed),
]

#: SQL cannot express the classifier or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
    return STAGES[-1][1](spark, docs, sf_dir)
