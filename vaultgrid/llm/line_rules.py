"""Quality rules with cross-document line frequency, on DataFrame functions only.

Base figures of a text: words, their code points, symbols, lines that repeat an
earlier line, words inside 3-word windows that occur twice or more. The last is
counted without a shuffle: the windows' 64-bit hashes are sorted with their
places, equal neighbours are kept, and the places they cover are summed.

Line frequency: a line is lower-cased, its digits become 0 and its white space
single spaces; its hash is counted once for each document of its host (here the
source). A line is above the limit if it stands in more than
``max(min_docs, max_share * documents of the host)`` documents. Such lines are
removed, and a document is rejected that keeps less than ``min_kept`` of its
words. Counts are partially aggregated before they are shuffled; the frequent
lines meet the documents over salted keys, so a line that a third of all
documents share is dealt to many tasks.

Nulls: a null text has no words, fails the base rules; a null source is a host;
a null id is carried. Repeated rows are separate documents. An empty table gives
an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, table

SPACE = r"[\x20\x09-\x0D]+"
#: A line above both is boilerplate.
MIN_DOCS, MAX_SHARE = 20, 0.2
#: Share of its words that a document must keep.
MIN_KEPT = 0.5
SALTS = 32


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """How many of the words stand in a 3-word window that occurs twice or more."""

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")))
        twice = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, counted))


def figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("__words", split_words(text)).withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": (F.length(F.array_join("__words", ""))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": repeated_words(F.col("__words")),
        }
    )
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return out.drop("__words").withColumn("base_failed", failed)


def document_lines(text: Column) -> Column:
    """Array of (hash, words) of the lines with a word."""
    norm = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[0-9]", "0"), SPACE, " "))
    made = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: let(norm(x), lambda y: F.struct(F.xxhash64(y).alias("line"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + F.when(y != "", 1).otherwise(0)).cast("long").alias("words"))))
    return F.filter(made, lambda x: x["words"] > 0)


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """The figures of each document, ``lines_removed``, ``words_removed`` and ``kept``."""
    scratch = Scratch(docs.sparkSession, "lines")
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    made = figures(given).withColumn("lines", document_lines(F.col("text"))).drop("text").withColumn("row", F.monotonically_increasing_id())
    base = scratch.write(made, "base")
    each = base.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    once = base.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    hosts = base.groupBy("host").agg(F.count("*").alias("docs"))
    often = once.groupBy("host", "line").agg(F.count("*").alias("in_docs")).where(F.col("in_docs") > min_docs)
    limit = F.greatest(F.lit(float(min_docs)), F.lit(float(max_share)) * F.col("docs"))
    often = often.alias("o").join(hosts.alias("h"), F.col("o.host").eqNullSafe(F.col("h.host"))).where(F.col("in_docs") > limit)
    often = often.select(F.col("o.host").alias("h"), F.col("o.line").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = each.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    hit = salted.join(often, (salted["line"] == often["l"]) & salted["host"].eqNullSafe(often["h"]) & (salted["salt"] == often["s"]))
    removed = hit.groupBy("row").agg(F.count("*").alias("lines_removed"), F.sum("words").alias("words_removed"))
    out = base.drop("lines").join(removed, "row", "left").fillna(0, ["lines_removed", "words_removed"])
    spent = F.col("words_removed") > (1 - min_kept) * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~spent).drop("row")


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "words_removed")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), a AS (
  SELECT r, doc_id, host, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS win FROM a, unnest(range(1, len(w) - 1)) AS u(i)
), g2 AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM g2, unnest([0, 1, 2]) AS v(k) GROUP BY r),
l AS (
  SELECT r, host, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM a, unnest(ls) AS v(x)
), h AS (SELECT host, count(*) AS docs FROM a GROUP BY host),
o AS (
  SELECT l.host, line FROM l JOIN h ON l.host IS NOT DISTINCT FROM h.host GROUP BY l.host, line, docs HAVING count(DISTINCT r) > greatest(20, 0.2 * docs)
), rm AS (
  SELECT r, count(*) AS lines_removed, sum(len(string_split(l.line, ' '))) AS words_removed FROM l JOIN o ON l.host IS NOT DISTINCT FROM o.host AND l.line = o.line GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
       (n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words) AND NOT coalesce(words_removed, 0) > 0.5 * n_words AS kept,
       coalesce(lines_removed, 0) AS lines_removed, CAST(coalesce(words_removed, 0) AS BIGINT) AS words_removed
FROM a LEFT JOIN cov USING (r) LEFT JOIN rm USING (r)
"""
