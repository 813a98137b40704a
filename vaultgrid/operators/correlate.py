"""First-match joins: of all rows that match, the one first in order wins.

Matches are expressed as equi keys wherever the rule allows; a substring rule
joins a dimension that is broadcast only within a counted bound, and beyond it
the operator refuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a dimension that may be broadcast.
SMALL = 20_000


def first_match(left: DataFrame, right: DataFrame, on: Column, key: str, order: list[str], how: str = "left") -> DataFrame:
    """Rows of ``left`` (unique ``key``), each with the first matching row of ``right``."""
    joined = left.join(right, on, how)
    at = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    return joined.withColumn("__at", at).where("__at = 1").drop("__at")


def band_join(left: DataFrame, right: DataFrame, file: str, line: str, other_line: str, width: int, key: str, order: list[str]) -> DataFrame:
    """Left rows with the first right row of the same file within ``width`` lines.

    Lines fall into buckets of ``width + 1``; a right row is sent to its bucket and
    both neighbours, so the join has two equi keys however many rows a file has.
    """
    size = width + 1
    cut = F.floor(F.col(line) / size)
    spread = F.explode(F.array(*[F.floor(F.col(other_line) / size) + F.lit(d) for d in (-1, 0, 1)]))
    r = right.withColumn("__bucket", spread).withColumnRenamed(file, "__file")
    l = left.withColumn("__b", cut)  # noqa: E741
    on = (l[file] == r["__file"]) & (l["__b"] == r["__bucket"]) & (F.abs(l[line] - r[other_line]) <= width)
    return first_match(l, r, on, key, order).drop("__b", "__bucket", "__file")


#: Letters of a variable by which it meets the codes that hold it.
STEM = 3


def pieces(code: Column) -> Column:
    """All distinct runs of one to ``STEM`` characters of a text."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length(code) - n + 1), lambda i: F.substring(code, i, F.lit(n)))
    return F.array_distinct(F.concat(*[F.when(F.length(code) >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, STEM + 1)]))


def first_inference(assets: DataFrame, inferences: DataFrame, line: str, variable: str, order: str, width: int = 5) -> DataFrame:
    """Assets, each with the first inference of its file that is within ``width`` lines or whose variable stands in the matched code.

    Both rules are joins of keys: lines meet by buckets, and variables, of each
    file's of one name only the first, by their first letters with the pieces of
    the codes. So a file with very many of both costs no product of the two.
    """
    rest = [c for c in inferences.columns if c not in (order, "file_path")]
    row = F.struct(order, *rest)
    size = width + 1
    spread = F.explode(F.array(*[F.floor(F.col(line) / size) + F.lit(d) for d in (-1, 0, 1)]))
    at = inferences.select(F.col("file_path").alias("__file"), spread.alias("__bucket"), F.col(line).alias("__line"), row.alias("__x"))
    a = assets.select("asset_id", "file_path", "line_number", "matched_code", F.floor(F.col("line_number") / size).alias("__b"))
    near = a.join(at, (F.col("file_path") == F.col("__file")) & (F.col("__b") == F.col("__bucket")) & (F.abs(F.col("line_number") - F.col("__line")) <= width)).select("asset_id", "__x")
    first = inferences.where(F.col(variable) != "").groupBy(F.col("file_path").alias("__file"), F.col(variable).alias("__name")).agg(F.min(row).alias("__x")).withColumn("__stem", F.left("__name", F.lit(STEM)))
    codes = a.select("asset_id", "file_path", "matched_code", F.explode(pieces(F.col("matched_code"))).alias("__piece"))
    named = codes.join(first, (F.col("file_path") == F.col("__file")) & (F.col("__piece") == F.col("__stem")) & F.contains("matched_code", "__name")).select("asset_id", "__x")
    met = near.unionByName(named).groupBy(F.col("asset_id").alias("__id")).agg(F.min("__x").alias("__x"))
    return assets.join(met, F.col("asset_id") == F.col("__id"), "left").select(*assets.columns, *[F.col(f"__x.{c}").alias(c) for c in (order, *rest)])


def contained_first(left: DataFrame, dim: DataFrame, texts: list[str], word: str, key: str, order: str, bound: int = SMALL) -> DataFrame:
    """Left rows with the first dimension row whose ``word`` stands in one of the texts."""
    n = dim.count()
    if n > bound:
        raise ValueError(f"{n} rows to look for in texts; the bound is {bound}")
    on = None
    for t in texts:
        one = F.contains(F.lower(left[t]), F.lower(dim[word]))
        on = one if on is None else on | one
    return first_match(left, F.broadcast(dim), on, key, [order])


def longest_contained(left: DataFrame, dim: DataFrame, text: str, word: str, key: str) -> DataFrame:
    """Exact match first, else the longest word contained (ties by the word)."""
    n = dim.count()
    if n > SMALL:
        raise ValueError(f"{n} rows to look for in texts; the bound is {SMALL}")
    d = F.broadcast(dim)
    exact = left.join(d, left[text] == dim[word], "left")
    rest = exact.where(F.col(word).isNull()).select(*left.columns)
    loose = rest.join(d, F.contains(rest[text], dim[word]), "left")
    at = F.row_number().over(W.partitionBy(key).orderBy(F.length(word).desc_nulls_last(), F.col(word).asc_nulls_last()))
    loose = loose.withColumn("__at", at).where("__at = 1").drop("__at")
    return exact.where(F.col(word).isNotNull()).unionByName(loose)


def family(algorithm: Column) -> Column:
    a = F.upper(algorithm)
    c = lambda x: F.contains(a, F.lit(x))
    return F.when(c("AES"), "AES").when(c("RSA"), "RSA").when(c("DES"), "DES").when(c("SHA") | c("MD5") | c("DIGEST"), "DIGEST")


def runtime_match(runtime: DataFrame, static: DataFrame) -> DataFrame:
    """Runtime rows (run_seq, algorithm, primitive_type) with the first static row of their family and role.

    Rows without a family match on the exact name. Several runtime rows may meet
    one static row; a row without partner keeps nulls.
    """
    key = lambda a: F.coalesce(family(a), F.upper(a))
    s = static.groupBy(key(F.col("algorithm")).alias("__k"), F.col("primitive_type").alias("__p")).agg(F.min_by(F.struct("asset_seq", "asset_id"), "asset_seq").alias("first"))
    r = runtime.withColumn("__key", key(F.col("algorithm")))
    return r.join(s, (r["__key"] == s["__k"]) & (r["primitive_type"] == s["__p"]), "left").select(*runtime.columns, F.col("first.asset_id").alias("asset_id"), F.col("first.asset_seq").alias("asset_seq"))


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in order (grouped, so it is combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__x"))
    return grouped.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])
