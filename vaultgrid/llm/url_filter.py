"""URL filter by Bloom filter cascades, on DataFrame functions only.

A rule is a host and a path prefix, written together (``example.com/en/``). It
fits its host and all subdomains where the url's path starts with the rule's;
of the rules that fit, the longest wins (longer host first among equal lengths).

Each url spells out the keys that could be rules: every host suffix with every
path prefix of a length that some rule has. Those keys, over the whole corpus,
are the universe. One cascade holds the block rules, one the allow rules: level
1 is a Bloom filter of the listed keys, level 2 one of the universe's keys that
level 1 accepts wrongly, level 3 one of the listed keys that level 2 accepts,
and so on until nothing is wrong. Over that universe membership is then exact,
and urls are judged by bit tests, without joins.

Sizes: level 1 takes about 1.44 * log2(universe / listed) bits a listed key, and
later levels encode fewer keys than are listed, so a cascade is bounded by the
list, which is a driver-side list of at most ``max_rules``.

Nulls, or urls without ``://``: empty host and path, no rule, verdict ``allow``.
Repeated rows are judged alike; an empty table gives an empty result; columns
other than the id and the url are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def split_url(url: Column) -> Column:
    """Struct of host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.coalesce(F.substr(url, F.length(rest) + F.lit(4)), F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.struct(F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix with every path prefix of a given length."""
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths]), lambda p: p.isNotNull())
    return let(
        F.split(host, r"\."),
        lambda labels: F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda i: F.transform(prefixes, lambda p: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), p)),
            )
        ),
    )


class Level:
    """A Bloom filter: ``m`` bits in 64-bit words, ``k`` tests, its own seed."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        self.m = max(64, 64 * math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / 64))
        self.k = max(1, round(self.m / max(n, 1) * math.log(2)))
        self.k = min(self.k, max(1, math.ceil(math.log2(1 / rate))))
        self.seed = seed
        at = keys.select(F.explode(self.places(F.col("key"))).alias("at"))
        word = at.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
        words = [0] * (self.m // 64)
        for w, bits in word.collect():
            words[w] = bits
        self.bits = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

    def places(self, key: Column) -> Column:
        a, b = F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(self.m)), F.pmod(F.xxhash64(F.lit(self.seed), key), F.lit(self.m))
        return F.transform(F.array(*[F.lit(i).cast("long") for i in range(self.k)]), lambda i: F.pmod(a + i * b, F.lit(self.m)))

    def has(self, key: Column) -> Column:
        return F.forall(self.places(key), lambda at: F.call_function("shiftright", F.get(self.bits, (at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)


class Cascade:
    """Exact membership of ``listed`` keys over ``universe`` (column ``key``)."""

    def __init__(self, spark: SparkSession, listed: list[str], universe: DataFrame, universe_size: int, scratch: Scratch, name: str, max_levels: int = 64):
        self.levels: list[Level] = []
        if not listed:
            return
        keys = spark.createDataFrame([(x,) for x in listed], "key string")
        rate = min(0.5, math.sqrt(0.5) * len(listed) / max(1, universe_size))
        level = Level(keys, len(listed), rate, 0)
        self.levels.append(level)
        others = universe.where(level.has(F.col("key"))).distinct().join(F.broadcast(keys), "key", "left_anti")
        encoded, tested = scratch.write(others, name), keys
        while n := encoded.count():
            if len(self.levels) >= max_levels:
                raise RuntimeError("the cascade does not end; the hash seeds collide")
            level = Level(encoded, n, 0.5, len(self.levels))
            self.levels.append(level)
            encoded, tested = tested.where(level.has(F.col("key"))), encoded

    def has(self, key: Column) -> Column:
        accepted: Column = F.lit(False)
        for level in reversed(self.levels):
            accepted = level.has(key) & ~accepted
        return accepted


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", max_rules: int = 200_000) -> DataFrame:
    """(id, host, path, rule, verdict) of every url."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the filter is sized for {max_rules}")
    spark = pages.sparkSession
    listed = {v: sorted({h.translate(str.maketrans(UPPER, LOWER)) + p for w, h, p in rules if w == v}) for v in ("allow", "block")}
    lengths = sorted({len(p) for _, _, p in rules})
    u = pages.select(F.col(id_col), split_url(F.col(url_col)).alias("u")).select(id_col, "u.host", "u.path")
    u = u.withColumn("keys", F.when(F.col("host") != "", candidate_keys(F.col("host"), F.col("path"), lengths)).otherwise(F.array().cast("array<string>")))
    scratch = Scratch(spark, "urls")
    universe = u.select(F.explode("keys").alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    both = spark.createDataFrame([(x,) for v in listed.values() for x in v], "key string")
    cascades = {v: Cascade(spark, keys, universe.unionByName(both), size, scratch, v) for v, keys in listed.items()}
    hit = F.transform(
        F.col("keys"),
        lambda k: F.struct(F.length(k).alias("n"), F.instr(F.concat(k, F.lit("/")), "/").alias("h"), k.alias("key"), F.when(cascades["block"].has(k), F.lit("block")).when(cascades["allow"].has(k), F.lit("allow")).alias("verdict")),
    )
    best = F.array_max(F.filter(hit, lambda x: x["verdict"].isNotNull()))
    return u.withColumn("best", best).select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), RULES)


OP2_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), r(v, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT u.*, v, h || p AS rule FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""
