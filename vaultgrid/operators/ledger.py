"""What a scan could not see, and how the asset streams come together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules

# --- fixed values: directories and suffixes that a scan leaves out, and how many ledger rows are kept
BOUNDARY_DIRS = [
    "venv", ".venv", "env", "node_modules", "site-packages", "__pycache__", ".git", "dist", "build", "target", ".cache",
    ".agents", ".gemini", ".antigravity", ".codex", ".superpowers", "agents",
]
BINARY_SUFFIXES = [".so", ".dll", ".exe", ".bin", ".dylib", ".dat", ".class", ".o", ".a"]
KEYSTORE_SUFFIXES = [".p12", ".pfx", ".jks", ".keystore"]
MOST_BOUNDARIES, MOST_UNKNOWNS = 100, 150


def suffix(path: Column) -> Column:
    name = F.element_at(rules.path_parts(path), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def boundary(path: Column, is_dir: Column) -> Column:
    """EXCLUDED_DIR, UNINSPECTED_BINARY, ENCRYPTED_KEYSTORE or null."""
    parts = rules.path_parts(path)
    denied = F.array(*[F.lit(d) for d in BOUNDARY_DIRS])
    clear = ~F.arrays_overlap(parts, denied)
    return (
        F.when(is_dir, F.when(F.array_contains(denied, F.element_at(parts, -1)), "EXCLUDED_DIR"))
        .when(clear & suffix(path).isin(BINARY_SUFFIXES), "UNINSPECTED_BINARY")
        .when(clear & suffix(path).isin(KEYSTORE_SUFFIXES), "ENCRYPTED_KEYSTORE")
    )


def first_rows(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first ``most`` rows in order, as the ledger keeps them: a top-k, no total sort."""
    return df.orderBy(*order).limit(most)


def boundaries(paths: DataFrame, most: int = MOST_BOUNDARIES) -> DataFrame:
    """(item_path, category) of the first ``most`` boundaries by path."""
    found = paths.select(F.col("path").alias("item_path"), boundary(F.col("path"), F.col("is_dir")).alias("category")).where("category IS NOT NULL").distinct()
    return first_rows(found, ["item_path"], most)


def unconfirmed(inferences: DataFrame, matched: DataFrame, key: str, used: int, most: int = MOST_UNKNOWNS) -> DataFrame:
    """(item_path, category) of inferences that no asset chose, as many as the ledger still holds."""
    rest = inferences.join(matched.select(key).distinct(), key, "left_anti")
    item = F.concat_ws(":", "file_path", F.col("line_number").cast("string"))
    return first_rows(rest, [key], max(0, most - used)).select(item.alias("item_path"), F.lit("UNCONFIRMED_DATAFLOW").alias("category"))


def united(streams: list[DataFrame], order: list[str], scratch_rank) -> DataFrame:
    """Asset streams one after the other, each in its order, with ``seq`` from 1 and the stream's number."""
    named = [s.withColumn("stream", F.lit(i)) for i, s in enumerate(streams)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return scratch_rank(both, [F.col("stream"), *[F.col(c) for c in order]])


def merged(first: DataFrame, later: DataFrame, key: str, place: str) -> DataFrame:
    """Maps as rows (key, place, values): a later entry overrides, but keeps the place of the first."""
    both = first.withColumn("__turn", F.lit(0)).unionByName(later.withColumn("__turn", F.lit(1)))
    rest = [c for c in first.columns if c not in (key, place)]
    order = F.struct("__turn", place)
    out = both.groupBy(key).agg(F.min(order).alias("__first"), F.max(F.struct(order.alias("o"), *rest)).alias("__last"))
    return out.select(key, F.col("__first.__turn").alias("map_no"), F.col(f"__first.{place}").alias(place), *[F.col(f"__last.{c}").alias(c) for c in rest])


def exposed(assets: DataFrame, services: DataFrame, key: str = "asset_id", bound: int = 20_000) -> DataFrame:
    """Assets with the exposure of the first service (ord, service, exposure, capture) named in component or path.

    Hyphens do not count in components. Without a match, a profile that all
    services share goes to every asset; else the asset keeps its own.
    """
    n, profiles = services.agg(F.count("*"), F.countDistinct("exposure")).first()
    if n > bound:
        raise ValueError(f"{n} services; the bound is {bound}")
    s, c, p = F.lower(services["service"]), F.lower(assets["component_name"]), F.lower(assets["file_path"])
    hit = F.contains(c, s) | F.contains(p, s) | F.contains(F.replace(c, F.lit("-"), F.lit("")), F.replace(s, F.lit("-"), F.lit("")))
    met = assets.join(F.broadcast(services), hit).groupBy(assets[key]).agg(F.min(F.struct("ord", "service", "exposure", "capture")).alias("__s"))
    out = assets.join(met.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left").drop("__key")
    whole = services.agg(F.min_by(F.struct("exposure", "capture"), "ord").alias("__all")) if profiles == 1 else None
    if whole is not None:
        out = out.crossJoin(F.broadcast(whole))  # one row
    else:
        out = out.withColumn("__all", F.lit(None).cast("struct<exposure:string,capture:double>"))
    return out.withColumns(
        {
            "service": F.col("__s.service"),
            "exposure_profile": F.coalesce("__s.exposure", "__all.exposure", "exposure_profile"),
            "p_hndl": F.coalesce("__s.capture", "__all.capture", "p_hndl"),
        }
    ).drop("__s", "__all")
