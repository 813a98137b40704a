"""Project registry as tables: upsert, partial update, cascade, history, schedule, rewrite journal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .reach import Steps

KEPT_ON_UPDATE = ("created_at", "status")


def upsert(current: DataFrame, changes: DataFrame, key: str = "id", kept: tuple[str, ...] = KEPT_ON_UPDATE) -> DataFrame:
    """Changes win, except in ``kept`` columns of rows that are there; of several changes of a key the greatest by its columns in order counts."""
    rest = [c for c in current.columns if c != key]
    changes = changes.groupBy(key).agg(F.max(F.struct(*rest)).alias("__x")).select(key, *[F.col(f"__x.{c}").alias(c) for c in rest])
    new = changes.select(*[F.col(c).alias(f"__{c}") for c in current.columns])
    j = current.join(new, current[key] == new[f"__{key}"], "full_outer")
    there = F.col(key).isNotNull()
    pick = lambda c: F.when(there & (F.col(f"__{key}").isNull() | F.lit(c in kept)), F.col(c)).otherwise(F.col(f"__{c}"))
    return j.select(*[pick(c).alias(c) for c in current.columns])


#: The registry's tables.
PROJECTS = "id long, name string, path string, created_at string, last_scanned string, auto_scan boolean, scans_per_day int, status string"
HISTORY = "id long, project_id long, started_at string, finished_at string, status string, assets long, critical long"


def empty_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], PROJECTS), spark.createDataFrame([], HISTORY)


def begun(projects: DataFrame, history: DataFrame, project, scan_id: int, at: str) -> tuple[DataFrame, DataFrame]:
    """Both tables after a scan of a project began."""
    row = history.sparkSession.createDataFrame([(scan_id, project, at, None, "SCANNING", None, None)], HISTORY)
    return update(projects, "id", project, {"status": "SCANNING"}, {"status"}), history.unionByName(row)


def ended(projects: DataFrame, history: DataFrame, scan_id: int, at: str, status: str, assets: int, critical: int) -> tuple[DataFrame, DataFrame]:
    """Both tables after a scan ended; its project gets the status and the time."""
    done = update(history, "id", scan_id, {"finished_at": at, "status": status, "assets": assets, "critical": critical}, {"finished_at", "status", "assets", "critical"})
    of = done.where(F.col("id") == scan_id).select(F.col("project_id").alias("__p"))  # one row
    p = projects.join(F.broadcast(of), F.col("id") == F.col("__p"), "left")
    mine = F.col("__p").isNotNull()
    p = p.withColumns({"status": F.when(mine, F.lit(status)).otherwise(F.col("status")), "last_scanned": F.when(mine, F.lit(at)).otherwise(F.col("last_scanned"))})
    return p.drop("__p"), done


def changed(before: DataFrame, after: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version) of rows that are new or whose version moved on since ``before``."""
    old = before.select(F.col(key).alias("__k"), F.col(version).alias("__v"))
    j = after.join(old, F.col(key) == F.col("__k"), "left")
    return j.where(F.col("__k").isNull() | ~F.col(version).eqNullSafe(F.col("__v"))).select(key, version)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``seq`` from 1 in a total order: range-sorted, then each row's place in its partition plus the sizes of those before it."""
    spark = df.sparkSession
    # written, so that both reads below see the same places
    placed = Steps(spark, "numbered").write(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__p", before.alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(sizes), part == F.col("__p")).withColumn("seq", F.col("__before") + inside + 1).drop("__at", "__p", "__before")


def newest(projects: DataFrame, by: str, n: int) -> DataFrame:
    return projects.orderBy(F.desc(by), "id").limit(n)


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def with_scans(projects: DataFrame, scans: DataFrame) -> DataFrame:
    """Projects with the status of their last scan and how many there are; one without scans keeps its own."""
    last = scans.groupBy(F.col("project_id").alias("__id")).agg(F.max_by("status", "scan_id").alias("__status"), F.count("*").alias("scans"))
    return projects.join(last, F.col("id") == F.col("__id"), "left").select("id", F.coalesce("__status", "status").alias("status"), F.coalesce("scans", F.lit(0)).cast("long").alias("scans"))


def advisories(packages: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """Packages with the first CVE alias that the advisory feed (key, alias) has for them."""
    first = feed.where(F.col("alias").startswith("CVE-")).groupBy(key).agg(F.min("alias").alias("cve_id"))
    return packages.join(first, key, "left")


def update(current: DataFrame, key: str, value, changes: dict, allowed: set[str]) -> DataFrame:
    bad = set(changes) - allowed
    if bad:
        raise ValueError(f"not to be updated: {sorted(bad)}")
    return current.withColumns({c: F.when(F.col(key) == value, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def cascade_delete(projects: DataFrame, history: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return projects.join(gone, "id", "left_anti"), history.join(gone.withColumnRenamed("id", "project_id"), "project_id", "left_anti")


def latest(history: DataFrame, n: int, by: str = "project_id") -> DataFrame:
    at = F.row_number().over(W.partitionBy(by).orderBy(F.desc("started_at"), F.desc("id")))
    return history.withColumn("nth", at).where(F.col("nth") <= n)


def due(projects: DataFrame, now: Column) -> DataFrame:
    """Projects whose last scan is at least a day divided by their scans a day ago."""
    gap = F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("last_scanned"))
    return projects.where(F.col("auto_scan") & (F.col("last_scanned").isNull() | (gap >= 86400 / F.greatest("scans_per_day", F.lit(1)))))


def replaced(content: Column, pairs: list[tuple[str, str]]) -> Column:
    """Struct of the text after all literal pairs in order, and how many places changed."""
    text, changes = content, F.lit(0)
    for old, new in pairs:
        hits = ((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("int")
        changes, text = changes + hits, F.replace(text, F.lit(old), F.lit(new))
    return F.struct(text.alias("text"), changes.alias("changes"))


def patches(files: DataFrame, rules: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """A dry run: for each file and rule that changes it, the new text, the count and both checksums."""
    made = [files.select("path", "content", F.lit(name).alias("rule"), replaced(F.col("content"), pairs).alias("r")) for name, pairs in rules]
    all_ = reduce(lambda a, b: a.unionByName(b), made).where("r.changes > 0")
    return all_.select("path", "rule", "r.changes", F.col("r.text").alias("patched"), F.sha2("content", 256).alias("sha_before"), F.sha2("r.text", 256).alias("sha_after"))


def line_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Positional diff of (path, content) pairs: lines that differ at the same number."""
    lines = lambda d, c: d.select("path", F.posexplode(F.split("content", "\n")).alias("n", c))
    j = lines(before, "old").join(lines(after, "new"), ["path", "n"], "full_outer")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", (F.col("n") + 1).alias("line_no"), "old", "new")


def journal_state(journal: DataFrame, actions: DataFrame) -> DataFrame:
    """State of each transaction after all its undos and redos, refused where the last is out of turn or the file's checksum moved on.

    ``journal``: tx_id, sha_before, sha_after, sha_now; ``actions``: tx_id, pos,
    action. An undo needs an applied transaction and a redo a reverted one;
    actions out of turn before the last change nothing.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct("pos", "action"))), lambda x: x["action"])
    turned = actions.groupBy("tx_id").agg(steps.alias("steps"))
    j = journal.join(turned, "tx_id", "left").withColumn("action", F.element_at("steps", -1))
    turn = lambda on, a: F.when(on & (a == "undo"), False).when(~on & (a == "redo"), True).otherwise(on)
    on = F.aggregate(F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0))), F.lit(True), turn)
    state = (
        F.when(F.col("action").isNull(), "APPLIED")
        .when((F.col("action") == "redo") & ~on & (F.col("sha_now") == F.col("sha_before")), "APPLIED")
        .when((F.col("action") == "undo") & on & (F.col("sha_now") == F.col("sha_after")), "REVERTED")
        .otherwise("REFUSED")
    )
    return j.select("tx_id", "action", state.alias("state"))
