"""Queries of stateful streams, the registry's tables, artifacts and benchmark sheets, registered by import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry, views, whole
from ..operators.reach import Steps
from ..sources import artifacts
from ..streaming import stateful
from .catalog import query
from .estate import table

# ------------------------------------------------------------- streams, fed in two runs from one checkpoint


def _streamed(spark, rows, first, operator, result: str, keys: list[str], name: str):
    """The newest rows after a query was fed the rows where ``first`` holds, stopped, and fed the others."""
    steps = Steps(spark, name)
    feed, out, checkpoint = (f"{steps.root}/{n}" for n in ("feed", "out", "checkpoint"))
    for part in (rows.where(first), rows.where(~first)):
        part.write.mode("append").parquet(feed)
        stateful.run_once(operator(spark.readStream.schema(rows.schema).parquet(feed)), out, checkpoint).awaitTermination()
    return stateful.latest(spark, out, result, keys)


_ACTIONS = "a AS (SELECT 'u' || (user_id % 50) AS tx_id, event_id AS pos, CASE event_type WHEN 'click' THEN 'undo' WHEN 'purchase' THEN 'undo' WHEN 'view' THEN 'redo' WHEN 'signup' THEN 'redo' ELSE 'apply' END AS action FROM events)"


@query(
    f"""WITH RECURSIVE {_ACTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY pos) AS n FROM a),
    f AS (SELECT tx_id, CAST(0 AS BIGINT) AS n, true AS applied, 0 AS undone, 0 AS redone, 0 AS refused, CAST(-1 AS BIGINT) AS seen FROM (SELECT DISTINCT tx_id FROM a)
      UNION ALL SELECT f.tx_id, r.n, CASE WHEN action = 'undo' THEN false WHEN action = 'redo' THEN true ELSE applied END, undone + CAST(action = 'undo' AND applied AS INTEGER), redone + CAST(action = 'redo' AND NOT applied AS INTEGER),
        refused + CAST((action = 'undo' AND NOT applied) OR (action = 'redo' AND applied) AS INTEGER), pos FROM f JOIN r ON r.tx_id = f.tx_id AND r.n = f.n + 1)
    SELECT tx_id, CASE WHEN applied THEN 'APPLIED' ELSE 'REVERTED' END AS state, undone, redone, refused, seen FROM f QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY n DESC) = 1"""
)
def streamed_journal(spark, sf):
    """Undo and redo of each transaction folded over a stream that was stopped and restarted."""
    action = F.when(F.col("event_type").isin("click", "purchase"), "undo").when(F.col("event_type").isin("view", "signup"), "redo").otherwise("apply")
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("tx_id"), F.col("event_id").alias("pos"), action.alias("action"))
    half = e.agg(F.max("pos")).first()[0] // 2
    return _streamed(spark, e, F.col("pos") <= half, stateful.journals, stateful.JOURNAL, ["tx_id"], "journal")


@query("SELECT 's' || (user_id % 7) AS source, event_id AS id, event_type || ' ' || event_id AS line, CAST(row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS INTEGER) - CAST(greatest(0, count(*) OVER (PARTITION BY user_id % 7) - 25) AS INTEGER) AS n FROM events QUALIFY n > 0")
def streamed_tail(spark, sf):
    """The last 25 lines of each source, in whatever order they came."""
    e = table(spark, sf, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("source"), F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("line"))
    held = _streamed(spark, e, F.xxhash64("id") % 2 == 0, stateful.tails, stateful.TAILS, ["source"], "tail")
    pairs = F.from_json("lines", "array<array<string>>")
    lines = held.select("source", F.posexplode(pairs).alias("n", "x"))
    return lines.select("source", F.get("x", F.lit(0)).cast("long").alias("id"), F.get("x", F.lit(1)).alias("line"), (F.col("n") + 1).cast("int").alias("n"))


@query(
    """WITH e AS (SELECT 'c' || (user_id % 40) AS entity, ts, event_type AS version, lag(event_type) OVER (PARTITION BY user_id % 40 ORDER BY ts, event_type) AS before FROM events)
    SELECT entity, arg_max(version, {'t': ts, 'v': version}) AS version, CAST(count(*) FILTER (version <> before) AS INTEGER) AS changes FROM e GROUP BY 1"""
)
def streamed_versions(spark, sf):
    """Each entity's last version and how often it changed, over two runs."""
    e = table(spark, sf, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("entity"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("version"))
    half = e.select(F.timestamp_micros(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("long"))).first()[0]
    told = _streamed(spark, e, F.col("ts") <= F.lit(half), lambda s: stateful.versions(s, "10000 days"), stateful.VERSIONS, ["entity"], "versions")
    return told.select("entity", "version", "changes")


# ------------------------------------------------------------- the registry's tables


@query(
    """SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier) THEN 'COMPLETED' WHEN s_suppkey = (SELECT max(s_suppkey) FROM supplier) THEN 'SCANNING' ELSE 'IDLE' END AS status,
    CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier) THEN '2026-01-02' END AS last_scanned, CAST(CASE WHEN s_suppkey IN ((SELECT min(s_suppkey) FROM supplier), (SELECT max(s_suppkey) FROM supplier)) THEN 1 ELSE 0 END AS BIGINT) AS scans,
    CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier) THEN 7 END AS assets FROM supplier"""
)
def registry_life(spark, sf):
    """Empty tables, all suppliers entered as projects, one scan that began and ended, one that only began."""
    projects, history = registry.empty_tables(spark)
    s = table(spark, sf, "supplier")
    n = lambda t: F.lit(None).cast(t)
    new = s.select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"), F.col("s_name").alias("path"), F.lit("2026-01-01").alias("created_at"), n("string").alias("last_scanned"), F.lit(False).alias("auto_scan"), n("int").alias("scans_per_day"), F.lit("IDLE").alias("status"))
    projects = registry.upsert(projects, new)
    low, high = s.agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    projects, history = registry.begun(projects, history, low, 1, "2026-01-01")
    projects, history = registry.ended(projects, history, 1, "2026-01-02", "COMPLETED", 7, 2)
    projects, history = registry.begun(projects, history, high, 2, "2026-01-03")
    scans = history.groupBy(F.col("project_id").alias("__p")).agg(F.count("*").alias("scans"), F.max("assets").cast("int").alias("assets"))
    joined = projects.join(scans, F.col("id") == F.col("__p"), "left")
    return joined.select("id", "name", "status", "last_scanned", F.coalesce("scans", F.lit(0)).alias("scans"), "assets")


# ------------------------------------------------------------- documents of earlier scans


@query("SELECT 'p' || s_suppkey AS project, s_suppkey % 9 AS assets, s_nationkey AS critical FROM supplier WHERE s_suppkey % 4 <> 3 AND s_suppkey % 8 <> 5")
def report_folders(spark, sf):
    """Documents found by name; a quarter are other documents, some are no JSON."""
    steps = Steps(spark, "reports")
    k = F.col("s_suppkey")
    name = F.concat(F.lit("p"), k.cast("string"), F.when(k % 4 == 3, "_other.json").otherwise("_bill.json"))
    text = F.when(k % 8 == 5, F.concat(F.lit("no JSON "), k.cast("string"))).otherwise(F.to_json(F.struct((k % 9).alias("assets"), F.col("s_nationkey").alias("critical"))))
    steps.write(whole.write_each(table(spark, sf, "supplier").select(name.alias("name"), text.alias("document")), f"{steps.root}/reports"), "told")
    read = spark.read.schema("assets long, critical long").option("pathGlobFilter", "*_bill.json").json(f"{steps.root}/reports")
    return read.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_bill\.json$", 1).alias("project"), "assets", "critical").where("assets IS NOT NULL")


_SHEET = """s AS (SELECT p_partkey AS line_no, p_partkey // 20 AS sheet, CASE WHEN p_partkey % 20 IN (0, 7) THEN ' T' || (p_partkey % 20) || ' ' ELSE '' END AS tier, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE 'case' || p_partkey END AS name, p_partkey % 3 AS files, ['yes', 'No', '', 'TRUE'][p_partkey % 4 + 1] AS expected FROM part)"""


@query(
    f"""WITH {_SHEET}, t AS (SELECT *, last_value(nullif(trim(tier), '') IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY line_no) AS held FROM s), e AS (SELECT sheet, held AS tier, name, unnest([name || '/' || i || '.java' FOR i IN range(0, files + 1)]) AS file, lower(expected) IN ('yes', 'true') AS vulnerable, line_no FROM t WHERE name <> ''),
    f AS (SELECT *, line_no % 2 = 0 AND NOT contains(file, '/2') AS found FROM e)
    SELECT tier, count(*) FILTER (vulnerable AND found) AS tp, count(*) FILTER (NOT vulnerable AND found) AS fp, count(*) FILTER (NOT vulnerable AND NOT found) AS tn, count(*) FILTER (vulnerable AND NOT found) AS fn FROM f GROUP BY 1"""
)
def benchmark_files(spark, sf):
    """A benchmark's sheet with tiers written once and many files in a cell, against the files that have findings."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 4, "").otherwise(F.concat(F.lit("case"), k.cast("string")))
    paths = F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda i: F.concat(name, F.lit("/"), i.cast("string"), F.lit(".java")))
    sheet = table(spark, sf, "part").select(
        k.alias("line_no"), F.floor(k / 20).alias("sheet"), F.when((k % 20).isin(0, 7), F.concat(F.lit(" T"), (k % 20).cast("string"), F.lit(" "))).otherwise("").alias("tier"), name.alias("case"),
        F.array_join(paths, " ; \n").alias("files"), F.get(F.array(*[F.lit(x) for x in ("yes", "No", "", "TRUE")]), (k % 4).cast("int")).alias("expected"),
    )
    truth = artifacts.ground_truth(sheet)
    found = table(spark, sf, "part").where(k % 2 == 0).select(F.explode(F.array(*[F.concat(F.lit("case"), k.cast("string"), F.lit(f"/{i}.java")) for i in range(2)])).alias("__file"))
    met = truth.join(found, F.col("file") == F.col("__file"), "left").withColumn("found", F.col("__file").isNotNull())
    of = lambda v, f: F.count_if((F.col("vulnerable") if v else ~F.col("vulnerable")) & (F.col("found") if f else ~F.col("found")))
    return met.groupBy("tier").agg(of(True, True).alias("tp"), of(False, True).alias("fp"), of(False, False).alias("tn"), of(True, False).alias("fn"))


@query("SELECT 'n' || p_partkey AS node_id FROM part WHERE p_size % 3 <> 0 AND p_size % 2 = 0 AND contains(lower(p_name || ' ' || 'n' || p_partkey || ' ' || p_brand), 'a')")
def graph_list(spark, sf):
    """Nodes of a network with cryptography that are no superspreaders, by a search over names."""
    p = table(spark, sf, "part")
    rows = p.select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_name").alias("label"), F.col("p_brand").alias("file_path"), (F.col("p_size") % 3 == 0).alias("superspreader"), (F.col("p_size") % 2 == 0).alias("has_crypto"), F.lit(False).alias("anchor"))
    return views.nodes(rows, "HIGH", "a").select("node_id")
