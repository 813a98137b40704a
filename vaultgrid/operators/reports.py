"""Whole documents: attested components, finding runs, graphs, reports and registries as rows of text.

What grows with the estate is a row for each component, node or asset, written by
all tasks; only headers, totals and rankings of fixed length are one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: names of the agility levels, the effort left at each, and node colours by class
AGILITY = ["RIGID", "CONFIGURABLE", "PROVIDER", "RUNTIME_AGILE", "ORCHESTRATED", "QUANTUM_AGILE"]
LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "MANUAL_REVIEW_REQUIRED"]


def execution_status(evidence: Column) -> Column:
    return F.when(evidence == "E4_RUNTIME_OBSERVED", "ACTIVE").when(evidence == "E3_CONFIG_CONFIRMED", "CONFIG_CONFIRMED").when(evidence == "DORMANT", "DORMANT").otherwise("STATIC_REACHABLE")


def attested(assets: DataFrame) -> DataFrame:
    """(asset_seq, line): each component with its attestation: reachability, lifetime, runtime status, exposure, agility, route."""
    name = F.element_at(F.array(*[F.lit(a) for a in AGILITY]), F.col("agility_level") + 1)
    attestation = F.struct(
        F.struct(F.col("evidence_level").alias("evidenceLevel"), F.concat_ws(":", "file_path", F.col("line_number").cast("string")).alias("callLocation"), F.col("intent_class").alias("intentClassification")).alias("reachabilityProof"),
        F.struct(F.col("x_tier").alias("lifespanTier"), F.col("x_years_effective").alias("effectiveSecrecyYears"), F.col("has_crypto_shredding").alias("cryptoShreddingActive")).alias("dataLifetime"),
        execution_status(F.col("evidence_level")).alias("runtimeExecutionStatus"),
        F.struct(F.col("exposure_profile").alias("exposureProfile"), F.col("p_hndl").alias("pHndlInterceptionFactor"), F.when(F.col("p_hndl") >= 0.8, "CRITICAL_HARVEST_TARGET").otherwise("INTERNAL_DEFENDED").alias("harvestRiskCategory")).alias("adversarialExposure"),
        F.struct(F.col("agility_level").alias("agilityLevel"), name.alias("agilityClassification"), F.col("agility_factor").alias("camsDiscountFactor")).alias("camsMaturity"),
    )
    scope = F.when(F.col("scope") == "PRODUCTION", "required").otherwise("optional")
    return assets.select("asset_seq", F.to_json(F.struct(F.col("asset_id").alias("bom-ref"), scope.alias("scope"), F.struct(attestation.alias("discussion966")).alias("cdxAttestation"))).alias("line"))


def finding_run(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """One row: the run's header with its rules, levels and number of results; the results are lines of their own."""
    rules = findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if(F.col("report_level") == "error").alias("errors"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"), F.col("n").alias("results"), "errors")))
    run = rules.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("results"), listed.alias("rules"))  # as many rows as there are rules
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules").alias("rules"))
    return run.select("results", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results").alias("resultCount")).alias("run"))).alias("document"))


def node_encoding(kind: Column, r0: Column) -> Column:
    """Colour, size and group of a node by its class and reach."""
    colour = F.when(kind == "SUPERSPREADER", "red").when(kind == "CRYPTO", "orange").when(kind.isin("ANCHOR", "SAFE"), "green").when(kind == "INTERMEDIARY", "blue").otherwise("grey")
    size = F.least(F.lit(40), F.lit(10) + 2 * r0).cast("int")
    return F.struct(colour.alias("color"), size.alias("size"), F.lower(kind).alias("group"))


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, line): a JSON line for each node and each link."""
    code = node_encoding(F.col("node_class"), F.col("r0"))
    a = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.to_json(F.struct(F.col("node_id").alias("id"), "r0", code["color"].alias("color"), code["size"].alias("size"), code["group"].alias("group"))).alias("line"))
    b = edges.select(F.lit("link").alias("kind"), F.concat("src", F.lit("->"), "dst").alias("id"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"))).alias("line"))
    return a.unionByName(b)


def portfolio_documents(items: DataFrame, by: str) -> DataFrame:
    """Each portfolio as one document: totals, and its best ten items."""
    row = F.struct((-F.col("efficiency")).alias("e"), "asset_seq", "asset_id", "delta_r", "cost_dev_weeks")
    ranked = items.groupBy(by).agg(
        F.count("*").alias("items"), F.sum(F.col("delta_r").cast("decimal(18,2)")).cast("double").alias("risk"), F.sum(F.col("cost_dev_weeks").cast("decimal(18,2)")).cast("double").alias("weeks"),
        F.count_if(F.col("is_selected")).alias("selected"), F.min_by(F.col("asset_id"), row).alias("best"),
    )
    return ranked.select(by, F.to_json(F.struct("items", "selected", "risk", "weeks", "best")).alias("document"))


def table_lines(rows: DataFrame, columns: list[str], order: list[Column], first: int, limit: int) -> DataFrame:
    """(n, line) of a Markdown table of at most ``limit`` rows, numbered from ``first``."""
    from pyspark.sql import Window as W

    shown = rows.orderBy(*order).limit(limit)
    n = F.row_number().over(W.orderBy(*order)) + first + 1
    body = shown.select(n.alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))
    head = [(first, "| " + " | ".join(columns) + " |"), (first + 1, "|" + "---|" * len(columns))]
    return rows.sparkSession.createDataFrame(head, "n int, line string").unionByName(body.withColumn("n", F.col("n").cast("int")))


def executive_report(scores: DataFrame, title: str, limit: int = 15) -> DataFrame:
    """(n, line) of the Markdown report: totals, levels, and the assets of least runway."""
    counts = scores.agg(F.count("*").alias("assets"), *[F.count_if(F.col("risk_level") == level).alias(level) for level in LEVELS])
    lines = [F.lit(f"# {title}"), F.lit(""), F.format_string("Assets: %d", "assets"), *[F.format_string(f"- {level}: %d", level) for level in LEVELS], F.lit(""), F.lit("## Least runway"), F.lit("")]
    head = counts.select(F.posexplode(F.array(*lines)).alias("n", "line"))
    rest = table_lines(scores, ["asset_id", "algorithm", "risk_level", "y_max_years"], [F.col("y_max_years"), F.col("asset_seq")], len(lines), limit)
    return head.unionByName(rest)


def detection_report(ratios: DataFrame, by: list[str]) -> DataFrame:
    """(n, line) of a Markdown table of detection figures, a row for each group."""
    shown = ratios.withColumn("group", F.concat_ws("/", *by))
    return table_lines(shown, ["group", "tp", "fp", "tn", "fn", "precision", "recall"], [F.col("level"), *[F.col(c) for c in by]], 0, 200)


def fleet(projects: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Fleet registry: a line for each project with its counts and the share of assets that are not critical."""
    counted = scores.groupBy(F.col(key).alias("__id")).agg(F.count("*").alias("assets"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"))
    joined = projects.join(counted, F.col("id") == F.col("__id"), "left").na.fill(0, ["assets", "critical"])
    share = F.when(F.col("assets") == 0, 100.0).otherwise(F.round((100.0 * (F.col("assets") - F.col("critical")) / F.col("assets")).cast("decimal(18,6)"), 1).cast("double"))
    return joined.select("id", F.to_json(F.struct("id", "name", "assets", "critical", share.alias("readiness"))).alias("line"))


def specification(name: Column, specs: list[tuple[str, str]]) -> Column:
    """The standard of a target: the same name, else the first that contains it or is contained in it."""
    n = F.upper(name)
    exact = [F.when(n == F.lit(k.upper()), v) for k, v in specs]
    loose = [F.when((n != "") & (F.contains(n, F.lit(k.upper())) | F.contains(F.lit(k.upper()), n)), v) for k, v in specs]
    return reduce(lambda a, b: F.coalesce(a, b), [*exact, *loose])
