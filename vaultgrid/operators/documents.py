"""Nested documents and sinks: bill of materials, findings, statements, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _property(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))


def component(names: list[str]) -> Column:
    """One component of a bill of materials: name, type and every value as a text property."""
    return F.struct(
        F.col("asset_id").alias("bom-ref"), F.lit("cryptographic-asset").alias("type"), F.col("algorithm").alias("name"),
        F.filter(F.array(*[_property(n, F.col(n)) for n in names]), lambda p: p["value"].isNotNull()).alias("properties"),
    )


def bill_lines(scores: DataFrame, names: list[str]) -> DataFrame:
    """(asset_seq, line): a JSON line for each component, which any number of tasks can write."""
    return scores.select("asset_seq", F.to_json(component(names)).alias("line"))


def properties(lines: DataFrame) -> DataFrame:
    """Back from JSON lines to a map of properties; of repeated names the first counts."""
    schema = "`bom-ref` string, name string, properties array<struct<name:string,value:string>>"
    doc = lines.select("asset_seq", F.from_json("line", schema).alias("d"))
    entries = F.aggregate(
        "d.properties", F.create_map().cast("map<string,string>"), lambda acc, p: F.when(F.map_contains_key(acc, p["name"]), acc).otherwise(F.map_concat(acc, F.create_map(p["name"], p["value"])))
    )
    return doc.select("asset_seq", F.col("d.`bom-ref`").alias("asset_id"), F.col("d.name").alias("algorithm"), entries.alias("p"))


def finding(rule: Column, level: Column) -> Column:
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_number").alias("startLine")).alias("region")).alias("physicalLocation"))
    text = F.format_string("%s in %s (%s)", "algorithm", "component_name", "risk_level")
    return F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))


def finding_lines(advised: DataFrame) -> DataFrame:
    return advised.select("asset_seq", F.to_json(finding(F.col("rule_id"), F.col("report_level"))).alias("line"))


def statement(scores: DataFrame, root: str) -> DataFrame:
    """One canonical JSON row over the estate, keys in order, and its digest."""
    body = scores.agg(F.count("*").alias("assets"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"), F.lit(root).alias("root"))
    text = F.to_json(F.struct("assets", "critical", "root"))
    return body.select(text.alias("statement"), F.sha2(text, 256).alias("digest"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Replaces a folder of JSON lines; every task writes its own part."""
    lines.select("line").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
