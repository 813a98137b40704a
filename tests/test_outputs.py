"""Whole documents: the parts in a row are valid JSON, whatever the number of rows and parts."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vaultgrid.operators import guidance, whole
from vaultgrid.plans import catalog

SF = "/root/testdata/sf0.001"


def joined(folder):
    parts = sorted(Path(folder).glob("part-*"))
    return parts, "".join(p.read_text() for p in parts)


@pytest.mark.parametrize("n", [0, 1, 200_000])
def test_listing_of_any_length(spark, tmp_path, n):
    rows = spark.range(n).repartition(7).select((F.col("id") * 3 + 5).alias("seq"), F.col("id"), F.concat(F.lit('a "quoted" \n line '), F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("nothing"))
    whole.write(whole.listing(rows), f"file://{tmp_path}/d")
    parts, text = joined(tmp_path / "d")
    got = json.loads(text)
    assert got == [{"id": i, "text": f'a "quoted" \n line {i}', "nothing": None} for i in range(n)]
    if n > 1000:
        assert len(parts) > 1 and max(p.stat().st_size for p in parts) < 0.9 * len(text)


def test_bill_and_findings(spark, tmp_path):
    advised = guidance.advised(catalog.scored(spark, SF))
    deps = spark.createDataFrame([(1, "npm", "a")], "seq long, ecosystem string, package string")
    whole.write(whole.bill(advised, deps, "cd" * 32, 3), f"file://{tmp_path}/b")
    bill = json.loads(joined(tmp_path / "b")[1])
    n = advised.count()
    assert bill["bomFormat"] == "CycloneDX" and len(bill["components"]) == n and bill["dependencies"] == [{"ecosystem": "npm", "package": "a"}]
    assert {p["name"]: p["value"] for p in bill["metadata"]["properties"]} == {"merkleRoot": "cd" * 32, "totalAssets": str(n), "manifestDependencies": "1", "unknownsLogged": "3"}
    refs = [c["bom-ref"] for c in bill["components"]]
    assert refs == [r["asset_id"] for r in advised.orderBy("asset_seq").collect()]
    whole.write(whole.findings(advised, "t", "1"), f"file://{tmp_path}/b")  # replaces the other document
    run = json.loads(joined(tmp_path / "b")[1])["runs"][0]
    assert len(run["results"]) == n and all(run["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in run["results"])
    whole.write(whole.bill(advised.limit(0), deps.limit(0), "00" * 32, 0), f"file://{tmp_path}/b")
    empty = json.loads(joined(tmp_path / "b")[1])
    assert empty["components"] == empty["dependencies"] == []


def test_each_file_is_replaced(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(f"f{i}.json", json.dumps({"i": i})) for i in range(n)] + [("null.json", None)], "name string, document string").repartition(3)
    folder = f"file://{tmp_path}/each"
    assert whole.write_each(rows(40), folder).count() == 41
    assert {r["name"]: r["bytes"] for r in whole.write_each(rows(5), folder).collect()} == {f"f{i}.json": 8 for i in range(5)} | {"null.json": 0}
    assert sorted(p.name for p in (tmp_path / "each").iterdir() if not p.name.startswith(".")) == [f"f{i}.json" for i in range(5)] + ["null.json"]
