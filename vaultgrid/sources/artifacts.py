"""Documents of earlier scans: read if they are there and sound, found across report folders; tables of known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.utils import AnalysisException


def artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON document (or many); none where the path is missing, and none for what is no JSON of the schema."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    parsed = texts.select(F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("d"))
    return parsed.select("d.*").where("_broken IS NULL").drop("_broken")


def projects(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """(project, columns) of every document ``name`` in a folder of its own anywhere under ``root``; the folder names the project."""
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return read.withColumn("project", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def ground_truth(rows: DataFrame) -> DataFrame:
    """(tier, case, file, vulnerable) of a sheet (line_no, tier, case, files, expected): tiers are written once and hold until the next, files are many in a cell."""
    so_far = W.partitionBy("sheet").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    named = rows.withColumn("tier", F.last(F.when(F.trim("tier") != "", F.trim("tier")), ignorenulls=True).over(so_far))
    files = F.filter(F.transform(F.split("files", r"[,;\n]"), lambda x: F.trim(x)), lambda x: x != "")
    flagged = F.lower(F.trim("expected")).isin("yes", "true", "1", "vulnerable", "insecure")
    return named.where(F.trim("case") != "").select("tier", F.trim("case").alias("case"), F.explode(files).alias("file"), F.coalesce(flagged, F.lit(False)).alias("vulnerable"))
