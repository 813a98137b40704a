"""Trace logs as a stream: parsed like a batch, matched with a static estate, windowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import correlate
from ..sources import texts


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    return texts.trace_events(spark.readStream.text(folder))


def run_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, written once, restartable from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def promoted(stream: DataFrame, static: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch's runtime rows with the static asset they confirm."""

    def batch(rows: DataFrame, number: int) -> None:
        correlate.runtime_match(rows, static).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by type in tumbling windows, rows later than the watermark left out (extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("from_ts"), "event_type", "n")
