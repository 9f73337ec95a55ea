"""Incremental ingest by Structured Streaming: exact duplicates and funnel counts.

An addition for resumable runs: a finished trigger leaves a checkpoint, so a later run does
only what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def unique_within(stream: DataFrame, text: str, at: str, late: str = "1 hour") -> DataFrame:
    """Rows whose text has not come before within the watermark."""
    return stream.withColumn("_hash", F.sha2(text, 256)).withWatermark(at, late).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def windowed_counts(stream: DataFrame, at: str, size: str, late: str, *by: str) -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, exactly once, into Parquet."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


def run_funnel(stream: DataFrame, stage: str, target: str, checkpoint: str) -> None:
    """Append each batch's stage counts; a batch that is done again replaces its own."""

    def save(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
