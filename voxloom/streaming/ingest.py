"""Transcript lines from segment files as they arrive (an addition: batches are all the rest of the engine knows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lines import merge_lines

SEGMENTS = "rec_id string, seg_idx long, name string, text string, at timestamp"


def arriving(spark: SparkSession, path: str, schema: str = SEGMENTS) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def speech_per_window(segments: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Segments and characters per recording, name and window; later than `late` does not count."""
    grouped = segments.withWatermark("at", late).groupBy("rec_id", "name", F.window("at", window).alias("w"))
    return grouped.agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars")).select("rec_id", "name", F.col("w.start").alias("start"), "segments", "chars")


def keep_lines(segments: DataFrame, store: str, checkpoint: str):
    """Append each micro-batch's segments to a store keyed by batch, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("epoch", F.lit(epoch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(store)

    return segments.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


def lines_so_far(spark: SparkSession, store: str) -> DataFrame:
    """Lines over all segments stored so far."""
    return merge_lines(spark.read.parquet(store), "rec_id", ["seg_idx"], "name", "text")
