"""The engine's logical tables, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark, sf_dir: str) -> DataFrame:
    """Events as speaker turns: users are recordings, event types speakers, values minutes."""
    e = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    base = e.select(
        F.col("user_id").alias("rec_id"), "event_id", F.col("event_type").alias("speaker"), start.alias("start"),
        (start + F.round(F.col("value") * 60).cast("long")).alias("end"),
    )
    w = Window.partitionBy("rec_id").orderBy("start", "end", "speaker", "event_id")
    return base.withColumn("turn_idx", (F.row_number().over(w) - 1).cast("long"))


TURNS = """ev AS (
  SELECT user_id AS rec_id, event_id, event_type AS speaker, CAST(floor(epoch(ts)) AS BIGINT) AS s,
         CAST(floor(epoch(ts)) AS BIGINT) + CAST(round(value * 60) AS BIGINT) AS e, value FROM events),
turns AS (SELECT *, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY s, e, speaker, event_id) - 1 AS BIGINT) AS turn_idx FROM ev)"""


def merged(source: str, gap: str, keys: str = "rec_id") -> str:
    """SQL: regions of `source` (keys, s, e) joined below a gap, as regions(keys, s, e)."""
    return f"""m1 AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source}),
m2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m1),
regions AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM m2 GROUP BY {keys}, g)"""


PLACED = """placed AS (SELECT *, sum(e - s) OVER (PARTITION BY rec_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) - (e - s) AS off FROM regions)"""


def hourly_levels(spark, sf_dir: str) -> DataFrame:
    """A user's events by the hour as frame levels in dB."""
    e = table(spark, sf_dir, "events")
    hour = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    frames = e.groupBy(F.col("user_id").alias("rec_id"), F.floor(hour / 3600).alias("frame_idx"))
    return frames.agg(F.round(10 * F.log10(F.avg(F.col("value") * F.col("value")) + 1e-10), 6).alias("db"))


LEVELS = """levels AS (
  SELECT user_id AS rec_id, CAST(floor(floor(epoch(ts)) / 3600) AS BIGINT) AS frame_idx,
         round(10 * log10(avg(value * value) + 1e-10), 6) AS db FROM events GROUP BY 1, 2)"""


def segments(spark, sf_dir: str) -> DataFrame:
    """Conversation turns as segments with made-up times and scores that depend on the turn alone."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("rec_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("label"), "text",
        (F.col("turn") * 60).cast("double").alias("start"),
        (F.col("turn") * 60 + (F.col("turn") % 5 + 1) * 12).cast("double").alias("end"),
        (F.pmod(F.col("conv_id") * 7 + F.col("turn") * 13, F.lit(100)) / 100).alias("score"),
    )


def voices(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("speaker_id"), "embedding")
