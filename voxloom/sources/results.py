"""Results as JSON and text files, and stage tables that are reused while their key stays the same."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..config import EngineConfig
from ..functions.text import timestamp

RESULT_SCHEMA = (
    "rec_id string, created_at string, language string, duration double, "
    "lines array<struct<line_idx:bigint,speaker:string,name:string,text:string,start:double,end:double>>"
)


def save(results: DataFrame, path: str) -> None:
    """Append one JSON document per result; load takes the one saved last for each rec_id.

    Nothing is overwritten, so a job that fails half-way leaves older results whole.
    """
    _append(results.select("rec_id", F.struct(*results.columns).alias("result")), path)


def delete(gone: DataFrame, path: str) -> None:
    """Take away the results of the rec_ids in gone; others stay."""
    _append(gone.select("rec_id"), path)


def _append(rows: DataFrame, path: str) -> None:
    stamped = F.to_json(F.struct(F.lit(time.time_ns()).alias("saved"), *rows.columns))
    rows.select(stamped.alias("value")).write.mode("append").text(path)


def load(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """The saved results; documents that cannot be read are left out."""
    line = f"saved bigint, rec_id string, result struct<{schema}>"
    parsed = spark.read.text(path).select(F.from_json("value", line, {"mode": "PERMISSIVE"}).alias("r")).filter("r.rec_id IS NOT NULL")
    latest = parsed.groupBy("r.rec_id").agg(F.max_by("r.result", "r.saved").alias("result"))
    return latest.filter("result IS NOT NULL").select("result.*")


def catalogue(results: DataFrame) -> DataFrame:
    """What a list of results shows, newest first."""
    names = F.array_distinct(F.transform("lines", lambda x: x["name"]))
    return results.select("rec_id", "created_at", "language", "duration", F.size("lines").alias("line_count"), names.alias("speakers")).orderBy(F.desc("created_at"), "rec_id")


def slim(payload: DataFrame) -> DataFrame:
    """Payload rows without embeddings and words."""
    out = payload.drop("embedding")
    if "segments" in payload.columns:
        out = out.withColumn("segments", F.transform("segments", lambda s: s.dropFields("words")))
    return out


def as_text(lines: DataFrame, rec: str) -> DataFrame:
    """(rec, text): the lines of a result as `name : text`, one below the other, in order."""
    one = F.sort_array(F.collect_list(F.struct("line_idx", F.concat("name", F.lit(" : "), "text", F.lit("\n")).alias("t"))))
    return lines.groupBy(rec).agg(F.array_join(F.transform(one, lambda x: x["t"]), "").alias("text"))


def text_twin(results: DataFrame) -> DataFrame:
    """(rec_id, text): what a text file beside a result holds, its lines as `name : text`, one below the other."""
    line = lambda x: F.concat(x["name"], F.lit(" : "), x["text"], F.lit("\n"))
    in_order = F.array_sort("lines", lambda a, b: F.when(a["line_idx"] < b["line_idx"], -1).otherwise(1))
    return results.select("rec_id", F.array_join(F.transform(in_order, line), "").alias("text"))


def save_text(results: DataFrame, path: str) -> None:
    """Append the text twins of results beside their JSON documents; load_text takes the one saved last."""
    text_twin(results).withColumn("saved", F.lit(time.time_ns())).write.mode("append").parquet(f"{path}/twins")


def load_text(spark: SparkSession, path: str) -> DataFrame:
    twins = spark.read.parquet(f"{path}/twins")
    return twins.groupBy("rec_id").agg(F.max_by("text", "saved").alias("text"))


def download(results: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (rec_id, fmt) with name and content: the text for txt, for any other format the JSON document.

    A request for a result that is not there has nulls.
    """
    document = results.select("rec_id", F.to_json(F.struct(*results.columns)).alias("_json")).join(text_twin(results), "rec_id")
    met = requests.join(document, "rec_id", "left")
    as_text_ = F.lower("fmt") == "txt"
    name = F.when(F.col("_json").isNotNull(), F.concat("rec_id", F.when(as_text_, ".txt").otherwise(".json")))
    return met.select("rec_id", "fmt", name.alias("name"), F.when(as_text_, F.col("text")).otherwise(F.col("_json")).alias("content"))


def with_clock(lines: DataFrame) -> DataFrame:
    return lines.withColumn("clock", timestamp(F.col("start")))


def key_hash(*parts: Column) -> Column:
    """The name of a stage's inputs; a later stage takes an earlier one's as a part."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def audio_key(file: Column, size: Column, modified: Column) -> list[Column]:
    """The parts of a key that say which sound it is: name, size and whole seconds of its last change, not its content."""
    return [file, size.cast("long"), F.floor(modified).cast("long")]


def trim_key(cfg: EngineConfig) -> list[Column]:
    """The settings on which a silence plan depends, as parts of a key."""
    used = (cfg.trim_min_silence_sec, cfg.trim_pad_sec, cfg.trim_sensitivity, cfg.trim_min_speech_sec, cfg.trim_min_dynamic_db, cfg.trim_highpass_hz)
    return [F.lit(str(float(x))) for x in used]


#: The table beside the stages that tells which recordings have them, even without a row.
LOG = "stage_log"


def save_stage(df: DataFrame, path: str, stage: str, keys: DataFrame) -> None:
    """Append a stage's rows (rec_id, ...) with the key_hash of their recording; what is saved last counts.

    All recordings of keys count as saved, those without rows too.
    """
    saved = F.lit(time.time_ns())
    rows = df.join(keys.select("rec_id", "key_hash"), "rec_id").withColumn("saved", saved)
    rows.write.mode("append").parquet(f"{path}/{stage}")
    _note(keys.select("rec_id"), path, stage, saved, True)


def _note(recs: DataFrame, path: str, stage: str, saved: Column, present: bool) -> None:
    note = recs.select(F.col("rec_id").cast("string").alias("rec_id"), F.lit(stage).alias("stage"), saved.alias("saved"), F.lit(present).alias("present"))
    note.write.mode("append").parquet(f"{path}/{LOG}")


def clear_stage(path: str, stage: str, gone: DataFrame) -> None:
    """From now on the stage has no rows for the rec_ids in gone."""
    stamp = F.lit(time.time_ns())
    saved = gone.sparkSession.read.parquet(f"{path}/{stage}")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in saved.schema if f.name not in ("rec_id", "saved")]
    rows = gone.select(F.col("rec_id").cast(saved.schema["rec_id"].dataType), *rest, stamp.alias("saved"))
    rows.select(saved.columns).write.mode("append").parquet(f"{path}/{stage}")
    _note(gone.select("rec_id"), path, stage, stamp, False)


def stages(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id string, stages): the names of the stages that recordings have, in order."""
    log = spark.read.parquet(f"{path}/{LOG}")
    last = log.groupBy("rec_id", "stage").agg(F.max_by("present", "saved").alias("present")).filter("present")
    return last.groupBy("rec_id").agg(F.sort_array(F.collect_set("stage")).alias("stages"))


def load_stage(spark: SparkSession, path: str, stage: str, keys: DataFrame) -> DataFrame | None:
    """The stage's rows of recordings whose key is the same as when they were saved last; None if nothing was saved."""
    try:
        saved = spark.read.parquet(f"{path}/{stage}")
    except AnalysisException:
        return None
    latest = saved.groupBy("rec_id").agg(F.max("saved").alias("saved"))
    same = keys.select("rec_id", "key_hash")
    return saved.join(latest, ["rec_id", "saved"], "left_semi").join(same, ["rec_id", "key_hash"], "left_semi").drop("key_hash", "saved")
