"""What a result carries and shows, and the values that come in with a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import WIDTH, count, running


def payload_segments(segments: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Segments (rec, seg_idx, start, end, speaker, text, words) as results keep them.

    Times have three decimals, words lose all but word, start, end and speaker. Segments without text go, and so do
    words without both times; a null list of words is empty.
    """
    timed = F.filter("words", lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    slim = F.transform(
        timed,
        lambda w: F.struct(
            F.coalesce(w["word"], F.lit("")).alias("word"), F.round(w["start"], 3).alias("start"), F.round(w["end"], 3).alias("end"), w["speaker"].alias("speaker")
        ),
    )
    told = segments.filter(F.trim("text") != "")
    return told.select(rec, "seg_idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "speaker", "text", F.coalesce(slim, F.array()).alias("words"))


def positive_int(value: Column) -> Column:
    """The whole number above 0 that a form value holds, or null."""
    number = F.when(F.trim(value).rlike(r"^\+?[0-9]+$"), F.trim(value).try_cast("long"))
    return F.when(number > 0, number)


def wants_prompt(value: Column) -> Column:
    """Whether a form value says yes: all but 0, false, off and nothing do."""
    return ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("0", "false", "off", "")


def progress(chunk: Column, chunks: Column) -> Column:
    """Percent done when a chunk begins: chunks share the way from 12 to 88 evenly."""
    return F.lit(12.0) + F.lit(76.0) * chunk / chunks


def merged_turns(turns: DataFrame, mapping: DataFrame, rec: str = "rec_id", width=WIDTH) -> DataFrame:
    """Turns (rec, chunk_idx, label, start, end) of all chunks in one order, with the speakers that mapping gives.

    mapping: rec, chunk_idx, label, speaker, as stitch returns it, with every label of a turn. Turns of equal times
    stay in the order of chunks and labels.
    """
    named = turns.join(mapping.select(rec, "chunk_idx", "label", "speaker"), [rec, "chunk_idx", "label"])
    placed = running(named, [rec], ["start", "end", "chunk_idx", "label"], width, {"_n": count()})
    return placed.select(rec, (F.col("_n") - 1).alias("turn_idx"), "speaker", "start", "end")


def carried_overlaps(overlaps: DataFrame, mapping: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Pairs of labels that speak at once (rec, chunk_idx, a, b) as pairs of speakers; pairs of one speaker go."""
    names = mapping.select(rec, "chunk_idx", "label", "speaker")
    for side in ("a", "b"):
        overlaps = overlaps.join(names.withColumnsRenamed({"label": side, "speaker": f"{side}_speaker"}), [rec, "chunk_idx", side])
    return overlaps.filter("a_speaker <> b_speaker").select(rec, "chunk_idx", F.col("a_speaker").alias("a"), F.col("b_speaker").alias("b"))


def merged_speech(speech: DataFrame, mapping: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Seconds of each speaker over all chunks from those of labels (rec, chunk_idx, label, speech_sec); null is 0."""
    named = mapping.join(speech.select(rec, "chunk_idx", "label", "speech_sec"), [rec, "chunk_idx", "label"], "left")
    return named.groupBy(rec, "speaker").agg(F.sum(F.coalesce("speech_sec", F.lit(0.0))).alias("speech_sec"))


def usable_windows(windows: DataFrame, least: int, quiet: float, rec: str = "rec_id") -> DataFrame:
    """Language windows (rec, idx, length, rms) that last least samples and are not quiet.

    A recording without such a window has one row with a null idx: it is heard as a whole.
    """
    good = windows.filter((F.col("length") >= least) & (F.col("rms") >= quiet)).select(rec, "idx")
    none = windows.select(rec).distinct().join(good, rec, "left_anti").withColumn("idx", F.lit(None).cast(windows.schema["idx"].dataType))
    return good.unionByName(none)
