"""Naming the speakers of results: entries, registry, voiceprints and lines change together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import strip
from .labels import assign_displays
from .lines import transcript
from .registry import enroll, fold, numbered, upsert_speakers


@dataclass(frozen=True)
class Labelled:
    entries: DataFrame
    speakers: DataFrame
    voiceprints: DataFrame
    lines: DataFrame


def source_of(rec: Column, label: Column) -> Column:
    """Where a voiceprint comes from: a label of a result."""
    return F.concat(F.lit("result:"), rec.cast("string"), F.lit(":"), label)


def label_speakers(
    entries: DataFrame, wishes: DataFrame, speakers: DataFrame, voiceprints: DataFrame, segments: DataFrame, now: Column, cfg: EngineConfig = EngineConfig()
) -> Labelled:
    """Give labels of results the speakers that wishes name, and rebuild the lines; nothing is transcribed again.

    entries: rec_id, label, label_idx, speaker_id, display, anon, matched, manual, reason, total_speech, embedding.
    wishes: rec_id, label, name, speaker_id, one for a label; a speaker_id counts before the name. Wishes for labels or
    ids that are not there change nothing. A name that no speaker has in any case makes a new one; the label is shown as
    it was wished, and its voice becomes a voiceprint in place of any from the same label. A wish without a name takes
    the label's speaker and voiceprint away. Letters of unnamed labels stay as they are.
    """
    known = speakers.select(F.col("id").alias("speaker_id"), F.col("name").alias("_known"))
    labels = entries.select("rec_id", "label", "embedding", "total_speech")
    asked = wishes.select("rec_id", "label", "name", "speaker_id").join(labels, ["rec_id", "label"]).join(known, "speaker_id", "left")
    asked = asked.filter("speaker_id IS NULL OR _known IS NOT NULL")
    name = F.when(F.col("speaker_id").isNotNull(), F.col("_known")).otherwise(strip(F.coalesce("name", F.lit(""))))
    asked = asked.select("rec_id", "label", "embedding", "total_speech", name.alias("_name"), fold(name).alias("_key"))
    people = upsert_speakers(speakers, asked.select(F.col("_name").alias("name")), now)
    ids = people.groupBy(fold(F.col("name")).alias("_key")).agg(F.min("id").alias("_id"))
    told = asked.join(ids, "_key", "left").withColumn("_named", F.col("_name") != "")

    # Voiceprints: those of labels without a name go, those of named labels are replaced.
    gone = told.filter("NOT _named").select(source_of(F.col("rec_id"), F.col("label")).alias("source"))
    heard = told.filter("_named AND size(embedding) > 0").withColumn("source", source_of(F.col("rec_id"), F.col("label")))
    top = voiceprints.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = numbered(heard, "source", "_n").join(F.broadcast(top))  # one row
    made = {
        "id": F.col("_top") + F.col("_n"), "speaker_id": F.col("_id"), "embedding": F.col("embedding"), "dim": F.size("embedding"), "source": F.col("source"),
        "speech_sec": F.coalesce("total_speech", F.lit(0.0)), "created_at": now,
    }
    kinds = dict(voiceprints.dtypes)
    fresh = new.select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in voiceprints.columns])
    prints = enroll(voiceprints.join(gone, "source", "left_anti").select(voiceprints.columns), fresh, cfg.max_voiceprints)

    # Entries, with the letters of all that have no name.
    met = entries.join(told.select("rec_id", "label", "_name", "_id", "_named"), ["rec_id", "label"], "left")
    set_ = lambda c, value: F.when(F.col("_named").isNull(), F.col(c)).otherwise(value).alias(c)
    named = F.col("_named")
    changed = met.select(
        "rec_id", "label", "label_idx", "total_speech", "embedding", "anon",
        set_("speaker_id", F.when(named, F.col("_id"))), set_("matched", named), set_("manual", named),
        set_("reason", F.when(named, "named by hand").otherwise("name taken away")), F.when(named, F.col("_name")).otherwise(F.col("display")).alias("_display"),
    )
    shown = changed.select("rec_id", "label", "label_idx", F.when(F.col("speaker_id").isNotNull(), F.col("_display")).alias("name"), "anon")
    displays = assign_displays(shown).select("rec_id", "label", "display")
    out = changed.join(displays, ["rec_id", "label"]).withColumn("anon", F.coalesce("anon", F.when(F.col("speaker_id").isNull(), F.col("display"))))
    return Labelled(out.select(entries.columns), people, prints, transcript(segments, displays))
