"""Words and segments get the speaker of the turn they share most time with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.shared import written
from .intervals import as_of, buckets
from .scans import WIDTH, Running, count, running


def first_around(spans: DataFrame, turns: DataFrame, rec: str = "rec_id") -> DataFrame:
    """spans (rec, lo, hi, ...) with turn_idx of the first turn that begins at lo or before and ends at hi or after.

    Turns are numbered by start. So it is the first one that ends at hi or after, if it begins in time; and that is where
    the furthest end so far reaches hi. One look-up a span, however many turns are around it.
    """
    reached = running(turns.select(rec, "turn_idx", "end"), [rec], ["turn_idx"], WIDTH, {"_reach": Running("max", F.col("end"))})
    marks = reached.groupBy(rec, (-F.col("_reach")).alias("_back")).agg(F.min("turn_idx").alias("_first"))
    led = as_of(spans.withColumn("_from", -F.col("hi")), marks, [rec], "_from", "_back")
    begins = turns.select(rec, F.col("turn_idx").alias("_first"), F.col("start").alias("_begin"))
    around = F.when(F.col("_begin") <= F.col("lo"), F.col("_first"))
    return led.join(begins, [rec, "_first"], "left").select(*spans.columns, around.alias("turn_idx"))


def best_overlap(words: DataFrame, turns: DataFrame, width, rec: str = "rec_id") -> DataFrame:
    """(rec, word_id, speaker, overlap) of the single turn with most shared time; ties go to the first turn.

    Turns are numbered by start and end. A turn around a word shares all of it, so the first of those is looked up. Only
    words without one meet turns, and only those that begin or end inside the word: however many turns go on at once,
    no word meets them all.
    """
    spans = words.filter(F.col("end") > F.col("start")).select(rec, "word_id", F.col("start").alias("lo"), F.col("end").alias("hi"))
    placed = first_around(spans, turns, rec)
    named = turns.select(rec, "turn_idx", "speaker")
    whole = placed.filter("turn_idx IS NOT NULL").join(named, [rec, "turn_idx"]).select(rec, "word_id", "speaker", (F.col("hi") - F.col("lo")).alias("overlap"))
    left = placed.filter("turn_idx IS NULL").select(rec, "word_id", F.col("lo").alias("l_start"), F.col("hi").alias("l_end"))
    left = left.withColumn("_bucket", F.explode(buckets(F.col("l_start"), F.col("l_end"), width)))
    ends = turns.select(rec, "turn_idx", "speaker", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.explode(F.array("start", "end")).alias("_at"))
    ends = ends.withColumn("_bucket", F.floor(F.col("_at") / width))
    overlap = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    met = left.join(ends, [rec, "_bucket"]).filter("_at > l_start AND _at < l_end").withColumn("overlap", overlap).filter("overlap > 0")
    best = met.groupBy(rec, "word_id").agg(F.max_by(F.struct("speaker", "overlap"), F.struct("overlap", -F.col("turn_idx"))).alias("x"))
    return whole.unionByName(best.select(rec, "word_id", F.col("x.speaker").alias("speaker"), F.col("x.overlap").alias("overlap")))


def nearest(points: DataFrame, turns: DataFrame, width, rec: str = "rec_id") -> DataFrame:
    """(rec, word_id, speaker) of the first turn that contains `at`, or else the nearest; ties go to the first turn.

    Points look up the first turn around them; those in no turn the last end before them and the next start after them,
    so no pairs are made.
    """
    placed = first_around(points.select(rec, "word_id", F.col("at").alias("lo"), F.col("at").alias("hi")), turns, rec)
    inside = placed.filter("turn_idx IS NOT NULL").select(rec, "word_id", "turn_idx")
    outside = placed.filter("turn_idx IS NULL").select(rec, "word_id", F.col("lo").alias("at"), (-F.col("lo")).alias("back"))
    ended = turns.groupBy(rec, F.col("end").alias("mark")).agg(F.min("turn_idx").alias("left_idx"))
    begins = turns.groupBy(rec, (-F.col("start")).alias("back_mark")).agg(F.min("turn_idx").alias("right_idx"))
    both = as_of(as_of(outside, ended, [rec], "at", "mark"), begins, [rec], "back", "back_mark")
    left = F.when(F.col("mark").isNotNull(), F.struct((F.col("at") - F.col("mark")).alias("d"), F.col("left_idx").alias("i")))
    right = F.when(F.col("back_mark").isNotNull(), F.struct((-F.col("back_mark") - F.col("at")).alias("d"), F.col("right_idx").alias("i")))
    chosen = both.select(rec, "word_id", F.least(left, right)["i"].alias("turn_idx"))
    return inside.unionByName(chosen).join(turns.select(rec, "turn_idx", "speaker"), [rec, "turn_idx"]).select(rec, "word_id", "speaker")


def attach(words: DataFrame, turns: DataFrame, width, rec: str = "rec_id", nobody: str = "SPEAKER_00") -> DataFrame:
    """words (rec, word_id, start, end) with speaker: by overlap, else the turn nearest to the middle.

    Speakers by overlap, and the words left over, are written to the shared folder: later steps read them several times.
    """
    best = written(best_overlap(words, turns, width, rec).select(rec, "word_id", "speaker"))
    rest = written(words.join(best, [rec, "word_id"], "left_anti").select(rec, "word_id", ((F.col("start") + F.col("end")) / 2).alias("at")))
    found = best.unionByName(nearest(rest, turns, width, rec))
    return words.join(found, [rec, "word_id"], "left").withColumn("speaker", F.coalesce("speaker", F.lit(nobody)))


def split_segments(words: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Runs of one speaker within a segment: (rec, seg_idx, part_idx, speaker, start, end, text, words).

    words: rec, seg_idx, word_idx, word, start, end, speaker, segment_text. Words without times have no speaker and
    vanish where a segment splits; a segment of one speaker keeps its own text.
    """
    return _parts(words, rec).drop("alone")


def _parts(words: DataFrame, rec: str) -> DataFrame:
    """The runs of split_segments with `alone`: the segment has one speaker. A word_idx of -1 stands for no word."""
    w = Window.partitionBy(rec, "seg_idx").orderBy("word_idx")
    timed = words.filter("start IS NOT NULL AND end IS NOT NULL")
    fresh = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | (F.row_number().over(w) == 1)
    marked = timed.withColumn("fresh", fresh.cast("int")).withColumn("part_idx", F.sum("fresh").over(w) - 1)
    listed = F.sort_array(F.collect_list(F.struct("word_idx", F.struct("word", "start", "end", "speaker").alias("w"))))
    parts = marked.groupBy(rec, "seg_idx", "part_idx", "speaker").agg(
        F.min_by("start", "word_idx").alias("start"),
        F.max_by("end", "word_idx").alias("end"),
        F.transform(F.filter(listed, lambda x: x["word_idx"] >= 0), lambda x: x["w"]).alias("words"),
        F.first("segment_text").alias("segment_text"),
    )
    joined = F.array_join(F.transform("words", lambda x: F.coalesce(strip(x["word"]), F.lit(""))), " ")
    parts = parts.withColumn("alone", F.max("part_idx").over(Window.partitionBy(rec, "seg_idx")) == 0)
    text = F.when(F.col("alone"), F.col("segment_text")).otherwise(joined)
    return parts.withColumn("text", strip(text)).filter("text <> ''").select(rec, "seg_idx", "part_idx", "speaker", "start", "end", "text", "words", "alone")


def attach_segments(segments: DataFrame, words: DataFrame, turns: DataFrame, width, rec: str = "rec_id") -> DataFrame:
    """Segments (rec, seg_idx, start, end, text) split where the speakers of their words change.

    words: rec, seg_idx, word_idx, word, start, end. Returns rec, place, seg_idx, part_idx, speaker, start, end, text
    and words, which are those with both times, with their speakers. A segment of one speaker keeps its own times and
    text; one without timed words goes whole to the speaker of its own span; a part of several has the times of its
    first and last word. Parts without text go. Places number the parts of a recording by start, then by segment and
    part. A segment without a start begins at 0, one without an end ends where it begins.
    """
    begun = F.coalesce("start", F.lit(0).cast(segments.schema["start"].dataType))
    clean = segments.withColumns({"start": begun, "end": F.when(F.col("end") != 0, F.col("end")).otherwise(begun)})
    timed = words.filter("start IS NOT NULL AND end IS NOT NULL").select(rec, "seg_idx", F.col("word_idx").cast("long").alias("word_idx"), "word", "start", "end")
    bare = clean.join(timed.select(rec, "seg_idx").distinct(), [rec, "seg_idx"], "left_anti")
    bare = bare.select(rec, "seg_idx", F.lit(-1).cast("long").alias("word_idx"), F.lit("").alias("word"), "start", "end")
    named = attach(timed.unionByName(bare).withColumn("word_id", F.struct("seg_idx", "word_idx")), turns, width, rec)
    own = clean.select(rec, "seg_idx", F.col("text").alias("segment_text"))
    parts = _parts(named.join(own, [rec, "seg_idx"]), rec)
    spans = clean.select(rec, "seg_idx", F.col("start").alias("_start"), F.col("end").alias("_end"))
    time = lambda x: F.when(F.col("alone"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x)
    told = parts.join(spans, [rec, "seg_idx"]).select(rec, "seg_idx", F.col("part_idx").cast("long").alias("part_idx"), "speaker", time("start"), time("end"), "text", "words")
    placed = running(told, [rec], ["start", "seg_idx", "part_idx"], WIDTH, {"_n": count()})
    return placed.select(rec, (F.col("_n") - 1).alias("place"), "seg_idx", "part_idx", "speaker", "start", "end", "text", "words")
