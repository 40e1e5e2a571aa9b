"""The order of speaker labels, their display names, language votes and the catalogue of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anonymous_label


def order_labels(segments: DataFrame, speech: DataFrame, rec: str = "rec_id") -> DataFrame:
    """(rec, label, label_idx): by first segment, then labels that only have speech, in their order."""
    first = segments.groupBy(rec, "label").agg(F.min("seg_idx").alias("first"))
    both = speech.select(rec, "label", "ord").join(first, [rec, "label"], "full_outer")
    w = Window.partitionBy(rec).orderBy(F.col("first").asc_nulls_last(), "ord", "label")
    return both.select(rec, "label", (F.row_number().over(w) - 1).alias("label_idx"))


def assign_displays(labels: DataFrame, rec: str = "rec_id") -> DataFrame:
    """display for labels (rec, label, label_idx, name, anon): the matched name, the letter held, or a free letter.

    Free letters go in label order to the labels without name and letter; names and held letters are not free.
    """
    open_ = F.col("name").isNull() & F.col("anon").isNull()
    w = Window.partitionBy(rec).orderBy("label_idx")
    want = labels.filter(open_).withColumn("k", F.row_number().over(w))
    count = labels.groupBy(rec).agg(F.count("*").alias("n"))
    options = count.select(rec, F.explode(F.sequence(F.lit(0), F.col("n").cast("int") * 2)).alias("i")).withColumn("letter", anonymous_label(F.col("i")))
    taken = labels.filter(~open_).select(rec, F.explode(F.array_compact(F.array("name", "anon"))).alias("letter"))
    free = options.join(taken, [rec, "letter"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy(rec).orderBy("i")))
    given = want.join(free, [rec, "k"]).select(rec, "label", "letter")
    return labels.join(given, [rec, "label"], "left").select(rec, "label", "label_idx", F.coalesce("name", "anon", "letter").alias("display"))


def language_vote(windows: DataFrame, rec: str = "rec_id") -> DataFrame:
    """The language with the largest sum of probabilities over a recording's windows (rec, idx, lang, prob).

    Of equals the first seen wins; confidence is that sum over the number of windows.
    """
    sums = windows.groupBy(rec, "lang").agg(F.sum("prob").alias("votes"), F.min("idx").alias("first"), F.count("*").alias("n"))
    best = sums.groupBy(rec).agg(F.max_by(F.struct("lang", "votes"), F.struct("votes", -F.col("first"))).alias("b"), F.sum("n").alias("n"), F.count("*").alias("langs"))
    return best.select(rec, F.col("b.lang").alias("lang"), F.round(F.col("b.votes") / F.col("n"), 3).alias("confidence"), F.col("langs").alias("languages"))


def detection_warning(votes: DataFrame) -> DataFrame:
    """Votes with warn: the confidence is under 0.9 or windows disagree."""
    return votes.withColumn("warn", (F.col("confidence") < 0.9) | (F.col("languages") > 1))


def window_starts(totals: DataFrame, window: int, most: int, rec: str = "rec_id") -> DataFrame:
    """Sample starts of language windows, even between 5 and 95 % of what a window can start at."""
    span = F.col("total") - window
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(span / window) + 1)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.when(F.col("total") <= window, 0).otherwise(n - 1)))
    step = F.when(n > 1, F.lit(0.95 - 0.05) / (n - 1)).otherwise(0.0)
    ratio = F.when((n > 1) & (F.col("idx") == n - 1), F.lit(0.95)).otherwise(F.lit(0.05) + F.col("idx") * step)
    return totals.select(rec, "total", spread.alias("idx")).select(rec, "idx", F.when(F.col("total") <= window, F.lit(0)).otherwise(F.floor(span * ratio)).alias("start"))


def results_catalogue(lines: DataFrame, rec: str) -> DataFrame:
    """Per result the number of lines and the speakers in order of appearance."""
    first = lines.groupBy(rec, "name").agg(F.min("line_idx").alias("first"), F.count("*").alias("n"))
    return first.groupBy(rec).agg(
        F.sum("n").alias("line_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), ",").alias("speakers"),
    )
