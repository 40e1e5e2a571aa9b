"""Evidence that a segment's text was invented: repetition, stock phrases, low scores, too few characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig

# Phrases that speech models write over silence.
BOILERPLATE = (
    r"(MBC|KBS|SBS|YTN|JTBC|MBN|채널\s*A|TV\s*조선)\s*뉴스\s*\S*\s*(입니다|이었습니다|였습니다|드립니다)",
    r"시청(해\s*주)?.{0,6}(감사|고맙)",
    r"구독\s*(과|와|,|그리고)?\s*좋아요",
    r"좋아요\s*(와|과|,|그리고)?\s*구독",
    r"(한글\s*)?자막\s*(제공|제작)",
    r"(이|본)\s*(영상|방송)은.{0,20}(제작|후원|지원|협찬)",
    r"thanks?\s+for\s+watching",
    r"subtitles?\s+(by|provided)",
    r"amara\.org",
    r"please\s+subscribe",
    r"^\s*you\s*$",
    r"ご視聴ありがとう",
)
# Five and more times the same one to three characters.
GLUED = r"(?d)(.{1,3}?)\1{4,}"
MAX_REPEAT, MAX_COVER, MAX_GLUED = 0.6, 0.5, 0.5
SLOW_SECONDS, SLOW_RATE = 6.0, 1.5


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def repetition_ratio(text: Column) -> Column:
    """The share of the most frequent token; 0 for fewer than four tokens. One sort per text."""
    listed = F.array_sort(tokens(text))
    state = F.struct(F.lit("").alias("token"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(acc["token"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("token"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    most = F.aggregate(listed, state, step, lambda acc: acc["best"])
    return F.when(F.size(listed) < 4, F.lit(0.0)).otherwise(most / F.size(listed))


def cover_ratio(text: Column, patterns=BOILERPLATE) -> Column:
    """Characters that pattern matches cover, each pattern for itself, as a share of the text; 1 at most."""
    matched = F.lit(0)
    for p in patterns:
        found = F.regexp_extract_all(text, F.lit(f"(?iudU){p}"), F.lit(0))
        matched = matched + F.aggregate(found, F.lit(0), lambda acc, x: acc + F.length(x))
    return F.when(F.length(text) > 0, F.least(matched / F.length(text), F.lit(1.0))).otherwise(F.lit(0.0))


def glued(text: Column) -> Column:
    """(unit, length) of the first glued repetition in the text without spaces; empty where there is none."""
    packed = F.replace(text, F.lit(" "), F.lit(""))
    return F.struct(F.regexp_extract(packed, GLUED, 1).alias("unit"), F.length(F.regexp_extract(packed, GLUED, 0)).alias("length"), F.length(packed).alias("packed"))


def mean_score(words: Column) -> Column:
    """The mean alignment score of a segment's words that have one; null if none has."""
    scores = F.filter(F.transform(words, lambda w: w["score"].cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))


def evidence(score: Column, seconds: Column, chars: Column, min_score: float) -> Column:
    """low_score, slow or null; nothing when min_score is not positive."""
    if min_score <= 0:
        return F.lit(None).cast("string")
    return F.when(score < min_score, "low_score").when((seconds >= SLOW_SECONDS) & (chars / seconds < SLOW_RATE), "slow")


def inspect(segments: DataFrame, cfg: EngineConfig = EngineConfig(), patterns=BOILERPLATE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """segments (text, start, end, score) with repeat, cover, verdict (keep, suspect, drop) and reason.

    The first rule that holds decides: glued repetition, repeated tokens, stock phrases with and without other
    evidence, other evidence alone. Null scores and empty texts prove nothing.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    base = segments.withColumns({"_text": text, "_seconds": F.col("end") - F.col("start")})
    measured = base.withColumns({"_glued": glued(F.col("_text")), "repeat": repetition_ratio(F.col("_text")), "cover": cover_ratio(F.col("_text"), patterns)})
    proof = evidence(F.col("score"), F.col("_seconds"), F.length("_text"), cfg.hallucination_min_score)
    told = measured.withColumn("_proof", proof)
    stock = F.col("cover") >= MAX_COVER
    rule = (
        F.when(F.col("_text") == "", None)
        .when((F.col("_glued.length") > 0) & (F.col("_glued.length") >= MAX_GLUED * F.col("_glued.packed")), "glued")
        .when(F.col("repeat") >= max_repeat, "repeated")
        .when(stock & F.col("_proof").isNotNull(), "stock_proven")
        .when(stock, "stock")
        .otherwise(F.col("_proof"))
    )
    verdict = F.when(F.col("reason").isin("glued", "repeated", "stock_proven"), "drop").when(F.col("reason").isNotNull(), "suspect").otherwise("keep")
    return told.withColumn("reason", rule).withColumn("verdict", verdict).drop("_text", "_seconds", "_glued", "_proof")


def clean(inspected: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """The segments that stay: all without dropping, suspects too unless they are dropped as well."""
    if not cfg.drop_hallucination:
        return inspected
    return inspected.filter(F.col("verdict") != "drop" if not cfg.drop_suspect else F.col("verdict") == "keep")


def warning_summary(notes: DataFrame, rec: str, order: str) -> DataFrame:
    """Per recording and verdict the count and a sample: the first three texts, 24 characters of each."""
    some = notes.filter("verdict <> 'keep'")
    ranked = some.withColumn("_k", F.row_number().over(Window.partitionBy(rec, "verdict").orderBy(order))).filter("_k <= 3")
    first = F.sort_array(F.collect_list(F.struct("_k", F.substring("text", 1, 24).alias("t"))))
    counts = some.groupBy(rec, "verdict").agg(F.count("*").alias("n"))
    grouped = counts.join(ranked.groupBy(rec, "verdict").agg(first.alias("first")), [rec, "verdict"])
    shown = F.array_join(F.transform("first", lambda x: F.concat(F.lit('"'), x["t"], F.lit('"'))), ", ")
    more = F.when(F.col("n") > 3, F.concat(F.lit(" and "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return grouped.select(rec, "verdict", "n", F.concat(shown, more).alias("sample"))
