"""Quality rules and a hashed n-gram log-likelihood ratio, in native SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Hashed unigrams and bigrams share this many multinomial cells: the model is this large for any corpus.
CELLS = 1 << 16
#: The threshold lies where so large a share of the documents labelled bad, but of the trusted ones no more than the
#: other share, is below it.
BAD_BELOW, GOOD_BELOW = 0.95, 0.01
STEP = 0.001


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def base_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) with words and the counts of the base rules for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.withColumns({"words": words(F.col("text")), "lines": lines})
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    counted = first.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "words")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "hashes": hashes,
        }
    )
    indexes = F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1))
    hashed = counted.withColumn(
        "windows", F.when(F.size("hashes") > WINDOW, F.transform(indexes, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))))
    )
    # Most texts repeat no window; the others get their windows sorted as text, so that no hash decides.
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    as_text = F.transform(indexes, lambda i: F.struct(F.concat_ws(" ", F.slice("words", i, WINDOW)).alias("w"), i.alias("i")))
    ordered = hashed.withColumn("sorted", F.when(repeats, F.sort_array(as_text)))
    twice = F.transform(
        "sorted",
        lambda x, k: F.struct(
            x["i"].alias("i"),
            ((F.get("sorted", k - 1)["w"] == x["w"]) | (F.get("sorted", k + 1)["w"] == x["w"])).alias("twice"),
        ),
    )
    starts = F.sort_array(F.transform(F.filter(twice, lambda y: y["twice"]), lambda y: y["i"]))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        starts,
        nothing,
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    n_repeat = F.when(F.col("sorted").isNotNull() & (F.size("sorted") > 0), covered).otherwise(F.lit(0).cast("long"))
    return ordered.withColumn("n_repeat_words", n_repeat).drop("lines", "hashes", "windows", "sorted")


def exploded_cells(rows: DataFrame) -> DataFrame:
    """rows (with words) once for each unigram and bigram, with its multinomial cell; null for rows without words."""
    after = F.concat(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    pairs = F.arrays_zip(F.col("words").alias("a"), after.alias("b"))
    one = rows.withColumn("pair", F.explode_outer(F.when(F.size("words") > 0, pairs))).drop("words")
    unigram = F.when(F.col("pair.a").isNotNull(), F.pmod(F.xxhash64(F.lit(1), "pair.a"), F.lit(CELLS)))
    bigram = F.when(F.col("pair.b").isNotNull(), F.pmod(F.xxhash64(F.lit(2), "pair.a", "pair.b"), F.lit(CELLS)))
    return one.withColumn("cell", F.explode(F.array(unigram, bigram))).drop("pair")


def ratio_model(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """cell and ratio, for cells that occur: log of the cell's share in trusted texts over that in all texts.

    Counts cover all documents. CELLS n-grams spread as in all texts are added to the trusted ones: a cell of equal
    shares has ratio 0 whatever the totals, and where nothing is trusted all ratios are 0.
    """
    # The trusted ids grow with the corpus: they meet the texts in a shuffle at every size, never by broadcast.
    good = trusted.select("doc_id").distinct().withColumn("good", F.lit(1)).hint("merge")
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left").select("good", words(F.col("text")).alias("words"))
    counts = (
        exploded_cells(marked)
        .filter("cell IS NOT NULL")
        .groupBy("cell")
        .agg(F.count("*").alias("raw"), F.count("good").alias("trusted"))
    )
    every = Window.partitionBy(F.lit(0))  # CELLS rows at most
    raw = F.col("raw") / F.sum("raw").over(every)
    share = (F.col("trusted") + CELLS * raw) / (F.sum("trusted").over(every) + CELLS)
    return counts.select("cell", F.log(share / raw).alias("ratio"))


def quantile(scored: DataFrame, of: DataFrame, share: float) -> float | None:
    """The ratio (a multiple of STEP) that at least such a share of the rows named by `of` do not exceed.

    Rows that fail the base rule do not count; None where no row is left. A table of counts by STEP comes to the
    driver: ratios are mean logs of shares, so it has some ten thousand rows at most.
    """
    step = F.ceil(F.col("ratio") / STEP).alias("step")
    named = scored.filter("NOT base_failed").join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = sorted((r["step"], r["count"]) for r in named.groupBy(step).count().collect())
    wanted = share * sum(n for _, n in counts)
    for at, n in counts:
        wanted -= n
        if wanted <= 0:
            return round(at * STEP, 6)
    return None


def quality(docs: DataFrame, trusted: DataFrame, bad: DataFrame, min_ratio: float | None = None) -> DataFrame:
    """Counts, base rule, mean log ratio and verdict for each row of docs.

    trusted names the doc_ids of the target corpus, bad those of known bad documents (null ids are ignored). A
    document passes if it does not fail the base rule and its ratio is min_ratio or more, ties included. Without
    min_ratio the threshold comes from the ratios of the named documents in the whole table; with no bad or no
    trusted ones every document that does not fail the base rule passes. A null or empty text has no words and fails
    the base rule; its ratio is 0. Repeated rows and null doc_ids come back as given. Empty tables give no rows;
    extra columns are ignored.
    """
    model = written(ratio_model(docs, trusted))
    # A row's n-grams stay in its task, so the sum by row needs no shuffle of n-grams.
    counted = base_counts(docs.select("doc_id", "text")).drop("text").withColumn("row", F.monotonically_increasing_id())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = (
        exploded_cells(counted)
        .join(F.broadcast(model), "cell", "left")  # CELLS rows at most
        .groupBy("row", *names)
        .agg(F.round(F.coalesce(F.avg("ratio"), F.lit(0.0)), 6).alias("ratio"))
        .select(*names, failed.alias("base_failed"), "ratio")
    )
    if min_ratio is None:
        scored = written(scored)
        ends = quantile(scored, bad, BAD_BELOW), quantile(scored, trusted, GOOD_BELOW)
        min_ratio = min(ends) if None not in ends else float("-inf")
    return scored.select(*names, "base_failed", (~F.col("base_failed") & (F.col("ratio") >= min_ratio)).alias("kept"), "ratio")


def op10_quality_rules(spark, sf_dir):
    """Trusted: the documents that labels calls good (quality 1) and not toxic; bad: those of quality 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(documents(spark, sf_dir), labels.filter("quality = 1 AND coalesce(toxic, 0) = 0"), labels.filter("quality = 0"))
