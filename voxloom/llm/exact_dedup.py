"""Exact deduplication by content-defined chunk recipes, in native SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, written

#: A chunk has CHUNK_MIN characters at least and ends where a word begins with one of CUT_LETTERS,
#: or else after CHUNK_MAX characters. The cuts depend on the text alone, so they realign after an insertion.
CHUNK_MIN, CHUNK_MAX, CUT_LETTERS = 512, 4096, "a-dA-D"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(norm: Column) -> Column:
    """The content-defined chunks of a text, in order; together they are the whole text."""
    pattern = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX}}}?(?<= [{CUT_LETTERS}])|.{{1,{CHUNK_MAX}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and recipe: for each chunk a 64-bit name and the SHA-256 that verifies it."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return norm.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(
            chunks(F.col("norm")),
            lambda c: F.struct(F.xxhash64(c).alias("name"), F.unhex(F.sha2(c, 256)).alias("digest")),
        ).alias("recipe"),
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """For each document the kept one of its group of equal texts.

    Every text is cut into content-defined chunks once. Chunks are deduplicated by (name, digest); a name
    that stands for two digests is no identifier, and documents that use one compare by digests instead.
    Documents are equal when their ordered identifier lists are equal: only those lists move, no text does.

    Null texts count as empty and equal each other. Of equal texts the smallest doc_id stays; repeated rows of
    one doc_id count as rows of their group and come back as often as given, all of them kept if that id is.
    A null doc_id never wins over a number; a group of null ids alone has a null keep_id and stays.
    An empty table gives no rows; extra columns are ignored.
    """
    prepared = written(recipes(docs))
    named = prepared.select(F.explode("recipe").alias("c")).select("c.name", "c.digest").distinct()
    unsafe = named.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    listed = prepared.select("doc_id", "text_sha256", F.col("recipe.name").alias("names"), F.col("recipe.digest").alias("digests"))
    if unsafe.limit(1).count():
        users = listed.select("text_sha256", F.explode("names").alias("name")).join(unsafe, "name", "left_semi")
        doubtful = users.select("text_sha256").distinct().withColumn("doubtful", F.lit(True))
        listed = listed.join(doubtful, "text_sha256", "left").withColumn("digests", F.when(F.col("doubtful"), F.col("digests")))
    else:
        listed = listed.withColumn("digests", F.lit(None).cast("array<binary>"))
    listed = listed.withColumn("recipe_key", F.xxhash64("names", "digests"))
    groups = listed.groupBy("recipe_key", "names", "digests").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    a, b = listed.alias("a"), groups.alias("b")
    same = (
        (F.col("a.recipe_key") == F.col("b.recipe_key"))
        & (F.col("a.names") == F.col("b.names"))
        & F.col("a.digests").eqNullSafe(F.col("b.digests"))
    )
    return a.join(b, same).select(
        "a.doc_id",
        "b.keep_id",
        "b.group_size",
        F.col("a.doc_id").eqNullSafe(F.col("b.keep_id")).alias("kept"),
        "a.text_sha256",
    )


def op1_exact_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
