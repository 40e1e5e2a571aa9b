"""Documents to packed training sequences: the stages in order, each over all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import documents, maybe_in, written
from voxloom.llm.exact_dedup import exact_duplicates, normalised
from voxloom.llm.jaccard_join import jaccard_components
from voxloom.llm.language_id import fit, held_out, recognised
from voxloom.llm.packing import pack_documents
from voxloom.llm.secret_scan import mask_secrets

#: A document is rejected when it has no letter or no language reaches this calibrated probability.
MIN_LANGUAGE_SCORE = 0.5


def keyed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each row as one struct beside keys, and its doc_id as two columns that join without nulls: no name can clash."""
    ids = {"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))}
    return docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(k) for k, c in (ids | keys).items()])


def one_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with equal keys the one with the smallest text, as it came in."""
    return rows.groupBy(*keys).agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))


def recognise_language(spark, docs, sf_dir):
    """Keeps documents in one of the languages that the labelled documents have; the others go.

    A null text and a text without letters go. Repeated rows share their text's fate; null doc_ids teach as training
    rows. An empty table, or one that teaches no language, keeps nothing.
    """
    return recognised(docs, fit(docs.filter(~held_out())), MIN_LANGUAGE_SCORE)


def drop_exact_copies(spark, docs, sf_dir):
    """Of equal texts the row with the smallest doc_id stays; of its repeated rows, the one with the smallest raw text.

    Null texts count as empty. A null doc_id stays only where no equal text has a number. An empty table stays empty.
    """
    kept = exact_duplicates(docs).filter("kept").select("doc_id", "text_sha256").distinct()
    kept = written(kept.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_sha256").alias("sha")))
    first = one_of_each(keyed(docs, sha=F.sha2(normalised(F.col("text")), 256)), "no_id", "id", "sha")
    return first.join(kept, ["no_id", "id", "sha"], "left_semi").select("row.*")


def drop_near_copies(spark, docs, sf_dir):
    """Of each component of linked documents the row with the smallest doc_id stays, once; null ids come last.

    Texts without a word are in no component and stay as they came. Of a component without any doc_id, or with more
    texts of the smallest one, the smallest hash decides. An empty table stays empty. Only the texts of components of
    several rows move.
    """
    rows = jaccard_components(docs).filter("component IS NOT NULL").select("component", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")
    rows = written(rows)
    first = rows.groupBy("component").agg(F.min(F.struct("no_id", "id", "key")).alias("first"), F.count("*").alias("many"))
    first = written(first.filter("many > 1"))
    members = rows.join(first, "component").select("no_id", "id", "key", (F.struct("no_id", "id", "key") == F.col("first")).alias("stays")).distinct()
    members = written(members)
    tagged = keyed(docs, key=F.xxhash64("doc_id", "text"))
    may_be = maybe_in(members, "key", F.col("key"))
    alone = tagged.filter(~may_be).select("row.*")
    told = tagged.filter(may_be).join(members, ["no_id", "id", "key"], "left")
    single = told.filter("stays IS NULL").select("row.*")
    return alone.unionByName(single).unionByName(one_of_each(told.filter("stays"), "no_id", "id", "key").select("row.*"))


def hide_secrets(spark, docs, sf_dir):
    """Every document stays, its secrets replaced by the names of their kinds; null texts stay null."""
    return mask_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def pack(spark, docs, sf_dir):
    """The pieces of all documents with their places in sequences of 4096 tokens; a null text is its end id alone."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", recognise_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("best_fit_packing", pack),
]
#: The trained language model, merges and packing have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
