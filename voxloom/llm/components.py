"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours of each node (larger ones, or smaller ones) move to its smallest neighbour."""
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
    both = sides.join(least, "a")
    moved = both.filter("b > a").select(F.col("b").alias("a"), F.col("to").alias("b"))
    if not large:
        moved = both.select(F.col("b").alias("a"), F.col("to").alias("b")).unionByName(least.select("a", F.col("to").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches.

    Self-links and repeated links change nothing; nodes without a link are not listed.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            break
        before, old = after, now
        now = written(star(star(old, large=True), large=False))
        forget(old)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
