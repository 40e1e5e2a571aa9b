"""Interval algebra on DataFrames: islands, merging, joins by overlap, as-of lookups, overlapping pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .scans import WIDTH, Running, count, running


def runs(frames: DataFrame, keys: list[str], index: str, width: int = WIDTH) -> DataFrame:
    """Maximal runs of consecutive indexes per key, as half-open [start, end)."""
    marked = running(frames.select(*keys, index), keys, [index], width, {"_n": count()})
    islands = marked.withColumn("island", F.col(index) - F.col("_n"))
    return islands.groupBy(*keys, "island").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end")).drop("island")


def merge_regions(regions: DataFrame, keys: list[str], start: str, end: str, gap, width=WIDTH) -> DataFrame:
    """Regions join when one starts less than gap after the furthest end before it.

    How far the regions before reach is written to the shared folder, as two passes read it.
    """
    order = [start, end]
    reached = running(regions.select(*keys, start, end), keys, order, width, {"reach": Running("max", F.col(end), inclusive=False)})
    fresh = F.col("reach").isNull() | (F.col(start) - F.col("reach") >= gap)
    grouped = running(written(reached.select(*keys, start, end, fresh.cast("long").alias("fresh"))), keys, order, width, {"region": Running("sum", F.col("fresh"))})
    return grouped.groupBy(*keys, "region").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("region")


def buckets(start: Column, end: Column, width) -> Column:
    """The numbers of the time buckets that a half-open span touches."""
    last = F.greatest(F.floor(start / width), F.ceil(end / width) - 1)
    return F.sequence(F.floor(start / width), last)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width, how: str = "inner") -> DataFrame:
    """Pairs of spans that share time, by an equi-join on time buckets.

    left has l_start and l_end, right r_start and r_end. A pair is made in the first bucket it shares, so it
    appears once; long spans are dealt over many buckets instead of meeting in one task. With how="left", left
    rows without a partner appear once with nulls; left rows are told apart by all their columns.
    """
    a = left.withColumn("bucket", F.explode(buckets(F.col("l_start"), F.col("l_end"), width)))
    b = right.withColumn("bucket", F.explode(buckets(F.col("r_start"), F.col("r_end"), width)))
    met = a.join(b, [*keys, "bucket"]).filter(
        (F.col("l_start") < F.col("r_end"))
        & (F.col("r_start") < F.col("l_end"))
        & (F.col("bucket") == F.floor(F.greatest("l_start", "r_start") / width))
    )
    met = met.drop("bucket")
    if how == "inner":
        return met
    others = [c for c in right.columns if c not in keys]
    alone = left.join(met.select(left.columns).distinct(), left.columns, "left_anti")
    return met.select(*left.columns, *others).unionByName(alone, allowMissingColumns=True)


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, width=WIDTH, tie: Column | None = None) -> DataFrame:
    """points with the columns of the latest mark at or before each: no pairs are made.

    Of marks that are equal the one with the greatest tie counts; without a tie, any of them may.
    """
    carried = [c for c in marks.columns if c not in (*keys, mark)]
    m = marks.select(*keys, F.col(mark).alias("_at"), F.struct(mark, *carried).alias("_mark"), *([] if tie is None else [tie.alias("_tie")]))
    both = points.withColumns({"_at": F.col(at), "_is": F.lit(1)}).unionByName(m.withColumn("_is", F.lit(0)), allowMissingColumns=True)
    order = ["_at", "_is"] if tie is None else ["_at", "_is", "_tie"]
    held = running(both, keys, order, width, {"_found": Running("last", F.col("_mark"))}).filter("_is = 1")
    return held.select(*points.columns, *[F.col(f"_found.{c}").alias(c) for c in (mark, *carried)])


def overlap_pairs(turns: DataFrame, keys: list[str], label: str, least, width=WIDTH) -> DataFrame:
    """Seconds that two labels speak at once, for unordered pairs with `least` or more.

    No turns meet: how long a label has spoken until a time is a sum over its starts and ends before it, and the
    seconds that a turn of another label shares with it are the difference between the turn's end and start. Rows are
    as many as starts and ends, times the labels of a key. Keys are not null.
    """
    ends = F.inline(F.array(*[F.struct(F.col(c).alias("at"), F.lit(d).alias("step")) for c, d in (("start", 1), ("end", -1))]))
    events = turns.select(*keys, F.col(label).alias("b"), ends)
    labels = turns.select(*keys, F.col(label).alias("a")).distinct()
    marks = events.select(*keys, F.col("b").alias("a"), "at", "step")
    probes = events.join(labels, keys).filter("a < b").select(*keys, "a", "b", "at", (-F.col("step")).alias("sign"))
    both = marks.unionByName(probes, allowMissingColumns=True)
    count_ = Running("sum", F.coalesce("step", F.lit(0)).cast("long"))
    moment = Running("sum", F.coalesce(F.col("step") * F.col("at"), F.lit(0)))
    told = running(both, [*keys, "a"], ["at"], width, {"open": count_, "moment": moment}).filter("b IS NOT NULL")
    spoken = F.col("sign") * (F.col("at") * F.col("open") - F.col("moment"))
    return told.groupBy(*keys, "a", "b").agg(F.sum(spoken).alias("seconds")).filter(F.col("seconds") >= least)
