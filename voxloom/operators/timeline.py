"""The clock of kept regions and the original clock, and maps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, written
from .intervals import as_of, interval_join
from .scans import WIDTH, Running, count, running


def offsets(regions: DataFrame, rec: str = "rec_id", width=WIDTH) -> DataFrame:
    """regions (rec, start, end) with region_idx, offset (kept time before the region) and length."""
    length = F.col("end") - F.col("start")
    placed = running(regions.select(rec, "start", "end"), [rec], ["start", "end"], width, {"n": count(), "kept": Running("sum", length)})
    return placed.select(rec, (F.col("n") - 1).alias("region_idx"), "start", "end", (F.col("kept") - length).alias("offset"), length.alias("length"))


def span(regions: DataFrame, totals: DataFrame, rec: str = "rec_id") -> DataFrame:
    """(rec, start, end) from the first to the last of what is kept; recordings without regions span their total."""
    ends = regions.groupBy(rec).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = totals.select(rec, "total").join(ends, rec, "left")
    kind = totals.schema["total"].dataType
    return whole.select(rec, F.coalesce("start", F.lit(0).cast(kind)).alias("start"), F.coalesce("end", "total").alias("end"))


def stats(regions: DataFrame, totals: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Original, kept and removed time and the number of regions; recordings without regions are kept whole."""
    kept = regions.groupBy(rec).agg(F.sum(F.col("end") - F.col("start")).alias("kept"), F.count("*").alias("regions"))
    out = totals.join(kept, rec, "left").withColumns(
        {"kept": F.coalesce("kept", "total"), "regions": F.coalesce("regions", F.lit(0))}
    )
    return out.select(
        rec,
        ((F.col("regions") > 0) & (F.col("kept") < F.col("total"))).alias("enabled"),
        F.round(F.col("total").cast("double"), 2).alias("original"),
        F.round(F.col("kept").cast("double"), 2).alias("kept"),
        F.round((F.col("total") - F.col("kept")).cast("double"), 2).alias("removed"),
        "regions",
    )


def to_original(points: DataFrame, placed: DataFrame, rec: str = "rec_id", width=WIDTH, first: bool = False) -> DataFrame:
    """points (rec, pos on the kept clock, ...) with `original`.

    A place on a cut belongs to the region after it; places before the start or past the end are held at the first
    start and the last end. Recordings without regions keep their clock. Regions that share an offset are empty but for
    the last, which counts; with first=True the first one does, and holds all places up to the next offset.
    """
    clean = points.withColumn("_pos", F.greatest(F.col("pos"), F.lit(0)))
    tie = F.struct(-F.col("start"), -F.col("end")) if first else F.struct("start", "end")
    found = as_of(clean, placed.select(rec, "offset", "start", "end"), [rec], "_pos", "offset", width, tie)
    moved = F.least(F.col("start") + F.col("_pos") - F.col("offset"), F.col("end"))
    return found.select(*points.columns, F.coalesce(moved, F.col("pos")).alias("original"))


def split(spans: DataFrame, placed: DataFrame, width, rec: str = "rec_id", first: bool = False) -> DataFrame:
    """The pieces on the original clock of spans (rec, span_id, lo, hi) on the kept clock, one for each region.

    Spans are clamped to the kept time; an empty span gives the one point it maps to (first: see to_original). Spans of
    recordings without regions stay as they are.
    """
    clamped, whole = _clamped(spans, placed, rec)
    points = to_original(clamped.filter("l_end <= l_start").select(rec, "span_id", F.col("l_start").alias("pos")), placed, rec, first=first)
    points = points.select(rec, "span_id", F.col("original").alias("start"), F.col("original").alias("end"))
    return _pieces(clamped, placed, width, rec).unionByName(points).unionByName(whole)


def _clamped(spans: DataFrame, placed: DataFrame, rec: str) -> tuple[DataFrame, DataFrame]:
    """Spans (l_start, l_end) within the kept time, and those of recordings without regions as they are."""
    kept = placed.groupBy(rec).agg(F.sum("length").alias("_kept"))
    whole = spans.join(kept, rec, "left_anti").select(rec, "span_id", F.col("lo").alias("start"), F.col("hi").alias("end"))
    clamped = spans.join(kept, rec).select(
        rec,
        "span_id",
        F.least(F.greatest(F.col("lo"), F.lit(0)), "_kept").alias("l_start"),
        F.least(F.greatest(F.col("hi"), F.lit(0)), "_kept").alias("l_end"),
    )
    return clamped, whole


def _pieces(clamped: DataFrame, placed: DataFrame, width, rec: str) -> DataFrame:
    """The pieces of spans that are not empty; a region without length inside a span gives an empty one."""
    regions = placed.select(
        rec, F.col("offset").alias("r_start"), (F.col("offset") + F.col("length")).alias("r_end"), F.col("start").alias("r_from")
    )
    met = interval_join(clamped.filter("l_end > l_start"), regions, [rec], width)
    shift = F.col("r_from") - F.col("r_start")
    return met.select(
        rec, "span_id", (shift + F.greatest("l_start", "r_start")).alias("start"), (shift + F.least("l_end", "r_end")).alias("end")
    )


def restore_segments(segments: DataFrame, placed: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Segments (rec, seg_idx, start, end, words) of the kept clock on the original one, their words as well.

    words are structs with start and end; null times stay null, as do null and empty lists of words.
    """
    rest = [c for c in segments.columns if c not in ("start", "end", "words")]
    fields = [f.name for f in segments.schema["words"].dataType.elementType.fields]
    words = segments.select(*rest, F.posexplode("words").alias("_i", "_w")).select(*rest, "_i", "_w.*")
    ends = lambda x, name: F.struct(F.lit(name).alias("end"), F.col(x).alias("pos"))
    spans = segments.select(rec, "seg_idx", F.lit(-1).alias("_i"), "start", "end").unionByName(words.select(rec, "seg_idx", "_i", "start", "end"))
    points = spans.select(rec, "seg_idx", "_i", F.inline(F.array(ends("start", "start"), ends("end", "end")))).withColumnRenamed("end", "_end")
    moved = to_original(points.filter("pos IS NOT NULL"), placed, rec)
    both = moved.groupBy(rec, "seg_idx", "_i").agg(*[F.max(F.when(F.col("_end") == x, F.col("original"))).alias(f"_{x}") for x in ("start", "end")])
    put = lambda x: F.col(f"_{x}").cast(segments.schema[x].dataType).alias(x)
    timed = words.drop("start", "end").join(both, [rec, "seg_idx", "_i"], "left").withColumns({"start": put("start"), "end": put("end")})
    listed = timed.groupBy(rec, "seg_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.struct(*fields).alias("w")))), lambda x: x["w"]).alias("_words"))
    own = both.filter("_i = -1").drop("_i")
    out = segments.drop("start", "end").join(own, [rec, "seg_idx"], "left").join(listed, [rec, "seg_idx"], "left")
    return out.select(*rest, put("start"), put("end"), F.coalesce("_words", "words").alias("words")).select(segments.columns)


def restore_turns(turns: DataFrame, placed: DataFrame, width, rec: str = "rec_id", empty: bool = False) -> DataFrame:
    """Turns (rec, turn_idx, start, end, speaker) of the kept clock as pieces on the original clock, none empty.

    With empty=True a region without length inside a turn gives a piece too; turns within no kept time never do.
    """
    spans = turns.select(rec, F.col("turn_idx").alias("span_id"), F.col("start").alias("lo"), F.col("end").alias("hi"))
    clamped, whole = _clamped(spans, placed, rec)
    pieces = _pieces(clamped, placed, width, rec)
    pieces = (pieces if empty else pieces.filter("end > start")).unionByName(whole.filter("end > start"))
    named = turns.select(rec, F.col("turn_idx").alias("span_id"), "speaker")
    return pieces.join(named, [rec, "span_id"]).select(rec, F.col("span_id").alias("turn_idx"), "start", "end", "speaker")


def chunks(regions: DataFrame, limit, rec: str = "rec_id", width=WIDTH) -> DataFrame:
    """(rec, chunk_idx, start, end): a chunk begins when it would last more than limit from its first start.

    A region longer than limit stays whole; limit 0 or less puts all in one chunk. Where the next chunk begins is a
    function of the region that a chunk begins with: the one after the last that ends in time. Pointer doubling finds
    the regions that the first one leads to, twice as many a round; so a recording is dealt over tasks throughout.
    Regions are in order and do not overlap. Runs its rounds at once and writes their tables to the shared folder.
    """
    numbered = running(regions.select(rec, "start", "end"), [rec], ["start", "end"], width, {"_i": count()})
    if limit <= 0:
        return numbered.select(rec, F.lit(0).alias("chunk_idx"), "start", "end")
    numbered = written(numbered)
    ends = numbered.groupBy(rec, F.col("end").alias("mark")).agg(F.max("_i").alias("_last"))
    led = as_of(numbered.withColumn("_until", F.col("start") + limit), ends, [rec], "_until", "mark", width)
    to = F.greatest(F.coalesce("_last", F.lit(0)), F.col("_i")) + 1
    size = numbered.groupBy(F.col(rec).alias("_s")).agg(F.max("_i").alias("_most"))
    jumps = led.select(F.col(rec).alias("_r"), F.col("_i").alias("_a"), to.alias("_b"))
    jumps = written(jumps.join(size, F.col("_r").eqNullSafe(F.col("_s"))).filter("_b <= _most").select("_r", "_a", "_b"))
    begins = written(size.select(F.col("_s").alias("_r"), F.lit(1).cast("long").alias("_a")))
    while True:
        a, b = begins.alias("x"), jumps.alias("y")
        met = F.col("x._r").eqNullSafe(F.col("y._r")) & (F.col("x._a") == F.col("y._a"))
        found = written(a.join(b, met).select(F.col("x._r").alias("_r"), F.col("y._b").alias("_a")))
        if found.isEmpty():
            break
        older, begins = begins, written(begins.unionByName(found))
        one, two = jumps.alias("x"), jumps.alias("y")
        further = F.col("x._r").eqNullSafe(F.col("y._r")) & (F.col("x._b") == F.col("y._a"))
        longer = written(one.join(two, further).select(F.col("x._r").alias("_r"), F.col("x._a").alias("_a"), F.col("y._b").alias("_b")))
        forget(found, older, jumps)
        jumps = longer
    first = begins.select("_r", F.col("_a").alias("_first"))
    told = numbered.join(first, F.col(rec).eqNullSafe(F.col("_r")) & (F.col("_i") == F.col("_first")), "left")
    fresh = F.col("_first").isNotNull().cast("long")
    placed = running(told.select(rec, "start", "end", fresh.alias("_new")), [rec], ["start", "end"], width, {"_n": Running("sum", F.col("_new"))})
    return placed.select(rec, (F.col("_n") - 1).cast("int").alias("chunk_idx"), "start", "end")


def grid(totals: DataFrame, limit, rec: str = "rec_id") -> DataFrame:
    """Chunks of fixed length for recordings without regions."""
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(limit)))
    return totals.select(rec, "total", first.alias("start")).select(
        rec, F.floor(F.col("start") / limit).cast("int").alias("chunk_idx"), "start", F.least(F.col("start") + limit, "total").alias("end")
    )
