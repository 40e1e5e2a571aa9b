"""Runs of equal speaker names become transcript lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import WIDTH, Running, running

UNKNOWN = "Speaker ?"


def transcript(segments: DataFrame, displays: DataFrame, rec: str = "rec_id") -> DataFrame:
    """Lines (rec, line_idx, label, name, start, end, n_segments, text) of segments (rec, seg_idx, label, start, end, text).

    displays (rec, label, display) names the labels; a label without a display is `Speaker ?`. A line has the label
    and the start of its first segment, and the end of the last one that has an end other than 0; without any, 0.
    """
    named = segments.join(displays, [rec, "label"], "left").withColumn("name", F.coalesce("display", F.lit(UNKNOWN)))
    made = merge_lines(named, rec, ["seg_idx"], "name", "text", {"label": "first", "start": "first", "end": "last_set"})
    return made.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("start", "end")})


def merge_lines(segments: DataFrame, rec: str, order: list[str], name: str, text: str, carried: dict[str, str] | None = None, width: int = WIDTH) -> DataFrame:
    """One row for each run of segments with the same display name.

    Segments without text are skipped. Names compare after display names are set, so two labels of one
    person join. Returns rec, line_idx (from 0), name, n_segments and text, joined by spaces in order, and the
    carried columns as the run's first or last segment has them, or (last_set) the last one that is not null or 0.
    """
    kept = segments.filter(F.trim(F.col(text)) != "")
    seen = running(kept, [rec], order, width, {"_before": Running("last", F.struct(name), inclusive=False)})
    fresh = F.col("_before").isNull() | ~F.col(name).eqNullSafe(F.col(f"_before.{name}"))
    grouped = running(seen.withColumn("_new", fresh.cast("long")), [rec], order, width, {"_lines": Running("sum", F.col("_new"))})
    parts = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.trim(F.col(text)).alias("part"))))
    place = F.struct(*order)
    chosen = {
        "first": lambda c: F.min_by(c, place),
        "last": lambda c: F.max_by(c, place),
        "last_set": lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != 0), place)),
    }
    ends = [chosen[which](c).alias(c) for c, which in (carried or {}).items()]
    return grouped.groupBy(rec, (F.col("_lines") - 1).alias("line_idx"), name).agg(
        *ends,
        F.count("*").alias("n_segments"), F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("text")
    )
