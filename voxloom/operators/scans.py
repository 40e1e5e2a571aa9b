"""Running values over the ordered rows of a key, in two levels, so that one key may hold any share of the rows.

The order is cut into blocks of a width. Each block is summed up first; over the few summaries of a key runs a window
that gives what comes before each block; that becomes the first row of the block, and a window over (key, block) does
the rest. No task sees more of a key than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The width of a block where a caller names none: indexes, seconds or samples, whatever the order is in.
WIDTH = 1 << 20


@dataclass(frozen=True)
class Running:
    """A running value: how is sum, count, max, min or last (the latest that is not null)."""

    how: str
    value: Column
    inclusive: bool = True

    def whole(self, column: Column, place: Column) -> Column:
        """Of all rows of a block."""
        if self.how == "last":
            return F.max_by(column, F.when(column.isNotNull(), place))
        return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[self.how](column)

    def over(self, column: Column, window) -> Column:
        if self.how == "last":
            return F.last(column, ignorenulls=True).over(window)
        out = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[self.how](column).over(window)
        return F.coalesce(out, F.lit(0)) if self.how in ("sum", "count") else out


def count() -> Running:
    """How many rows there are up to and with this one."""
    return Running("count", F.lit(1).cast("long"))


def running(rows: DataFrame, keys: list[str], order: list[str], width, wanted: dict[str, Running]) -> DataFrame:
    """rows with a column for each wanted value over the rows up to each (or before it) in the order of its key.

    The first column of order is a number; rows that are equal in it are in one block. Keys may be null.
    """
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.floor(F.col(order[0]) / F.lit(width)).cast("long"), F.lit(-1 << 62))  # nulls come first
    held = rows.withColumns({"_block": at, "_side": F.lit(1)} | {f"_{name}": r.value for name, r in wanted.items()})
    place = F.struct(*order)
    sums = held.groupBy(*keys, "_block").agg(*[r.whole(F.col(f"_{name}"), place).alias(f"_{name}") for name, r in wanted.items()])
    carried = sums.select(*keys, "_block", F.lit(0).alias("_side"), *[r.over(F.col(f"_{name}"), before).alias(f"_{name}") for name, r in wanted.items()])
    both = held.unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_block").orderBy("_side", *order)
    frames = {r.inclusive: inside.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1) for r in wanted.values()}
    told = both.select(*rows.columns, "_side", *[r.over(F.col(f"_{name}"), frames[r.inclusive]).alias(name) for name, r in wanted.items()])
    return told.filter("_side = 1").drop("_side")


def _rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """(key, rest...) of each row, where the first columns are the key."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        yield from zip(zip(*columns[:keys]) if keys else [()] * batch.num_rows, *columns[keys:])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows (key, rest...) as batches."""
    while part := list(islice(rows, size)):
        flat = [(*r[0], *r[1:]) for r in part]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat), schema)], schema=schema)


def prefixes(elements: DataFrame, keys: list[str], index: str, width: int, compose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """elements (keys, index, element array<double>) with `before`: what the elements before each compose to.

    compose(one, two) joins an element and the next; it is associative. Null before the first one. The elements of a
    group of `width` indexes are joined, then the groups of a key, then each group goes through again from what comes
    before it. Rows stream by in order, so a task holds one element, and no task has more than a group, or the groups of
    a key.
    """
    kinds = dict(elements.dtypes)
    named, n = ", ".join(f"`{k}` {kinds[k]}" for k in keys), len(keys)
    dealt = elements.select(*keys, F.floor(F.col(index) / width).cast("long").alias("_group"), index, "element")
    as_arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))

    def listed(x: np.ndarray | None) -> list[float] | None:
        return None if x is None else x.tolist()

    def joined(held: np.ndarray | None, x: list[float]) -> np.ndarray:
        return np.array(x, dtype=float) if held is None else compose(held, np.array(x, dtype=float))

    total_ddl = f"{named}, _group long, element array<double>"
    total_schema, start_schema = as_arrow(total_ddl), as_arrow(f"{named}, _group long, before array<double>")
    out_ddl = f"{named}, `{index}` {kinds[index]}, before array<double>"
    out_schema = as_arrow(out_ddl)

    def total(batches):
        def rows():
            at, held = None, None
            for key, group, _, x in _rows(batches, n):
                if at is not None and at != (key, group):
                    yield (*at, held.tolist())
                    held = None
                at, held = (key, group), joined(held, x)
            if at is not None:
                yield (*at, held.tolist())

        return _batches(rows(), total_schema)

    def groups(batches):
        def rows():
            at, held = None, None
            for key, group, x in _rows(batches, n):
                held = held if at == key else None
                yield key, group, listed(held)
                at, held = key, joined(held, x)

        return _batches(rows(), start_schema)

    def again(batches):
        def rows():
            held = None
            for key, _, kind, i, x in _rows(batches, n):
                if kind == 0:  # the first row of a group tells what comes before it
                    held = None if x is None else np.array(x)
                else:
                    yield key, i, listed(held)
                    held = joined(held, x)

        return _batches(rows(), out_schema)

    in_groups = dealt.repartition(*keys, "_group").sortWithinPartitions(*keys, "_group", index)
    totals = in_groups.mapInArrow(total, total_ddl)
    starts = totals.repartition(*keys).sortWithinPartitions(*keys, "_group").mapInArrow(groups, f"{named}, _group long, before array<double>")
    first = starts.select(*keys, "_group", F.lit(0).alias("_kind"), F.lit(None).cast(kinds[index]).alias(index), F.col("before").alias("element"))
    both = first.unionByName(dealt.select(*keys, "_group", F.lit(1).alias("_kind"), index, "element"))
    return both.repartition(*keys, "_group").sortWithinPartitions(*keys, "_group", "_kind", index).mapInArrow(again, out_ddl)
