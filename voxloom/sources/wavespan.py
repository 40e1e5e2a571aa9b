"""Wave files read by spans: one task for each range of a file, which opens only its bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.intervals import interval_join

RATE, WIDTH = 16000, 2
#: Samples of a row, and of a task where none are named (some 32 MB of a file with one channel).
BLOCK, SPAN = 1 << 16, 1 << 24
FORMAT = "wave_spans"


@dataclass
class Layout:
    """Where the samples of a file are."""

    at: int
    frames: int
    channels: int


def layout(file: pa.NativeFile) -> Layout:
    """The layout by the headers of a RIFF file's chunks; other widths and rates are refused."""
    size = file.size()
    if file.read_at(4, 0) != b"RIFF" or file.read_at(4, 8) != b"WAVE":
        raise ValueError("not a wave file")
    at, channels = 12, 0
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read_at(16, at + 8))
            if bits != 8 * WIDTH or rate != RATE:
                raise ValueError(f"needs {8 * WIDTH}-bit samples at {RATE} Hz, not {bits} at {rate}")
        if name == b"data" and channels:
            return Layout(at + 8, min(length, size - at - 8) // (WIDTH * channels), channels)
        at += 8 + length + length % 2
    raise ValueError("a wave file without samples")


@dataclass
class Span(InputPartition):
    """A task: the blocks of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


class WaveReader(DataSourceReader):
    """Plans by the sizes of files alone; tasks read the headers. Limits on path and at prune spans and blocks."""

    def __init__(self, options: dict[str, str]):
        self.path, self.span = options["path"], max(BLOCK, int(options.get("span", SPAN)) // BLOCK * BLOCK)
        self.low, self.high, self.only = 0, 1 << 62, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take note of limits; Spark tests every row again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("at",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            yield f

    def partitions(self) -> list[Span]:
        system, root = pafs.FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        files = system.get_file_info(pafs.FileSelector(root, recursive=True)) if found.type == pafs.FileType.Directory else [found]
        spans = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == pafs.FileType.File and f.path.lower().endswith(".wav") and (self.only is None or f.path in self.only):
                most = min(f.size // WIDTH, self.high)  # of one channel; with more of them the last spans are empty
                first = self.low // self.span * self.span
                spans += [Span(f.path, max(a, self.low), min(a + self.span, most)) for a in range(first, most, self.span)]
        return spans or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        system, _ = pafs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as file:
            where = layout(file)
            step = WIDTH * where.channels
            for at in range(-(-partition.start // BLOCK) * BLOCK, min(partition.end, where.frames), BLOCK):
                raw = file.read_at((min(at + BLOCK, where.frames) - at) * step, where.at + at * step)
                samples = np.frombuffer(raw, dtype="<i2").astype(np.float32) / 32768
                if where.channels > 1:
                    samples = samples.reshape(-1, where.channels).mean(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path]), pa.array([at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples, pa.float32()))],
                    names=["path", "at", "samples"],
                )


class WaveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, at long, samples array<float>"

    def reader(self, schema) -> WaveReader:
        return WaveReader(self.options)


def read_spans(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """(path, at, samples): the blocks of a wave file, or of all below a folder, at multiples of BLOCK samples.

    path is a URI or an absolute path on a file system that all executors reach. A task has `span` samples; samples
    are the mean of the channels, from -1 to 1. Filters on path and at are pushed down.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WaveSource)
    return spark.read.format(FORMAT).option("span", str(span)).load(path)


def headers(files: DataFrame, uri: str, path: str = "path") -> DataFrame:
    """(path, samples, channels, seconds) of files (path, ...) on the file system of a URI, from a few bytes of each.

    Files that are no waves of this width and rate have 0 samples.
    """

    def run(batches):
        system, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            found = []
            for name in batch.column(path).to_pylist():
                with system.open_input_file(name) as file:
                    try:
                        found.append(layout(file))
                    except (ValueError, struct.error):
                        found.append(Layout(0, 0, 0))
            counts = [x.frames for x in found]
            columns = [batch.column(path), pa.array(counts, pa.int64()), pa.array([x.channels for x in found], pa.int32()), pa.array([n / RATE for n in counts])]
            yield pa.RecordBatch.from_arrays(columns, names=[path, "samples", "channels", "seconds"])

    return files.select(path).mapInArrow(run, f"`{path}` string, samples long, channels int, seconds double")


def between(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """The blocks that hold samples start to end, cut to them; only their bytes are read."""
    near = blocks.filter((F.col("at") > start - BLOCK) & (F.col("at") < end))
    skip = F.greatest(F.lit(start) - F.col("at"), F.lit(0)).cast("int")
    rest = F.greatest(F.least(F.lit(end) - F.col("at"), F.size("samples")) - skip, F.lit(0)).cast("int")
    cut = near.select("path", (F.col("at") + skip).alias("at"), F.slice("samples", skip + 1, rest).alias("samples"))
    return cut.filter(F.size("samples") > 0)


def kept(blocks: DataFrame, placed: DataFrame, rec: str = "path") -> DataFrame:
    """(rec, at, samples) on the kept clock: the parts of blocks (rec, at, samples) inside the regions.

    placed: rec, start, end and offset, as timeline.offsets gives them. Blocks of recordings without regions stay.
    Blocks and regions meet by time, so a recording is dealt over tasks.
    """
    spans = blocks.select(rec, F.col("at").alias("l_start"), (F.col("at") + F.size("samples")).alias("l_end"), "samples").filter("l_end > l_start")
    regions = placed.select(rec, F.col("start").alias("r_start"), F.col("end").alias("r_end"), "offset")
    low, high = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    met = interval_join(spans, regions, [rec], BLOCK)
    # Spark may test the cut of pairs that do not meet before it drops them.
    cut = F.slice("samples", (low - F.col("l_start") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    inside = met.select(rec, (F.col("offset") + low - F.col("r_start")).alias("at"), cut.alias("samples"))
    whole = blocks.join(placed.select(rec).distinct(), rec, "left_anti").select(rec, "at", "samples")
    return inside.unionByName(whole)
