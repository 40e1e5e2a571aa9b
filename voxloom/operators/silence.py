"""Silence plans from frame levels: threshold, runs, filters, merging and padding."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources.shared import written
from .intervals import merge_regions, runs
from .scans import prefixes

EPS = 1e-10
LISTED = pa.list_(pa.float64())
#: Samples that a task makes or filters at a time (2 MB), whatever a batch has.
PART = 1 << 18


#: Levels of a recording are counted in cells of this width first.
CELL_DB = 1 / 64


def percentiles(values: DataFrame, key: str, value: str, at: list[float], cell: float = CELL_DB) -> DataFrame:
    """(key, p array<double>): exact percentiles between neighbouring ranks, without all values of a key in one place.

    A histogram of cells gives the cells that hold the two ranks of each percentile. Only their values, equal ones
    counted up before they move, are ordered, cell by cell. Nulls do not count; a key needs a value that is not null.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    counted = counted.withColumn("cell", F.floor(F.col(value) / F.lit(cell)))
    cells = counted.groupBy(key, "cell").agg(F.sum("n").alias("n"))
    by_key = Window.partitionBy(key)
    summed = cells.select(key, "cell", "n", F.sum("n").over(by_key).alias("all"), F.sum("n").over(by_key.orderBy("cell")).alias("up_to"))
    place = lambda p: F.lit(p) * (F.col("all") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), side(place(p)).cast("long").alias("rank")) for i, p in enumerate(at) for side in (F.floor, F.ceil)])
    wanted = summed.select(key, "cell", "all", (F.col("up_to") - F.col("n")).alias("before"), "up_to", F.explode(F.array_distinct(ranks)).alias("r"))
    wanted = wanted.filter((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("up_to")))
    held = wanted.groupBy(key, "cell", "all", "before").agg(F.collect_set("r").alias("ranks"))  # two ranks a percentile
    inside = Window.partitionBy(key, "cell").orderBy(value)
    near = counted.join(held, [key, "cell"]).withColumn("to", F.col("before") + F.sum("n").over(inside))
    found = near.select(key, "all", value, (F.col("to") - F.col("n")).alias("from"), "to", F.explode("ranks").alias("r"))
    found = found.filter((F.col("r.rank") >= F.col("from")) & (F.col("r.rank") < F.col("to")))
    picked = found.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("r", value))).alias("values"), F.first("all").alias("all"))
    exact = []
    for i, p in enumerate(at):
        lo, hi = F.floor(place(p)), F.ceil(place(p))
        low, high = (F.col("values")[F.struct(F.lit(i).alias("i"), x.cast("long").alias("rank"))] for x in (lo, hi))
        exact.append(F.when(lo == hi, low).otherwise((hi - place(p)) * low + (place(p) - lo) * high))
    return picked.select(key, F.array(*exact).alias("p"))


def thresholds(levels: DataFrame, min_dynamic_db: float, sensitivity: float, rec: str = "rec_id") -> DataFrame:
    """Per recording floor (p10), speech (p95), span, flat (too little range to cut) and thr."""
    p = percentiles(levels, rec, "db", [0.1, 0.95])
    base = p.select(rec, F.col("p")[0].alias("floor"), F.col("p")[1].alias("speech"))
    span = F.col("speech") - F.col("floor")
    return base.select(
        "*",
        span.alias("span"),
        (span < min_dynamic_db).alias("flat"),
        F.least(F.col("floor") + F.greatest(F.lit(6.0), span * sensitivity), F.col("speech") - 6.0).alias("thr"),
    )


def plan(levels: DataFrame, totals: DataFrame, frame: int, rate: int, cfg: EngineConfig, rec: str = "rec_id") -> DataFrame:
    """Kept regions in samples; recordings that stay whole have none.

    levels: rec, frame_idx, db; totals: rec, total. Runs above the threshold shorter than the least speech go
    before merging; merged runs are padded, clamped and joined where they touch. A recording stays whole if it
    lasts under a second, has too little range, keeps under a second, or keeps 98 % and more.
    """
    joined = written(_regions(written(_spoken(levels, totals, frame, rate, cfg, rec)), rate, cfg, rec))
    kept = joined.groupBy(rec).agg(F.sum(F.col("end") - F.col("start")).alias("kept"), F.first("total").alias("whole"))
    used = kept.filter((F.col("kept") >= rate) & (F.col("kept") < 0.98 * F.col("whole"))).select(rec)
    return joined.join(used, rec, "left_semi").select(rec, "start", "end")


def _spoken(levels: DataFrame, totals: DataFrame, frame: int, rate: int, cfg: EngineConfig, rec: str) -> DataFrame:
    """Runs above the threshold in samples, with the recording's total."""
    cut = thresholds(levels, cfg.trim_min_dynamic_db, cfg.trim_sensitivity, rec).filter("NOT flat").select(rec, "thr")
    loud = levels.join(cut, rec).filter("db > thr").select(rec, "frame_idx")
    found = runs(loud, [rec], "frame_idx").join(totals, rec).filter(F.col("total") >= rate)
    return found.select(rec, "total", (F.col("start") * frame).alias("start"), F.least(F.col("end") * frame, "total").alias("end"))


def _regions(spoken: DataFrame, rate: int, cfg: EngineConfig, rec: str) -> DataFrame:
    """Runs that last, merged over short gaps, padded and joined."""
    long_enough = spoken.filter(F.col("end") - F.col("start") >= cfg.trim_min_speech_sec * rate)
    merged = merge_regions(long_enough, [rec, "total"], "start", "end", cfg.trim_min_silence_sec * rate)
    pad = max(round(cfg.trim_pad_sec * rate), round(cfg.trim_pad_floor_sec * rate))
    padded = merged.select(rec, "total", F.greatest(F.col("start") - pad, F.lit(0)).alias("start"), F.least(F.col("end") + pad, "total").alias("end"))
    return merge_regions(padded, [rec, "total"], "start", "end", 1)


def notes(levels: DataFrame, totals: DataFrame, frame: int, rate: int, cfg: EngineConfig, rec: str = "rec_id") -> DataFrame:
    """(rec, note): why a recording of totals stayed whole.

    narrow_range, no_speech, too_short (every run) or under_a_second (what would be kept); null where silence was cut,
    where there is too little of it, and for recordings under a second.
    """
    flat = thresholds(levels, cfg.trim_min_dynamic_db, cfg.trim_sensitivity, rec).select(rec, "flat")
    spoken = written(_spoken(levels, totals, frame, rate, cfg, rec))
    length = F.col("end") - F.col("start")
    longest = spoken.groupBy(rec).agg(F.max(length).alias("longest"))
    kept = _regions(spoken, rate, cfg, rec).groupBy(rec).agg(F.sum(length).alias("kept"))
    why = (
        F.when(F.col("total") < rate, None)
        .when(F.col("flat"), "narrow_range")
        .when(F.col("longest").isNull(), "no_speech")
        .when(F.col("longest") < cfg.trim_min_speech_sec * rate, "too_short")
        .when(F.col("kept") < rate, "under_a_second")
    )
    whole = totals.join(flat, rec, "left").join(longest, rec, "left").join(kept, rec, "left")
    return whole.select(rec, why.alias("note"))


class Highpass:
    """A second-order Butterworth high-pass as a linear recurrence with a state of two numbers.

    The impulse response dies out (poles at radius 0.98 for 80 Hz), so a block's answer from no state is a product of
    spectra; what a state adds is two fixed sequences. The state after n samples is a matrix times the state before,
    plus the state that the block leaves from none.
    """

    def __init__(self, hz: float, rate: int):
        k = math.tan(math.pi * hz / rate)
        norm = 1 / (1 + math.sqrt(2) * k + k * k)
        self.b = np.array([norm, -2 * norm, norm])
        self.a = np.array([2 * (k * k - 1) * norm, (1 - math.sqrt(2) * k + k * k) * norm])
        self.step = np.array([[-self.a[0], 1.0], [-self.a[1], 0.0]])
        self.spectra: dict[int, np.ndarray] = {}  # of the response, by the size of a product
        taps = max(64, int(math.log(1e-16) / math.log(math.sqrt(self.a[1]))))
        one = self.b[1:] - self.a * self.b[0]  # the state after a single sample
        self.response, self.after = np.empty(taps), np.empty((taps, 2))
        self.response[0], row = self.b[0], np.array([1.0, 0.0])
        for i in range(taps):
            if i:
                self.response[i] = self.after[i - 1] @ one
            self.after[i], row = row, row @ self.step

    def start(self, first: float) -> np.ndarray:
        """The state in which a constant input gives nothing."""
        return np.array([-self.b[0], self.b[0]]) * first

    def run(self, x: np.ndarray, state: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """The filtered samples from a state, with the tail of each block of the product carried over."""
        taps, block = len(self.response), max(1, min(block, len(x)))
        out, size = np.zeros(len(x) + taps - 1), 1 << (block + taps - 1).bit_length()
        if size not in self.spectra:
            self.spectra[size] = np.fft.rfft(self.response, size)
        spectrum = self.spectra[size]
        for at in range(0, len(x), block):
            part = x[at : at + block]
            y = np.fft.irfft(np.fft.rfft(part, size) * spectrum, size)[: len(part) + taps - 1]
            out[at : at + len(y)] += y
        out = out[: len(x)]
        n = min(taps, len(x))
        out[:n] += self.after[:n] @ state
        return out

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The state after samples x that gave y (from no state, if there are fewer than two)."""
        x, y = (np.concatenate([np.zeros(2), v[-2:]])[-2:] for v in (x, y))
        pushed = self.b[1:, None] * x - self.a[:, None] * y  # rows: for the next sample and the one after
        return np.array([pushed[0, 1] + pushed[1, 0], pushed[1, 1]])

    def element(self, x: np.ndarray) -> np.ndarray:
        """What a block does to a state: the matrix, row by row, and the state it leaves from none."""
        return np.concatenate([np.linalg.matrix_power(self.step, len(x)).ravel(), self.left(x, self.run(x, np.zeros(2)))])

    @staticmethod
    def compose(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        later = two[:4].reshape(2, 2)
        return np.concatenate([(later @ one[:4].reshape(2, 2)).ravel(), later @ one[4:] + two[4:]])


def highpass(x: np.ndarray, hz: float, rate: int, block: int = 1 << 16) -> np.ndarray:
    """Samples behind a high-pass that starts in the steady state of the first one."""
    if hz <= 0 or not len(x):
        return x
    f = Highpass(hz, rate)
    # A constant gives nothing, so the first sample can be taken off throughout, and no state is left to start with.
    return f.run(x.astype(float) - float(x[0]), np.zeros(2), block)


def _parts(batches: Iterator[pa.RecordBatch], repeat: int = 1) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with the samples of each, so many rows at a time that they have PART samples or are one."""
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column("samples")).to_numpy(zero_copy_only=False)) * repeat
        at = 0
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")) - at)
            part = b.slice(at, n)
            yield part, [np.repeat(x.values.to_numpy(zero_copy_only=False), repeat) for x in part.column("samples")]
            at += n


def _behind(blocks: DataFrame, hz: float, rate: int, rec: str, width: int, repeat: int, made: Callable[[pa.RecordBatch, list[np.ndarray]], pa.RecordBatch], ddl: str) -> DataFrame:
    """What is made of the rows of blocks and their samples behind the high-pass (see highpass_blocks)."""
    kinds = dict(blocks.dtypes)
    kind = f"`{rec}` {kinds[rec]}, block {kinds['block']}"
    rows = blocks.select(rec, "block", F.col("samples").cast("array<double>").alias("samples"))
    if hz <= 0:
        return rows.mapInArrow(lambda batches: (made(part, xs) for part, xs in _parts(batches, repeat)), ddl)

    def first_pass(batches):
        f = Highpass(hz, rate)
        for part, xs in _parts(batches, repeat):
            elements = []
            for x, block in zip(xs, part.column("block").to_pylist()):
                element = f.element(x)
                if block == 0:  # the state before it is known, so what it leaves depends on nothing
                    element = np.concatenate([np.zeros(4), element[:4].reshape(2, 2) @ f.start(x[0]) + element[4:]])
                elements.append(element.tolist())
            yield pa.RecordBatch.from_arrays([part.column(rec), part.column("block"), pa.array(elements, LISTED)], names=[rec, "block", "element"])

    def second_pass(batches):
        f = Highpass(hz, rate)
        for part, xs in _parts(batches, repeat):
            yield made(part, [f.run(x, np.array(before[4:]) if before else f.start(x[0])) for x, before in zip(xs, part.column("before").to_pylist())])

    before = prefixes(rows.mapInArrow(first_pass, f"{kind}, element array<double>"), [rec], "block", width, Highpass.compose)
    return rows.join(before, [rec, "block"]).select(rec, "block", "samples", "before").mapInArrow(second_pass, ddl)


def highpass_blocks(blocks: DataFrame, hz: float, rate: int, rec: str = "rec_id", width: int = 4096) -> DataFrame:
    """blocks (rec, block, samples) of recordings behind the high-pass, as if each recording were one array.

    Blocks are numbered from 0 and not empty. They give what they do to the filter's state; these compose over the
    blocks of a recording (scans.prefixes); then every block runs from the state before it. There is no warm-up, and no
    task holds more than a batch of blocks or `width` states. Block 0 begins in the steady state of its first sample.
    """
    if hz <= 0:
        return blocks.select(rec, "block", F.col("samples").cast("array<double>").alias("samples"))
    kinds = dict(blocks.dtypes)

    def made(part, ys):
        return pa.RecordBatch.from_arrays([part.column(rec), part.column("block"), pa.array(ys, LISTED)], names=[rec, "block", "samples"])

    return _behind(blocks, hz, rate, rec, width, 1, made, f"`{rec}` {kinds[rec]}, block {kinds['block']}, samples array<double>")


def highpass_levels(blocks: DataFrame, hz: float, rate: int, size: int, frame: int, rec: str = "rec_id", width: int = 4096, repeat: int = 1) -> DataFrame:
    """The block_levels of highpass_blocks, without filtered samples that leave their task.

    Each value of `samples` stands for `repeat` samples, which a task makes for a few blocks at a time; rate, size and
    frame count these.
    """
    return _behind(blocks, hz, rate, rec, width, repeat, _levels_of(rec, size, frame), f"`{rec}` {dict(blocks.dtypes)[rec]}, frame_idx long, db double")


def _levels_of(rec: str, size: int, frame: int) -> Callable[[pa.RecordBatch, list[np.ndarray]], pa.RecordBatch]:
    if size % frame:
        raise ValueError(f"a block of {size} samples has no whole number of frames of {frame}")

    def made(part, ys):
        dbs = [frame_levels(y, frame) for y in ys]
        counts = [len(db) for db in dbs]
        index = [block * (size // frame) + np.arange(n) for block, n in zip(part.column("block").to_pylist(), counts)]
        keys = part.column(rec).take(pa.array(np.repeat(np.arange(len(dbs)), counts)))
        return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(index)), pa.array(np.concatenate(dbs))], names=[rec, "frame_idx", "db"])

    return made


def block_levels(blocks: DataFrame, size: int, frame: int, rec: str = "rec_id") -> DataFrame:
    """(rec, frame_idx, db) of blocks (rec, block, samples) of `size` samples, a multiple of frame; the last may be shorter."""
    made = _levels_of(rec, size, frame)
    ddl = f"`{rec}` {dict(blocks.dtypes)[rec]}, frame_idx long, db double"
    return blocks.select(rec, "block", "samples").mapInArrow(lambda batches: (made(part, xs) for part, xs in _parts(batches)), ddl)


def frame_levels(samples: np.ndarray, frame: int, hz: float = 0.0, rate: int = 16000) -> np.ndarray:
    """dBFS of each whole frame; a rest shorter than a frame is left out."""
    x = highpass(samples, hz, rate)
    n = len(x) // frame
    framed = np.asarray(x[: n * frame], dtype=float).reshape(n, frame)
    return 10 * np.log10(np.einsum("ij,ij->i", framed, framed) / frame + EPS)
