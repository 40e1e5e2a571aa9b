"""16-bit PCM wave files as rows: decoding, ranges, clips and frame levels inside Arrow tasks."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import allowed_upload
from ..operators.silence import frame_levels

RATE = 16000


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of the uploads below a folder: known extensions, not empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(allowed_upload(F.col("path"), F.col("length"))).select("path", "length", "content")


def encode(samples: np.ndarray, rate: int = RATE) -> bytes:
    """A mono wave file of 16-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(np.asarray(samples) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def frame_count(content: bytes) -> int:
    with wave.open(io.BytesIO(content)) as w:
        return w.getnframes()


def decode(content: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """Samples start to end as -1 to 1, the mean of the channels; other widths and rates are refused."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2 or w.getframerate() != RATE:
            raise ValueError(f"needs 16-bit samples at {RATE} Hz, not {8 * w.getsampwidth()} at {w.getframerate()}")
        total = w.getnframes()
        a = min(max(start, 0), total)
        b = total if end is None else min(max(end, a), total)
        w.setpos(a)
        raw = np.frombuffer(w.readframes(b - a), dtype="<i2").astype(np.float32) / 32768
        return raw.reshape(-1, w.getnchannels()).mean(axis=1) if w.getnchannels() > 1 else raw


def clip(content: bytes, start: float, end: float, most: float = 300.0) -> bytes:
    """A wave file of the seconds from start to end, at most so many; a reversed range is empty.

    Samples are neither mixed nor changed: rate, width and channels are those of the source.
    """
    out = io.BytesIO()
    with wave.open(io.BytesIO(content)) as source, wave.open(out, "wb") as w:
        rate, total = source.getframerate(), source.getnframes()
        first = min(int(max(0.0, start) * rate), total)
        last = min(int(min(max(end, start, 0.0), max(0.0, start) + most) * rate), total)
        source.setpos(first)
        w.setparams(source.getparams()._replace(nframes=0))
        w.writeframes(source.readframes(max(0, last - first)))
    return out.getvalue()


def apply_regions(samples: np.ndarray, regions: list[tuple[int, int]], origin: int = 0) -> np.ndarray:
    """The kept slices of samples that begin at origin on the original clock; no regions keep all."""
    if not regions:
        return samples
    cut = [samples[min(max(s - origin, 0), len(samples)) : min(max(e - origin, 0), len(samples))] for s, e in regions]
    return np.concatenate(cut) if cut else samples[:0]


def sample_counts(files: DataFrame, key: str) -> DataFrame:
    """(key, samples, seconds) from the headers; files that are no waves have 0."""

    def run(batches):
        for batch in batches:
            counts = []
            for content in batch.column("content").to_pylist():
                try:
                    counts.append(frame_count(content))
                except (wave.Error, EOFError, struct.error):
                    counts.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array([c / RATE for c in counts])], names=[key, "samples", "seconds"])

    return files.select(key, "content").mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, samples long, seconds double")


def levels(files: DataFrame, key: str, frame: int = 320, highpass_hz: float = 0.0) -> DataFrame:
    """(key, frame_idx, db) of every frame."""

    def run(batches):
        for batch in batches:
            for i, content in enumerate(batch.column("content").to_pylist()):
                db = frame_levels(decode(content), frame, highpass_hz)
                keys = pa.array([batch.column(key)[i].as_py()] * len(db), batch.schema.field(key).type)
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(len(db))), pa.array(db)], names=[key, "frame_idx", "db"])

    return files.select(key, "content").mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, frame_idx long, db double")


def clips(requests: DataFrame, most: float = 300.0) -> DataFrame:
    """requests (key, content, start, end) with `clip`, a little wider than asked for."""

    def run(batches):
        for batch in batches:
            made = [clip(c, max(0.0, s - 0.15), e + 0.25, most) for c, s, e in zip(*(batch.column(x).to_pylist() for x in ("content", "start", "end")))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.binary())], names=["key", "clip"])

    return requests.select("key", "content", "start", "end").mapInArrow(run, f"key {dict(requests.dtypes)['key']}, clip binary")
