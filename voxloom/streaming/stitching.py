"""Stitching as chunks arrive: the speakers of each recording are the state of a keyed stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import EngineConfig
from ..operators.voices import Stitcher, seconds_of

CHUNKS = "rec_id string, chunk_idx long, labels array<struct<label:string,embedding:array<double>,speech_sec:double>>"
STITCHED = "rec_id string, kind string, chunk_idx long, label string, speaker string, score double, embedding array<double>, speech_sec double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KNOWN = "due long, seconds array<double>, owners array<int>, vectors array<array<double>>"
LABELS = "labels array<struct<label:string,embedding:array<double>,speech_sec:double>>"


class ChunkStitcher(StatefulProcessor):
    """Takes the chunks of a recording in order; those that come early wait in the state, those that come again go."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", KNOWN)
        self.early = handle.getMapState("early", "chunk_idx long", LABELS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, seconds, owners, flat = self.known.get() if self.known.exists() else (0, [], [], [])
        vectors: list[list[np.ndarray]] = [[] for _ in seconds]
        for owner, v in zip(owners, flat):
            vectors[owner].append(np.array(v))
        stitcher, out = Stitcher(self.threshold, vectors, list(seconds)), []
        for pdf in rows:
            for r in pdf.itertuples():
                if r.chunk_idx >= due:
                    labels = [(x["label"], None if x["embedding"] is None else [float(y) for y in x["embedding"]], seconds_of(x["speech_sec"])) for x in r.labels]
                    self.early.updateValue((int(r.chunk_idx),), (labels,))
        first = due
        while self.early.containsKey((due,)):
            (labels,) = self.early.getValue((due,))
            told = stitcher.add([(x[0], x[1], x[2]) for x in labels])
            out += [(key[0], "label", due, *x, None, None) for x in told]
            self.early.removeKey((due,))
            due += 1
        if due > first:
            owners = [s for s, vs in enumerate(stitcher.vectors) for _ in vs]
            flat = [v.tolist() for vs in stitcher.vectors for v in vs]
            self.known.update((due, stitcher.seconds, owners, flat))
            out += [(key[0], "voice", due - 1, None, s, None, e, t) for s, e, t in stitcher.voices()]
        yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in STITCHED.split(", ")])

    def close(self) -> None:
        pass


def stitched(chunks: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """A stream of chunks (CHUNKS, one row each, numbered from 0 in a recording) as a stream of STITCHED rows.

    A row of kind label gives a label's speaker, once its chunk and all before it are there; rows of kind voice give
    every speaker's embedding and seconds after the chunk, the latest of which counts. Set the state store of the
    session to STATE_STORE.
    """
    stream = chunks.groupBy("rec_id").transformWithStateInPandas(ChunkStitcher(cfg.stitch_threshold), STITCHED, "Append", "None")
    return stream
