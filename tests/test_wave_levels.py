"""Levels behind the high-pass where the sound is made, a few blocks at a time."""

import numpy as np
import pyarrow as pa
import pytest

from voxloom.operators import silence
from voxloom.plans import catalogue


def test_levels_behind_the_high_pass_in_one_pass(spark, monkeypatch):
    """Levels from values that stand for samples are those of the samples themselves, however few a task takes at a time."""
    rng = np.random.default_rng(11)
    sounds = {"a": rng.normal(size=7 * 64 + 24), "b": rng.normal(size=64), "c": rng.normal(size=16) + 3, "d": np.zeros(130)}
    rows = [(k, i // 64, x[i : i + 64].tolist()) for k, x in sounds.items() for i in range(0, len(x), 64)]
    df = spark.createDataFrame(rows, "rec_id string, block long, samples array<double>").repartition(3)
    for part in (1, 3 * 64 * 10, 1 << 18):
        monkeypatch.setattr(silence, "PART", part)
        for hz in (80.0, 0.0):
            got = {(r.rec_id, r.frame_idx): r.db for r in silence.highpass_levels(df, hz, 16000, 640, 80, width=2, repeat=10).collect()}
            want = {(k, i): db for k, x in sounds.items() for i, db in enumerate(silence.frame_levels(np.repeat(x, 10), 80, hz))}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(silence, "PART", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([[0.0] * n for n in (3, 4, 4, 30, 1, 0, 2)], pa.list_(pa.float64()))], names=["samples"])
    parts = list(silence._parts(iter([batch, batch.slice(0, 0)]), 10))
    assert [[len(x) for x in xs] for _, xs in parts] == [[30, 40], [40], [300], [10, 0, 20]]
    assert [part.num_rows for part, _ in parts] == [2, 1, 1, 3]


def test_sound_of_wave_levels_stays_in_its_task(spark, monkeypatch):
    """The query hands a value for 40 samples to tasks, not the samples."""
    seen = []
    made = silence.highpass_levels
    monkeypatch.setattr(silence, "highpass_levels", lambda blocks, *a, **k: seen.append(blocks) or made(blocks, *a, **k))
    rows = catalogue.queries()["wave_levels"](spark, "/root/testdata/sf0.001").count()
    values = seen[0].selectExpr("sum(size(samples)) AS n").first().n
    assert values == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() and 0 < rows <= values // 8
