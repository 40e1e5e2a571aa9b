"""Stitching and collapsing: seconds, embeddings and notes, and the stream against the batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.config import EngineConfig
from voxloom.operators import voices
from voxloom.streaming import stitching


@pytest.fixture(scope="module")
def parts():
    rng = np.random.default_rng(6)
    who = rng.normal(size=(4, 16))
    out = []
    for rec in ("r", "s", "t"):
        for chunk in range(6):
            for k in range(rng.integers(1, 4)):
                voice = None if rng.random() < 0.2 else (who[(k * 7 + chunk) % 4] + rng.normal(0, 0.15, 16)).tolist()
                out.append((rec, chunk, k, f"S{k}", voice, float(rng.integers(1, 9)) if rng.random() < 0.9 else None))
    return out


SCHEMA = "rec_id string, chunk_idx long, ord int, label string, embedding array<double>, speech_sec double"


def test_voices_after_stitching(spark, parts):
    df = spark.createDataFrame(parts, SCHEMA)
    mapping = voices.stitch(df)
    told = {(r.rec_id, r.chunk_idx, r.label): (r.speaker, r.score) for r in mapping.collect()}
    assert len(told) == len(parts)
    got = {(r.rec_id, r.speaker): r for r in voices.merged_voices(df, mapping).collect()}
    for rec in ("r", "s", "t"):
        mine = [p for p in parts if p[0] == rec]
        for speaker in {told[rec, p[1], p[3]][0] for p in mine}:
            held = [p for p in mine if told[rec, p[1], p[3]][0] == speaker]
            unit = [np.array(p[4]) / np.linalg.norm(p[4]) for p in held if p[4]]
            row = got[rec, speaker]
            assert row.speech_sec == sum(p[5] or 0 for p in held)
            assert (row.embedding is None) == (not unit)
            if unit:
                mean = np.mean(unit, axis=0)
                assert np.allclose(row.embedding, mean / np.linalg.norm(mean))
    notes = {r.rec_id: r for r in voices.stitch_notes(mapping).collect()}
    for rec in ("r", "s", "t"):
        joined = sorted((c, label, *v) for (r, c, label), v in told.items() if r == rec and v[1] is not None)
        assert (notes[rec].chunks, notes[rec].joined) == (6, len(joined))
        first = ", ".join(f"chunk {c + 1}: {label} is {s} ({x:.2f})" for c, label, s, x in joined[:3])
        assert notes[rec].sample == first + (f" and {len(joined) - 3} more" if len(joined) > 3 else "")


def test_collapse_carries_seconds_and_voices(spark):
    a, b = np.eye(4)[0], np.eye(4)[1]
    rows = [("r", "S0", a.tolist(), 3.0), ("r", "S1", b.tolist(), 4.0), ("r", "S2", (a + 0.5 * b).tolist(), 1.0), ("r", "S3", None, 2.0), ("q", "S0", a.tolist(), None), ("q", "S1", a.tolist(), None)]
    df = spark.createDataFrame(rows, "rec_id string, label string, embedding array<double>, speech_sec double")
    none = spark.createDataFrame([], "rec_id string, a string, b string")
    got = {(r.rec_id, r.label): r for r in voices.collapse(df, none, EngineConfig(merge_threshold=0.8)).collect()}
    c = (a + 0.5 * b) / np.linalg.norm(a + 0.5 * b)
    assert (got["r", "S2"].root, got["r", "S2"].step, got["r", "S2"].embedding, got["r", "S2"].speech_sec) == ("S0", 1, None, None)
    assert got["r", "S2"].score == pytest.approx(float(a @ c))
    want = (3 * a + c) / np.linalg.norm(3 * a + c)
    assert got["r", "S0"].speech_sec == 4.0 and np.allclose(got["r", "S0"].embedding, want) and got["r", "S0"].step is None
    assert (got["r", "S1"].root, got["r", "S1"].speech_sec, got["r", "S3"].embedding, got["r", "S3"].speech_sec) == ("S1", 4.0, None, 2.0)
    assert got["q", "S1"].root == "S0" and np.allclose(got["q", "S0"].embedding, a) and got["q", "S0"].speech_sec == 0.0


def test_stream_of_chunks_is_the_batch(spark, parts, tmp_path):
    """Chunks come out of order, in several batches, one of them twice."""
    df = spark.createDataFrame(parts, SCHEMA)
    batch = {(r.rec_id, r.chunk_idx, r.label): (r.speaker, r.score) for r in voices.stitch(df).collect()}
    label = F.struct("label", "embedding", "speech_sec")
    chunks = df.groupBy("rec_id", "chunk_idx").agg(F.collect_list(label).alias("labels")).persist()
    source = str(tmp_path / "in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stitching.STATE_STORE)
    (tmp_path / "in").mkdir()
    stream = stitching.stitched(spark.readStream.schema(stitching.CHUNKS).json(source))
    for batch_of in ([0, 2], [1, 4], [1, 3, 5]):
        chunks.filter(F.col("chunk_idx").isin(batch_of)).coalesce(1).write.mode("append").json(source)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = [((r.rec_id, r.chunk_idx, r.label), (r.speaker, r.score)) for r in out.filter("kind = 'label'").collect()]
    assert len(got) == len(batch)
    for k, (speaker, score) in got:
        assert speaker == batch[k][0] and (score == pytest.approx(batch[k][1]) if score is not None else batch[k][1] is None)
    last = {(r.rec_id, r.speaker): r for r in sorted(out.filter("kind = 'voice'").collect(), key=lambda r: r.chunk_idx)}
    for r in voices.merged_voices(df, voices.stitch(df)).collect():
        mine = last[r.rec_id, r.speaker]
        assert mine.speech_sec == r.speech_sec and (mine.embedding is None) == (r.embedding is None)
        assert r.embedding is None or np.allclose(mine.embedding, r.embedding)
