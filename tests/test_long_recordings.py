"""One recording over many tasks: running values in blocks, filters with carried state, waves read by spans."""

import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import intervals, lines, scans, silence, timeline
from voxloom.operators.scans import Running
from voxloom.sources import wav, wavespan


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(6)
    rows = [(k, a, a + rng.randint(0, 30), rng.choice([None, 1, 5, -3])) for k in ("r", "s", None) for a in (rng.randint(-2000, 2000) for _ in range(300))]
    return rows, spark.createDataFrame(rows, "rec_id string, start long, end long, v long").repartition(4)


@pytest.mark.parametrize("width", [1, 7, 500, 1 << 20])
def test_running_values(spark, spans, width):
    rows, df = spans
    df = df.dropDuplicates(["rec_id", "start", "end"])
    wanted = {
        "n": scans.count(), "sum": Running("sum", F.col("v")), "reach": Running("max", F.col("end"), inclusive=False),
        "low": Running("min", F.col("v")), "held": Running("last", F.col("v"), inclusive=False),
    }
    got = [tuple(r) for r in scans.running(df, ["rec_id"], ["start", "end"], width, wanted).collect()]
    want, seen = [], {}
    for k, s, e, v in sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[0]), r[1], r[2])):
        n, total, reach, low, held = seen.get(k, (0, 0, None, None, None))
        now = (n + 1, total + (v or 0), reach, low if v is None else v if low is None else min(low, v), held)
        want.append((k, s, e, v, *now))
        seen[k] = (now[0], now[1], e if reach is None else max(reach, e), now[3], held if v is None else v)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_recording_uses_many_tasks(spark):
    rows = spark.range(40000).select(F.lit("r").alias("rec_id"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 1 + F.col("id") % 3).alias("end"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = scans.running(rows, ["rec_id"], ["start", "end"], 3000, {"n": scans.count()}).withColumn("task", F.spark_partition_id())
        shares = [r["count"] for r in told.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(shares) == 4 and max(shares) < 20000


@pytest.mark.parametrize("width", [5, 400])
def test_blocks_change_no_result(spark, spans, width):
    _, df = spans
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    merge = lambda w: intervals.merge_regions(df, ["rec_id"], "start", "end", 4, w)
    assert same(merge(width), merge(1 << 20))
    regions = merge(1 << 20)
    assert same(timeline.offsets(regions, width=width), timeline.offsets(regions))
    frames = df.select("rec_id", F.col("start").alias("frame_idx")).distinct()
    assert same(intervals.runs(frames, ["rec_id"], "frame_idx", width), intervals.runs(frames, ["rec_id"], "frame_idx"))
    points = df.select("rec_id", F.col("v"), (F.col("start") + 3).alias("at"))
    marks = regions.select("rec_id", F.col("start").alias("mark"), "end")
    assert same(intervals.as_of(points, marks, ["rec_id"], "at", "mark", width), intervals.as_of(points, marks, ["rec_id"], "at", "mark"))
    told = df.select("rec_id", F.row_number().over(intervals_window()).alias("seg_idx"), F.concat(F.lit("n"), F.abs("v").cast("string")).alias("name"), F.lit("x").alias("text"))
    assert same(lines.merge_lines(told, "rec_id", ["seg_idx"], "name", "text", width=width), lines.merge_lines(told, "rec_id", ["seg_idx"], "name", "text"))


def intervals_window():
    from pyspark.sql import Window

    return Window.partitionBy("rec_id").orderBy("start", "end")


def sequential(x, hz, rate):
    """The filter sample by sample, from the steady state of the first one."""
    k = math.tan(math.pi * hz / rate)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    b, a1, a2 = (n, -2 * n, n), 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n
    z1, z2, out = -b[0] * x[0], b[0] * x[0], []
    for v in x:
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a1 * y + z2, b[2] * v - a2 * y
        out.append(y)
    return np.array(out)


def test_highpass_over_blocks_is_the_sequential_filter(spark):
    rng = np.random.default_rng(4)
    sounds = {"a": rng.normal(0, 0.3, 4000) + 0.4, "b": np.full(700, 0.25), None: rng.normal(0, 0.1, 1), "d": rng.normal(0, 1, 333)}
    rows = [(k, i // 64, x[i : i + 64].tolist()) for k, x in sounds.items() for i in range(0, len(x), 64)]
    df = spark.createDataFrame([r for r in rows if r[0]], "rec_id string, block long, samples array<double>").repartition(4)
    got = {(r.rec_id, r.block): r.samples for r in silence.highpass_blocks(df, 80.0, 16000, width=5).collect()}
    for k, x in sounds.items():
        want = sequential(x, 80.0, 16000)
        assert np.abs(silence.highpass(x, 80.0, 16000) - want).max() < 1e-9
        if k:
            mine = np.concatenate([got[k, i] for i in range(-(-len(x) // 64))])
            assert len(mine) == len(x) and np.abs(mine - want).max() < 1e-9
    tiny = spark.createDataFrame([("t", i, [float(v)]) for i, v in enumerate(sounds["d"][:40])], "rec_id string, block long, samples array<double>")
    one = [r.samples[0] for r in silence.highpass_blocks(tiny, 80.0, 16000, width=3).orderBy("block").collect()]
    assert np.abs(np.array(one) - sequential(sounds["d"][:40], 80.0, 16000)).max() < 1e-9


def test_block_levels(spark):
    x = np.random.default_rng(7).normal(0, 0.2, 1000)
    df = spark.createDataFrame([("r", i, x[i * 320 : i * 320 + 320].tolist()) for i in range(4)], "rec_id string, block long, samples array<double>")
    got = [(r.frame_idx, r.db) for r in silence.block_levels(df, 320, 80).orderBy("frame_idx").collect()]
    assert [i for i, _ in got] == list(range(12)) and np.allclose([d for _, d in got], silence.frame_levels(x, 80))
    with pytest.raises(ValueError):
        silence.block_levels(df, 320, 79)


@pytest.fixture(scope="module")
def waves(tmp_path_factory):
    top = tmp_path_factory.mktemp("waves")
    rng = np.random.default_rng(2)
    sounds = {}
    for name, n, channels in (("one", 300_000, 1), ("two", 150_001, 2), ("empty", 0, 1)):
        data = rng.integers(-32768, 32767, (n, channels)).astype("<i2")
        with wave.open(str(top / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(16000)
            w.writeframes(data.tobytes())
        sounds[str(top / f"{name}.wav")] = (data.astype(np.float32) / 32768).mean(axis=1)
    (top / "notes.txt").write_text("no sound")
    return top, sounds


def whole(rows, path):
    return np.concatenate([np.array(r.samples) for r in sorted((r for r in rows if r.path == path), key=lambda r: r.at)] or [np.zeros(0)])


def test_spans_make_the_whole(spark, waves):
    top, sounds = waves
    df = wavespan.read_spans(spark, f"file://{top}", span=wavespan.BLOCK)
    rows = df.collect()
    for path, x in sounds.items():
        assert np.allclose(whole(rows, path), x, atol=1e-7)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= 7
    path = next(iter(sounds))
    assert np.allclose(whole(wavespan.read_spans(spark, path).collect(), path), sounds[path], atol=1e-7)


def test_limits_prune_spans(spark, waves, monkeypatch):
    top, sounds = waves
    path = next(iter(sounds))
    for a, b in ((0, 10), (65_530, 65_540), (100_000, 290_000), (299_999, 400_000)):
        rows = wavespan.between(wavespan.read_spans(spark, f"file://{top}", span=wavespan.BLOCK), a, b).collect()
        for p, x in sounds.items():
            assert np.allclose(whole(rows, p), x[a:b], atol=1e-7)
    reader = wavespan.WaveReader({"path": f"file://{top}", "span": str(wavespan.BLOCK)})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    list(reader.pushFilters([EqualTo(("path",), path), GreaterThanOrEqual(("at",), wavespan.BLOCK), LessThan(("at",), 3 * wavespan.BLOCK)]))
    assert [(s.path, s.start, s.end) for s in reader.partitions()] == [(path, wavespan.BLOCK * k, wavespan.BLOCK * (k + 1)) for k in (1, 2)]


def test_only_the_bytes_of_a_span_are_read(waves):
    _, sounds = waves
    path = next(iter(sounds))

    class Counting:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            self.bytes += n
            return self.file.read_at(n, at)

    import pyarrow.fs as pafs

    with pafs.LocalFileSystem().open_input_file(path) as f:
        counted = Counting(f)
        assert wavespan.layout(counted) == wavespan.Layout(44, 300_000, 1) and counted.bytes < 100


def test_other_waves_are_refused(tmp_path):
    import pyarrow.fs as pafs

    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(44100)
        w.writeframes(b"\0\0" * 10)
    for name, content in (("x.wav", None), ("y.wav", b"RIFFxxxxWAVE"), ("z.wav", b"short")):
        if content:
            (tmp_path / name).write_bytes(content)
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f, pytest.raises(ValueError):
            wavespan.layout(f)


def test_kept_regions_across_borders(spark, waves):
    top, sounds = waves
    path, other = list(sounds)[:2]
    cuts = [(10, 20), (65_000, 140_000), (200_000, 200_001), (299_990, 300_000)]
    regions = timeline.offsets(spark.createDataFrame([(path, a, b) for a, b in cuts], "path string, start long, end long"), "path")
    rows = wavespan.kept(wavespan.read_spans(spark, f"file://{top}", span=wavespan.BLOCK), regions).collect()
    assert np.allclose(whole(rows, path), wav.apply_regions(sounds[path], cuts), atol=1e-7)
    assert np.allclose(whole(rows, other), sounds[other], atol=1e-7)
    placed = sorted((r.at, len(r.samples)) for r in rows if r.path == path)
    assert all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:]))


def test_headers_without_the_sound(spark, waves):
    top, sounds = waves
    files = spark.createDataFrame([(p,) for p in sounds] + [(str(top / "notes.txt"),)], "path string")
    got = {r.path: (r.samples, r.channels, r.seconds) for r in wavespan.headers(files, f"file://{top}").collect()}
    one, two, empty = sounds
    assert got == {one: (300_000, 1, 18.75), two: (150_001, 2, 150_001 / 16000), empty: (0, 1, 0.0), str(top / "notes.txt"): (0, 0, 0.0)}


def test_clips_are_wider_than_asked_for(spark):
    x = np.arange(64000) / 64000
    content = wav.encode(x)
    df = spark.createDataFrame([("a", content, 1.0, 2.0), ("b", content, 0.05, 0.5), ("c", content, 3.9, 9.0), ("d", content, 2.0, 1.0)], "key string, content binary, start double, end double")
    got = {r.key: wav.decode(r.clip) for r in wav.clips(df).collect()}
    whole = wav.decode(content)
    for key, a, b in (("a", 0.85, 2.25), ("b", 0.0, 0.75), ("c", 3.75, 4.0)):
        assert np.array_equal(got[key], whole[int(a * 16000) : int(b * 16000)])
    assert len(got["d"]) == 0
    assert len(wav.decode(next(iter(wav.clips(df.limit(1), most=0.5).collect())).clip)) == 8000


def test_slim_payloads(spark):
    from voxloom.sources import results

    row = spark.createDataFrame([("r", [1.0], [(0.0, "hi", [("hi", 0.0)])])], "rec_id string, embedding array<double>, segments array<struct<start:double,text:string,words:array<struct<word:string,start:double>>>>")
    (got,) = results.slim(row).collect()
    assert got.asDict(recursive=True) == {"rec_id": "r", "segments": [{"start": 0.0, "text": "hi"}]}
    assert results.slim(row.drop("segments")).columns == ["rec_id"]
