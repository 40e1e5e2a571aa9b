"""Operators against plain loops on small made-up inputs, branch by branch."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.config import EngineConfig
from voxloom.functions import text as names
from voxloom.functions.assign import assign
from voxloom.functions.vectors import cosine, is_valid, normalise, pack, unpack
from voxloom.operators import attach, intervals, labels, lines, registry, silence, textfilter, timeline, voices
from voxloom.sources import results, wav


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return df.select(column).first()[0]


def test_assign_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        s = rng.normal(size=(n, m))
        got = assign(s)
        assert len(got) == min(n, m) == len({r for r, _ in got}) == len({c for _, c in got})
        if n <= m:
            best = max(sum(s[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = max(sum(s[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert sum(s[r, c] for r, c in got) == pytest.approx(best)
    assert assign(np.zeros((0, 3))) == []


def test_merge_regions_and_runs(spark):
    rng = random.Random(1)
    spans = sorted((a, a + rng.randint(0, 9)) for a in (rng.randint(0, 400) for _ in range(60)))
    want = []
    for s, e in spans:
        if want and s - want[-1][1] < 3:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    df = spark.createDataFrame([("r", s, e) for s, e in spans], "rec_id string, start long, end long")
    got = intervals.merge_regions(df, ["rec_id"], "start", "end", 3).orderBy("start").collect()
    assert [[r.start, r.end] for r in got] == want
    frames = spark.createDataFrame([("r", i) for i in (0, 1, 2, 5, 7, 8)], "rec_id string, frame_idx long")
    got = intervals.runs(frames, ["rec_id"], "frame_idx").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 3), (5, 6), (7, 9)]


def test_interval_join_pairs_once(spark):
    rng = random.Random(2)
    make = lambda n: [("r", i, a, a + rng.randint(1, 300)) for i in range(n) for a in [rng.randint(-100, 900)]]
    a, b = make(30), make(40)
    left = spark.createDataFrame(a, "rec_id string, i long, l_start long, l_end long")
    right = spark.createDataFrame(b, "rec_id string, j long, r_start long, r_end long")
    got = sorted((r.i, r.j) for r in intervals.interval_join(left, right, ["rec_id"], 50).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])


def test_timeline_maps(spark):
    regions = spark.createDataFrame([("r", 0, 2), ("r", 10, 14)], "rec_id string, start long, end long")
    placed = timeline.offsets(regions)
    points = spark.createDataFrame([("r", p) for p in (-1, 0, 1, 2, 5, 6, 9)] + [("other", 7)], "rec_id string, pos long")
    got = {(r.rec_id, r.pos): r.original for r in timeline.to_original(points, placed).collect()}
    # A place on the cut (2) is the start of the next region.
    assert got == {("r", -1): 0, ("r", 0): 0, ("r", 1): 1, ("r", 2): 10, ("r", 5): 13, ("r", 6): 14, ("r", 9): 14, ("other", 7): 7}
    spans = spark.createDataFrame([("r", 0, 1, 3), ("r", 1, 0, 6), ("r", 2, 5, 5)], "rec_id string, span_id long, lo long, hi long")
    got = sorted((r.span_id, r.start, r.end) for r in timeline.split(spans, placed, 2).collect())
    assert got == [(0, 1, 2), (0, 10, 11), (1, 0, 2), (1, 10, 14), (2, 13, 13)]


def test_chunks_keep_fractions_and_spans_without_regions(spark):
    df = spark.createDataFrame([("r", 0.5, 1.75), ("r", 2.25, 3.5), ("s", 0.25, 9.0)], "rec_id string, start double, end double")
    got = sorted(tuple(r) for r in timeline.chunks(df, 2.5).collect())
    assert got == [("r", 0, 0.5, 1.75), ("r", 1, 2.25, 3.5), ("s", 0, 0.25, 9.0)]
    spans = spark.createDataFrame([("t", 0, 3.0, 4.0)], "rec_id string, span_id long, lo double, hi double")
    assert [tuple(r) for r in timeline.split(spans, timeline.offsets(df), 2).collect()] == [("t", 0, 3.0, 4.0)]


def test_restore_segments(spark):
    placed = timeline.offsets(spark.createDataFrame([("r", 0.0, 2.0), ("r", 10.0, 14.0)], "rec_id string, start double, end double"))
    word = "array<struct<word:string,start:double,end:double>>"
    rows = [("r", 0, 2.3, 4.0, [("one", 2.3, 2.5), ("125", None, None)], "x"), ("r", 1, 0.5, 1.0, None, "y"), ("q", 0, 1.0, 2.0, [], "z")]
    df = spark.createDataFrame(rows, f"rec_id string, seg_idx long, start double, end double, words {word}, text string")
    got = {(r.rec_id, r.seg_idx): r for r in timeline.restore_segments(df, placed).collect()}
    first = got[("r", 0)]
    assert (first.start, first.end, first.text) == (pytest.approx(10.3), pytest.approx(12.0), "x")
    assert [(w.word, w.start and round(w.start, 6), w.end and round(w.end, 6)) for w in first.words] == [("one", 10.3, 10.5), ("125", None, None)]
    assert (got[("r", 1)].start, got[("r", 1)].words, got[("q", 0)].end, got[("q", 0)].words) == (0.5, None, 2.0, [])


def test_transcript_lines_have_times(spark):
    rows = [("r", 0, "S0", 1.0, 2.0, "one"), ("r", 1, "S1", 2.0, 3.0, "two"), ("r", 2, "S2", 3.0, 3.5, "three"), ("r", 3, "S0", 4.0, 9.0, " ")]
    df = spark.createDataFrame(rows, "rec_id string, seg_idx long, label string, start double, end double, text string")
    shown = spark.createDataFrame([("r", "S0", "Alex"), ("r", "S1", "Alex")], "rec_id string, label string, display string")
    got = [(r.label, r.name, r.start, r.end, r.text) for r in lines.transcript(df, shown).orderBy("line_idx").collect()]
    assert got == [("S0", "Alex", 1.0, 3.0, "one two"), ("S2", "Speaker ?", 3.0, 3.5, "three")]


def test_white_space_of_stock_phrases(spark):
    for space in (" ", "\u00a0", "\u3000"):
        assert one(spark, textfilter.cover_ratio(F.lit(f"thanks{space}for watching"))) == 1.0


def test_chunks_fold_and_grid(spark):
    spans = [(0, 5), (6, 9), (10, 12), (13, 40), (41, 42)]
    df = spark.createDataFrame([("r", s, e) for s, e in spans], "rec_id string, start long, end long")
    got = [r.chunk_idx for r in timeline.chunks(df, 10).orderBy("start").collect()]
    assert got == [0, 0, 1, 2, 3]
    assert {r.chunk_idx for r in timeline.chunks(df, 0).collect()} == {0}
    grid = timeline.grid(spark.createDataFrame([("r", 25)], "rec_id string, total long"), 10).orderBy("start").collect()
    assert [(r.start, r.end) for r in grid] == [(0, 10), (10, 20), (20, 25)]


def test_attach_against_loops(spark):
    rng = random.Random(5)
    spans = sorted((a, a + rng.randint(1, 80), rng.choice("XYZ")) for a in (rng.randint(0, 2000) for _ in range(40)))
    turns = [("r", i, s, e, k) for i, (s, e, k) in enumerate(spans)]
    words = [("r", i, a, a + 9) for i, a in enumerate(rng.randint(-200, 2300) for _ in range(200))]

    def told(ws, we):
        shared = [(min(we, e) - max(ws, s), -i, k) for _, i, s, e, k in turns]
        if max(shared)[0] > 0:
            return max(shared)[2]
        mid = (ws + we) / 2
        return min((max(s - mid, mid - e, 0), i, k) for _, i, s, e, k in turns)[2]

    t = spark.createDataFrame(turns, "rec_id string, turn_idx long, start long, end long, speaker string")
    w = spark.createDataFrame(words, "rec_id string, word_id long, start long, end long")
    got = {r.word_id: r.speaker for r in attach.attach(w, t, 50).collect()}
    assert got == {i: told(a, b) for _, i, a, b in words}
    assert {r.speaker for r in attach.attach(w, t.limit(0), 50).collect()} == {"SPEAKER_00"}


def test_split_segments_drops_untimed_words_only_where_it_splits(spark):
    rows = [
        ("r", 0, 0, "a", 0.0, 1.0, "X", "a b c"), ("r", 0, 1, "b", None, None, None, "a b c"), ("r", 0, 2, "c", 2.0, 3.0, "Y", "a b c"),
        ("r", 1, 0, "d", 4.0, 5.0, "X", "d e"), ("r", 1, 1, "e", None, None, None, "d e"),
    ]
    df = spark.createDataFrame(rows, "rec_id string, seg_idx long, word_idx long, word string, start double, end double, speaker string, segment_text string")
    got = sorted((r.seg_idx, r.part_idx, r.speaker, r.text) for r in attach.split_segments(df).collect())
    assert got == [(0, 0, "X", "a"), (0, 1, "Y", "c"), (1, 0, "X", "d e")]


def test_merge_lines_joins_by_name(spark):
    rows = [("r", 0, "Alex", "one"), ("r", 1, "Alex", "  "), ("r", 2, "Alex", "two"), ("r", 3, "Bo", "three"), ("r", 4, None, "x")]
    df = spark.createDataFrame(rows, "rec_id string, seg_idx long, name string, text string")
    got = [(r.name, r.text, r.n_segments) for r in lines.merge_lines(df, "rec_id", ["seg_idx"], "name", "text").orderBy("line_idx").collect()]
    assert got == [("Alex", "one two", 2), ("Bo", "three", 1), (None, "x", 1)]


def test_silence_plan_and_highpass(spark):
    rate, rng = 16000, np.random.default_rng(7)
    talk = lambda s: rng.normal(0, 0.2, int(s * rate))
    quiet = lambda s: rng.normal(0, 0.001, int(s * rate))
    x = np.concatenate([talk(3), quiet(6), talk(2), quiet(0.4), talk(2)])
    db = silence.frame_levels(x, 320)
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(db)], "rec_id string, frame_idx long, db double")
    totals = spark.createDataFrame([("r", len(x))], "rec_id string, total long")
    got = [(r.start / rate, r.end / rate) for r in silence.plan(df, totals, 320, rate, EngineConfig()).orderBy("start").collect()]
    assert got == [pytest.approx((0, 3.25), abs=0.05), pytest.approx((8.75, 13.4), abs=0.05)]
    flat = df.withColumn("db", F.lit(-20.0))
    assert silence.plan(flat, totals, 320, rate, EngineConfig()).count() == 0
    t = np.arange(rate) / rate
    for hz, least, most in ((20, -60, -20), (80, -3.3, -2.7), (800, -0.1, 0.1)):
        y = silence.highpass(np.sin(2 * np.pi * hz * t), 80, rate, block=4096)
        gain = 10 * np.log10((y[4000:] ** 2).mean() / 0.5)
        assert least < gain < most
    assert np.abs(silence.highpass(np.full(5000, 0.7), 80, rate)).max() < 1e-9


def test_wave_files(spark, tmp_path):
    x = np.round(np.random.default_rng(1).uniform(-0.9, 0.9, 32000) * 32768) / 32768
    content = wav.encode(x)
    assert wav.frame_count(content) == 32000
    assert np.allclose(wav.decode(content), x) and np.allclose(wav.decode(content, 100, 200), x[100:200])
    assert len(wav.decode(content, 40000)) == 0 and len(wav.decode(content, -5, 10**9)) == 32000
    with pytest.raises(ValueError):
        wav.decode(wav.encode(x, 44100))
    assert np.allclose(wav.decode(wav.clip(content, 0.5, 1.0)), x[8000:16000])
    assert wav.frame_count(wav.clip(content, 1.0, 0.5)) == 0 == wav.frame_count(wav.clip(content, 99.0, 100.0))
    assert len(wav.decode(wav.clip(content, -1.0, 0.5))) == 8000 and len(wav.decode(wav.clip(content, 0.0, 9.0, 1.0))) == 16000
    import io
    import wave

    two = io.BytesIO()
    with wave.open(two, "wb") as w:
        w.setparams((2, 3, 8000, 0, "NONE", ""))
        w.writeframes(bytes(range(240)) * 100)
    with wave.open(io.BytesIO(wav.clip(two.getvalue(), 0.1, 0.2))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (2, 3, 8000, 800)
        assert w.readframes(800) == (bytes(range(240)) * 100)[4800:9600]
    assert np.allclose(wav.apply_regions(x, [(0, 5), (10, 12)]), np.r_[x[:5], x[10:12]])
    (tmp_path / "a.WAV").write_bytes(content)
    (tmp_path / "b.txt").write_bytes(content)
    (tmp_path / "c.mp3").write_bytes(b"")
    (tmp_path / "d.wav").write_bytes(b"no wave")
    files = wav.scan(spark, str(tmp_path))
    got = {r.path[-5:]: r.samples for r in wav.sample_counts(files, "path").collect()}
    assert got == {"a.WAV": 32000, "d.wav": 0}


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, normalise(v(3, 4))) == [0.6, 0.8]
    assert one(spark, normalise(v(0, 0))) == [0.0, 0.0]
    assert one(spark, cosine(v(1, 0), v(1, 1))) == pytest.approx(0.7071, abs=1e-4)
    assert one(spark, cosine(v(1, 0), v(1, 1, 1))) == -1
    assert one(spark, pack(v(1, -2.5))) == np.array([1, -2.5], dtype="<f4").tobytes() and one(spark, unpack(pack(v(1, -2.5)))) == [1.0, -2.5]
    assert one(spark, unpack(F.lit(None).cast("binary"))) is None
    assert [one(spark, is_valid(x)) for x in (v(1, 2), v(0, 0), v(1, float("nan")), v(float("inf"), 1))] == [True, False, False, False]


def test_match_stitch_collapse(spark):
    scores = [("r", "a", 9.0, "p", 0.9), ("r", "a", 9.0, "q", 0.88), ("r", "b", 9.0, "p", 0.8), ("r", "b", 9.0, "q", 0.1), ("s", "a", 1.0, "p", 0.9), ("t", "x", 9.0, "p", 0.7), ("t", "y", 9.0, "p", 0.65)]
    df = spark.createDataFrame(scores, "rec_id string, label string, speech_sec double, profile string, score double")
    got = {(r.rec_id, r.label): (r.profile, r.matched, r.reason) for r in voices.match(df).collect()}
    # The best total gives q to a although p is closer; the runner-up p then rejects it.
    assert got[("r", "a")] == (None, False, "too_close") and got[("r", "b")] == ("p", True, "")
    assert got[("s", "a")] == (None, False, "too_short")
    assert got[("t", "x")] == ("p", True, "") and got[("t", "y")] == (None, False, "")
    odd = [("u", "a", 9.0, "p", -0.2), ("v", "a", 9.0, None, None), ("v", "b", 1.0, None, None), ("w", "x", 9.0, "p", 0.7), ("w", "y", 1.0, "p", 0.9)]
    got = {(r.rec_id, r.label): (r.profile, r.reason) for r in voices.match(spark.createDataFrame(odd, df.schema)).collect()}
    assert got == {("u", "a"): (None, "below_threshold"), ("v", "a"): (None, ""), ("v", "b"): (None, "too_short"), ("w", "x"): ("p", ""), ("w", "y"): (None, "too_short")}
    rng = np.random.default_rng(0)
    who = rng.normal(size=(3, 64))
    near = lambda k: [float(x) for x in who[k] + rng.normal(0, 0.1, 64)]
    parts = [("r", 0, 0, "S0", near(0), 3.0), ("r", 0, 1, "S1", near(1), 4.0), ("r", 1, 0, "S0", near(1), 4.0), ("r", 1, 1, "S1", near(0), 5.0), ("r", 2, 0, "S0", near(2), 5.0), ("r", 2, 1, "S1", None, 1.0)]
    df = spark.createDataFrame(parts, "rec_id string, chunk_idx int, ord int, label string, embedding array<double>, speech_sec double")
    got = {(r.chunk_idx, r.label): r.speaker[-1] for r in voices.stitch(df).collect()}
    assert got == {(0, "S0"): "0", (0, "S1"): "1", (1, "S0"): "1", (1, "S1"): "0", (2, "S0"): "2", (2, "S1"): "3"}
    voiceless = spark.createDataFrame([("r", 0, 0, "S0", None, 3.0), ("r", 0, 1, "S1", near(1), 4.0)], "rec_id string, chunk_idx int, ord int, label string, embedding array<double>, speech_sec double")
    assert {r.label: r.speaker for r in voices.stitch(voiceless).collect()} == {"S1": "SPEAKER_00", "S0": "SPEAKER_01"}
    v = spark.createDataFrame([("r", "S0", near(0), 5.0), ("r", "S1", near(1), 4.0), ("r", "S2", near(0), 5.0), ("r", "S3", None, 1.0)], "rec_id string, label string, embedding array<double>, speech_sec double")
    none = spark.createDataFrame([], "rec_id string, a string, b string")
    roots = lambda apart, cfg=EngineConfig(): {r.label: r.root for r in voices.collapse(v, apart, cfg).collect()}
    assert roots(none) == {"S0": "S0", "S1": "S1", "S2": "S0", "S3": "S3"}
    assert roots(spark.createDataFrame([("r", "S2", "S0")], "rec_id string, a string, b string"))["S2"] == "S2"
    assert roots(none, EngineConfig(merge_threshold=0.0))["S2"] == "S2"


def test_verdicts(spark):
    rows = [
        ("ha ha ha ha ha no", 0.0, 3.0, 0.9, "drop"), ("hahahahahahaha", 0.0, 3.0, 0.9, "drop"), ("Thanks for watching", 0.0, 3.0, 0.9, "suspect"),
        ("Thanks for watching", 0.0, 3.0, 0.05, "drop"), ("well", 0.0, 30.0, 0.9, "suspect"), ("We agreed on the plan for May", 0.0, 3.0, 0.9, "keep"),
        ("", 0.0, 3.0, 0.1, "keep"), (None, 0.0, 3.0, None, "keep"), ("so it is then", 0.0, 3.0, None, "keep"), ("low one here", 0.0, 3.0, 0.1, "suspect"),
    ]
    df = spark.createDataFrame(rows, "text string, start double, end double, score double, want string")
    told = textfilter.inspect(df)
    assert [(r.text, r.verdict) for r in told.collect()] == [(r[0], r[4]) for r in rows]
    assert textfilter.clean(told).count() == 7 and textfilter.clean(told, EngineConfig(drop_suspect=True)).count() == 4
    assert textfilter.clean(told, EngineConfig(drop_hallucination=False)).count() == 10


def test_glued_like_python(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", textfilter.glued(F.col("t")).alias("g")).collect():
        m = re.search(r"(.{1,3}?)\1{4,}", r.t.replace(" ", ""))
        assert (r.g.unit, r.g.length) == ((m[1], len(m[0])) if m else ("", 0))


def test_names(spark):
    cases = {" a/b:c. ": "a_b_c", "...": "X", "con": "X", "a \t b": "a _ b", "": "X", "é" * 120: "é" * 100}
    for raw, want in cases.items():
        assert one(spark, names.safe_name(F.lit(raw), F.lit("X"))) == want
    assert one(spark, names.safe_name(F.lit(None).cast("string"), F.lit("X"))) == "X"
    label = lambda i: one(spark, names.anonymous_label(F.lit(i)))
    assert [label(i) for i in (0, 25, 26, 701, 702)] == [f"Speaker {x}" for x in ("A", "Z", "AA", "ZZ", "AAA")]
    assert label(18277) == "Speaker ZZZ" and label(18278) == "Speaker AAAA" and label(26**4 + 18278) == "Speaker AAAAA"
    assert one(spark, names.default_name(F.lit("2024-03-05 23:59:00").cast("timestamp_ntz"))) == "2024-03-05"
    assert [one(spark, names.timestamp(F.lit(s))) for s in (0, 61.9, 360000)] == ["00:00:00", "00:01:01", "100:00:00"]
    assert one(spark, names.filter_chain(F.lit("VOICE"))).startswith("highpass") and one(spark, names.filter_chain(F.lit("a=1"))) == "a=1"
    assert one(spark, names.filter_chain(F.lit(""))) == ""


def test_registry(spark):
    s = spark.createDataFrame([(1, "Ann"), (2, "Bo")], "id long, name string").withColumns({"created_at": F.lit("x"), "updated_at": F.lit("x")})
    got = registry.upsert_speakers(s, spark.createDataFrame([("ann",), (" Cy ",), ("cy",), ("",)], "name string"), F.lit("y"))
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "Ann"), (2, "Bo"), (3, "Cy")]
    taken = spark.createDataFrame([("a",), ("a-2",), ("a-4",), ("b-2",)], "name string")
    got = {r.name: r.free for r in registry.free_names(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), taken).collect()}
    assert got == {"a": "a-3", "b": "b", "c": "c"}
    assert [r.name for r in registry.rename_speaker(s, 2, "Dee", F.lit("z")).orderBy("id").collect()] == ["Ann", "Dee"]


def test_window_starts(spark):
    t = spark.createDataFrame([("a", 10), ("b", 300), ("c", 40)], "rec_id string, total long")
    got = {}
    for r in labels.window_starts(t, 30, 5).orderBy("rec_id", "idx").collect():
        got.setdefault(r.rec_id, []).append(r.start)
    assert got["a"] == [0] and got["b"] == [int(270 * x) for x in np.linspace(0.05, 0.95, 5)] and got["c"] == [0]


def test_results_and_stages(spark, tmp_path):
    line = [(0, "S0", "Ann", "hi", 0.0, 1.0), (1, "S1", "Bo", "yes", 1.0, 2.0)]
    df = spark.createDataFrame([("r1", "2024-01-02", "en", 2.0, line), ("r2", "2024-01-03", "en", 2.0, [])], results.RESULT_SCHEMA)
    path = str(tmp_path / "results")
    results.save(df, path)
    (tmp_path / "results" / "part-bad.txt").write_text("{not json")
    back = results.load(spark, path)
    assert [(r.rec_id, r.line_count, r.speakers) for r in results.catalogue(back).collect()] == [("r2", 0, []), ("r1", 2, ["Ann", "Bo"])]
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "rec_id string, x int")
    keys = spark.createDataFrame([("r1", "k1"), ("r2", "k2")], "rec_id string, key_hash string")
    stage = str(tmp_path / "stages")
    assert results.load_stage(spark, stage, "align", keys) is None
    results.save_stage(rows, stage, "align", keys)
    changed = spark.createDataFrame([("r1", "k1"), ("r2", "new")], "rec_id string, key_hash string")
    assert [(r.rec_id, r.x) for r in results.load_stage(spark, stage, "align", changed).collect()] == [("r1", 1)]
    results.save_stage(rows.limit(0), stage, "empty", keys)
    assert {r.rec_id: r.stages for r in results.stages(spark, stage).collect()} == {"r1": ["align", "empty"], "r2": ["align", "empty"]}
    results.save_stage(rows.withColumn("x", F.col("x") + 10), stage, "align", keys)
    results.clear_stage(stage, "align", rows.filter("rec_id = 'r2'"))
    assert [(r.rec_id, r.x) for r in results.load_stage(spark, stage, "align", keys).collect()] == [("r1", 11)]
    assert {r.rec_id: r.stages for r in results.stages(spark, stage).collect()} == {"r1": ["align", "empty"], "r2": ["empty"]}
    twins = str(tmp_path / "texts")
    results.save_text(df, twins)
    results.save_text(df.filter("rec_id = 'r2'").withColumn("lines", F.array(F.struct(F.lit(0).cast("long").alias("line_idx"), F.lit("S").alias("speaker"), F.lit("Cy").alias("name"), F.lit("new").alias("text"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))), twins)
    assert {r.rec_id: r.text for r in results.load_text(spark, twins).collect()} == {"r1": "Ann : hi\nBo : yes\n", "r2": "Cy : new\n"}
    results.save(df.filter("rec_id = 'r1'").withColumn("language", F.lit("fr")), path)
    results.delete(df.filter("rec_id = 'r2'"), path)
    assert [(r.rec_id, r.language) for r in results.load(spark, path).collect()] == [("r1", "fr")]


def test_streaming_lines(spark, tmp_path):
    from voxloom.streaming import ingest

    source, store, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    rows = [("r", 0, "Ann", "one", "2024-01-01T00:00:00"), ("r", 1, "Ann", "two", "2024-01-01T00:01:00"), ("r", 2, "Bo", "three", "2024-01-01T00:02:00")]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, "rec_id string, seg_idx long, name string, text string, at string").coalesce(1).write.mode("append").json(source)
        q = ingest.keep_lines(ingest.arriving(spark, source), store, mark).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r.name, r.text) for r in ingest.lines_so_far(spark, store).orderBy("line_idx").collect()] == [("Ann", "one two"), ("Bo", "three")]


def test_config_from_env():
    cfg = EngineConfig.from_env({"MATCH_THRESHOLD": "0.7", "DROP_SUSPECT": "Yes", "MAX_VOICEPRINTS": "many"})
    assert (cfg.match_threshold, cfg.drop_suspect, cfg.max_voiceprints) == (0.7, True, 10)


def test_best_scores_over_blocks(spark, monkeypatch):
    """Blocks of four rows, some without a partner; null, zero and short vectors score -1."""
    from voxloom.operators import voices

    monkeypatch.setattr(voices, "BLOCK", 4)
    rng = np.random.default_rng(5)
    probes = [(i, rng.normal(size=3).tolist()) for i in range(11)] + [(11, None), (12, [0.0] * 3), (13, [1.0])]
    profiles = [(f"p{i % 5}" if i % 5 else None, rng.normal(size=3).tolist()) for i in range(14)]
    left = spark.createDataFrame(probes, "id long, embedding array<double>")
    right = spark.createDataFrame(profiles, "name string, embedding array<double>")
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if a and len(a) == 3 and any(a) else -1.0
    want = {(i, n): np.mean(sorted(cos(v, w) for m, w in profiles if m == n)[-2:]) for i, v in probes for n, _ in profiles}
    got = {(r.id, r.name): r.score for r in voices.top2_scores(left, right, ["id"], "name").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert voices.top2_scores(left.limit(0), right, ["id"], "name").count() == 0 == voices.top2_scores(left, right.limit(0), ["id"], "name").count()


def test_segments_keep_their_times_unless_they_split(spark):
    from voxloom.operators import attach

    turns = spark.createDataFrame([("r", 0, "A", 0.0, 10.0), ("r", 1, "B", 10.0, 20.0)], "rec_id string, turn_idx long, speaker string, start double, end double")
    segments = spark.createDataFrame([("r", 0, 0.5, 9.0, "One."), ("r", 1, 8.0, 13.0, "Two three."), ("r", 2, 15.0, 18.0, "Bare."), ("r", 3, 1.0, 2.0, " ")], "rec_id string, seg_idx long, start double, end double, text string")
    words = spark.createDataFrame(
        [("r", 0, 0, "One.", 1.0, 2.0), ("r", 1, 0, "Two", 8.5, 9.5), ("r", 1, 1, "three.", 11.0, 12.0), ("r", 2, 0, "Bare.", None, None)],
        "rec_id string, seg_idx long, word_idx long, word string, start double, end double",
    )
    got = attach.attach_segments(segments, words, turns, 60.0).orderBy("seg_idx", "part_idx").drop("rec_id").collect()
    assert [tuple(r)[1:7] for r in got] == [(0, 0, "A", 0.5, 9.0, "One."), (1, 0, "A", 8.5, 9.5, "Two"), (1, 1, "B", 11.0, 12.0, "three."), (2, 0, "B", 15.0, 18.0, "Bare.")]
    assert [r.place for r in got] == [0, 1, 2, 3]
    assert [[tuple(w) for w in r.words] for r in got] == [[("One.", 1.0, 2.0, "A")], [("Two", 8.5, 9.5, "A")], [("three.", 11.0, 12.0, "B")], []]


def test_single_speaker_falls_back_to_the_first_voice(spark):
    voice = [1.0]
    rows = [("r", 0, 9.0, None), ("r", 1, 1.0, voice), ("r", 2, 5.0, voice), ("s", 0, 2.0, voice), ("s", 1, 2.0, voice), ("t", 0, 1.0, None), ("u", 0, None, []), ("u", 1, None, voice), ("v", 0, None, voice), ("v", 1, 3.0, voice)]
    df = spark.createDataFrame(rows, "rec_id string, label long, speech_sec double, embedding array<double>")
    assert {r.rec_id: r.label for r in voices.single_speaker(df).collect()} == {"r": 1, "s": 0, "u": 1, "v": 1}


def test_lines_keep_the_last_end_that_is_set(spark):
    rows = [("r", 0, "S0", None, 1.0, "one"), ("r", 1, "S0", 1.0, None, "two"), ("r", 2, "S0", 2.0, 0.0, "three"), ("r", 3, "S1", 3.0, None, "four")]
    df = spark.createDataFrame(rows, "rec_id string, seg_idx long, label string, start double, end double, text string")
    shown = spark.createDataFrame([("r", "S0", "Ann"), ("r", "S1", "Bo")], "rec_id string, label string, display string")
    got = [(r.name, r.start, r.end) for r in lines.transcript(df, shown).orderBy("line_idx").collect()]
    assert got == [("Ann", 0.0, 1.0), ("Bo", 3.0, 0.0)]
