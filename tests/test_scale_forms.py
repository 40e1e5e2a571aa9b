"""Forms that spread one recording, one label or one profile over tasks, against plain loops and dense forms."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions.assign import assign_listed
from voxloom.operators import intervals, registry, silence, timeline, voices


def greedy(spans, limit):
    out, first, chunk = [], None, 0
    for s, e in spans:
        if first is None:
            first = s
        elif limit > 0 and e - first > limit:
            first, chunk = s, chunk + 1
        out.append(chunk)
    return out


@pytest.mark.parametrize("limit", [1, 40, 333.5, 100000])
def test_chunks_like_the_loop(spark, limit):
    rng = random.Random(limit)
    rows = []
    for k in ("r", "s", None):
        at = rng.randint(-50, 50)
        for _ in range(90):
            at += rng.randint(1, 30)
            rows.append((k, float(at), float(at := at + rng.randint(1, 60))))
    df = spark.createDataFrame(rows, "rec_id string, start double, end double").repartition(3)
    got = sorted(((r.rec_id or "", r.start, r.chunk_idx) for r in timeline.chunks(df, limit, width=100).collect()))
    want = []
    for k in ("r", "s", None):
        spans = [(s, e) for r, s, e in rows if r == k]
        want += [(k or "", s, c) for (s, _), c in zip(spans, greedy(spans, limit))]
    assert got == sorted(want)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(3)
    sounds = {"a": rng.normal(-40, 15, 501), "b": np.full(300, -100.0), "c": np.array([-3.25]), "d": np.r_[np.full(50, -20.0), rng.uniform(-20.01, -20, 49)], "e": rng.uniform(-50, -49.99, 2)}
    rows = [(k, float(v)) for k, x in sounds.items() for v in x] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "rec_id string, db double").repartition(3)
    got = {r.rec_id: r.p for r in silence.percentiles(df, "rec_id", "db", [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    want = {r.rec_id: r.p for r in df.filter("db IS NOT NULL").groupBy("rec_id").agg(F.percentile("db", F.array(*map(F.lit, [0.0, 0.1, 0.5, 0.95, 1.0]))).alias("p")).collect()}
    assert got.keys() == want.keys() == sounds.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


@pytest.mark.parametrize("width", [13, 100000])
def test_overlap_seconds_like_the_pairs(spark, width):
    rng = random.Random(9)
    turns = [(k, a, a + rng.randint(0, 80), rng.choice("XYZ")) for k in ("r", "s") for a in (rng.randint(0, 900) for _ in range(80))]
    want = {}
    for x, y in itertools.combinations(turns, 2):
        if x[0] == y[0] and x[3] != y[3] and min(x[2], y[2]) > max(x[1], y[1]):
            key = (x[0], *sorted((x[3], y[3])))
            want[key] = want.get(key, 0) + min(x[2], y[2]) - max(x[1], y[1])
    df = spark.createDataFrame(turns, "rec_id string, start long, end long, speaker string").repartition(3)
    got = {(r.rec_id, r.a, r.b): r.seconds for r in intervals.overlap_pairs(df, ["rec_id"], "speaker", 1, width).collect()}
    assert got == want


def test_many_turns_at_once_make_no_pairs(spark):
    """5,000 turns that all overlap: 25 million pairs, but rows in proportion to turns."""
    df = spark.range(5000).select(F.lit("r").alias("rec_id"), F.col("id").alias("start"), (F.col("id") + 100000).alias("end"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("speaker"))
    (r,) = intervals.overlap_pairs(df, ["rec_id"], "speaker", 1, 5000).collect()
    a, b = np.arange(0, 5000, 2), np.arange(1, 5000, 2)
    assert r.seconds == int((100000 - np.abs(a[:, None] - b[None, :])).sum())


def test_assignment_over_lists():
    rng = np.random.default_rng(8)
    for n, m in itertools.product(range(1, 5), range(1, 6)):
        for _ in range(10):
            s = rng.normal(size=(n, m)).round(1)
            rows = [dict(enumerate(map(float, r))) for r in s]
            keep = [dict(sorted(r.items(), key=lambda x: -x[1])[: max(n, 2)]) for r in rows]
            totals = []
            for r in (rows, keep):
                got = assign_listed(r)
                held = [c for c in got if c is not None]
                assert len(held) == len(set(held)) == min(n, m)
                totals.append(sum(s[i, c] for i, c in enumerate(got) if c is not None))
            best = max(sum(s[i, c] for i, c in zip(a, b)) for a in itertools.combinations(range(n), min(n, m)) for b in itertools.permutations(range(m), min(n, m)))
            assert totals == pytest.approx([best, best])
    assert assign_listed([{"a": 1.0}, {"a": 2.0}, {}]) == [None, "a", None] and assign_listed([]) == []


def test_few_profiles_leave_the_scores(spark, monkeypatch):
    monkeypatch.setattr(voices, "BLOCK", 5)
    rng = np.random.default_rng(2)
    labels = [(i // 4, f"S{i % 4}", 9.0, rng.normal(size=6).tolist()) for i in range(23)]
    profiles = [(f"p{i % 13:02d}", rng.normal(size=6).tolist()) for i in range(40)]
    left = spark.createDataFrame(labels, "rec_id long, label string, speech_sec double, embedding array<double>")
    right = spark.createDataFrame(profiles, "profile string, embedding array<double>")
    few = voices.candidates(left, right)
    counts = {(r.rec_id, r.label): r["count"] for r in few.groupBy("rec_id", "label").count().collect()}
    assert counts == {(i // 4, f"S{i % 4}"): 4 if i < 20 else 3 for i in range(23)}
    dense = voices.top2_scores(left, right, ["rec_id", "label"], "profile").withColumn("speech_sec", F.lit(9.0))
    rows = lambda df: sorted((r.rec_id, r.label, r.profile, round(r.score, 9), round(r.runner_up, 9), r.reason) for r in voices.match(df).collect())
    assert rows(few) == rows(dense)
    none = voices.candidates(left, right.limit(0))
    assert none.count() == 23 and {r.reason for r in voices.match(none).collect()} == {""}


def test_dense_numbers(spark):
    names = spark.range(500).select(F.concat(F.lit("Name "), F.col("id").cast("string")).alias("name"))
    got = {r.name: r.n for r in registry.numbered(names, "name", "n").collect()}
    import hashlib

    order = sorted(got, key=lambda x: hashlib.md5(x.encode()).hexdigest())
    assert [got[x] for x in order] == list(range(1, 501))


def test_words_amid_very_many_turns(spark):
    """4,000 turns around 4,000 words: a look-up each; words over the ends of turns meet those alone."""
    from voxloom.operators import attach

    turns = spark.range(4000).select(F.lit("r").alias("rec_id"), F.col("id").alias("turn_idx"), F.col("id").alias("start"), (F.col("id") + 50_000).alias("end"), F.concat(F.lit("S"), (F.col("id") % 7).cast("string")).alias("speaker"))
    words = spark.range(4000).select(F.lit("r").alias("rec_id"), F.col("id").alias("word_id"), (F.col("id") * 14 - 100).alias("start"), (F.col("id") * 14 - 95).alias("end"))
    got = {r.word_id: (r.speaker, r.overlap) for r in attach.best_overlap(words, turns, 1000).collect()}
    spans = [(i, i + 50_000) for i in range(4000)]
    for w in (0, 6, 7, 8, 9, 100, 300, 3000, 3570, 3579, 3700, 3860, 3862, 3863, 3999):
        s, e = w * 14 - 100, w * 14 - 95
        best = max((min(e, b) - max(s, a), -i) for i, (a, b) in enumerate(spans))
        assert got.get(w) == ((f"S{-best[1] % 7}", best[0]) if best[0] > 0 else None)
