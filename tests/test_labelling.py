"""Naming speakers of results, wish by wish."""

from pyspark.sql import functions as F

from voxloom.operators import labelling

ENTRY = "rec_id string, label string, label_idx long, speaker_id long, display string, anon string, matched boolean, manual boolean, reason string, total_speech double, embedding array<double>"


def test_every_kind_of_wish(spark):
    rows = [
        ("r", "S0", 0, None, "Speaker A", "Speaker A", False, False, "", 9.0, [1.0, 0.0]),
        ("r", "S1", 1, 1, "Ann", None, True, False, "", 5.0, [0.0, 1.0]),
        ("r", "S2", 2, None, "Speaker B", "Speaker B", False, False, "low", 4.0, None),
        ("r", "S3", 3, 2, "Bo", None, True, False, "", 2.0, [1.0, 1.0]),
        ("q", "S0", 0, None, None, None, False, False, "", 1.0, [2.0, 0.0]),
    ]
    wishes = [("r", "S0", " bo ", None), ("r", "S1", " ", None), ("r", "S2", "Cy", None), ("r", "S9", "Dee", None), ("r", "S3", "x", 77), ("q", "S0", "ignored", 1)]
    speakers = spark.createDataFrame([(1, "Ann"), (2, "Bo")], "id long, name string").withColumns({"created_at": F.lit("x"), "updated_at": F.lit("x")})
    prints = [(1, 1, [0.5, 0.5], 2, "result:r:S1", 3.0), (2, 2, [0.1, 0.5], 2, "result:r:S0", 3.0), (3, 2, [0.1, 0.1], 2, "other", 3.0)]
    segments = spark.createDataFrame([("r", i, f"S{i}", float(i), i + 1.0, f"t{i}") for i in range(4)] + [("q", 0, "S0", 0.0, 1.0, "hi")], "rec_id string, seg_idx long, label string, start double, end double, text string")
    told = labelling.label_speakers(
        spark.createDataFrame(rows, ENTRY), spark.createDataFrame(wishes, "rec_id string, label string, name string, speaker_id long"), speakers,
        spark.createDataFrame(prints, "id long, speaker_id long, embedding array<double>, dim int, source string, speech_sec double"), segments, F.lit("now"),
    )
    assert sorted((r.id, r.name) for r in told.speakers.collect()) == [(1, "Ann"), (2, "Bo"), (3, "Cy")]
    got = {(r.rec_id, r.label): (r.speaker_id, r.display, r.matched, r.manual) for r in told.entries.collect()}
    assert got == {
        ("r", "S0"): (2, "bo", True, True), ("r", "S1"): (None, "Speaker C", False, False), ("r", "S2"): (3, "Cy", True, True),
        ("r", "S3"): (2, "Bo", True, False), ("q", "S0"): (1, "Ann", True, True),
    }
    kept = sorted((r.id, r.speaker_id, r.source, r.speech_sec) for r in told.voiceprints.collect())
    assert (3, 2, "other", 3.0) in kept and len(kept) == 3
    assert {(s, src, sec) for i, s, src, sec in kept if i > 3} == {(2, "result:r:S0", 9.0), (1, "result:q:S0", 1.0)}
    lines = [(r.rec_id, r.name, r.text) for r in told.lines.orderBy("rec_id", "line_idx").collect()]
    assert lines == [("q", "Ann", "hi"), ("r", "bo", "t0"), ("r", "Speaker C", "t1"), ("r", "Cy", "t2"), ("r", "Bo", "t3")]
