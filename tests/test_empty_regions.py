"""Regions without length: they share an offset with the region after them."""

from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from voxloom.operators import timeline
from voxloom.plans import catalogue


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events that are regions of their own, as nearly all given ones are; every ninth and each user's last two are empty."""
    rows = []
    for user in range(15):
        for i in range(40):
            minutes = 0.0 if i % 9 == user % 9 or i >= 38 else 20.0 + (i * 7 + user) % 30
            rows.append((len(rows), datetime(2024, 1, 1) + timedelta(hours=12 * i, seconds=user), user, "view", minutes))
    folder = tmp_path_factory.mktemp("empty")
    table = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    table.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def same_as_sql(spark, events, name):
    got = catalogue.queries()[name](spark, str(events)).toPandas()
    with duckdb.connect() as duck:
        duck.execute("SET threads = 1")
        duck.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
        want = duck.execute(catalogue.oracle_sql()[name]).df()
    order = lambda x: x[sorted(want.columns)].sort_values(sorted(want.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
    return got


def test_spans_past_the_end(spark, events):
    got = same_as_sql(spark, events, "split_spans")
    assert (got.start == got.end).sum() > 100


def test_points_behind_empty_regions(spark, events):
    got = same_as_sql(spark, events, "to_original")
    assert got.original.duplicated().sum() > 50


@pytest.mark.parametrize("swap", [False, True])
def test_the_last_region_of_an_offset_counts(spark, swap):
    spans = [("r", 0, 5), ("r", 10, 10), ("r", 20, 20), ("r", 30, 34)]
    placed = timeline.offsets(spark.createDataFrame(spans, "rec_id string, start long, end long"))
    placed = placed.orderBy("start", ascending=swap)
    points = spark.createDataFrame([("r", p) for p in (4, 5, 7, 99)], "rec_id string, pos long")
    for first, want in ((False, [4, 30, 32, 34]), (True, [4, 10, 10, 10])):
        got = timeline.to_original(points, placed, first=first).orderBy("pos").collect()
        assert [r.original for r in got] == want
    spans = spark.createDataFrame([("r", 0, 7, 7), ("r", 1, 3, 7)], "rec_id string, span_id long, lo long, hi long")
    got = sorted((r.span_id, r.start, r.end) for r in timeline.split(spans, placed, 2).collect())
    assert got == [(0, 32, 32), (1, 3, 5), (1, 10, 10), (1, 20, 20), (1, 30, 32)]


def test_turns_over_empty_regions(spark, events):
    got = same_as_sql(spark, events, "restore_turns")
    assert (got.start == got.end).any()
    placed = timeline.offsets(spark.createDataFrame([("r", 0, 5), ("r", 10, 10), ("r", 30, 34)], "rec_id string, start long, end long"))
    turns = [("r", 0, 3, 7, "A"), ("r", 1, 5, 5, "A"), ("r", 2, 9, 12, "B"), ("q", 3, 1, 2, "A"), ("q", 4, 2, 2, "A")]
    turns = spark.createDataFrame(turns, "rec_id string, turn_idx long, start long, end long, speaker string")
    pieces = lambda **x: sorted((r.turn_idx, r.start, r.end) for r in timeline.restore_turns(turns, placed, 2, **x).collect())
    assert pieces() == [(0, 3, 5), (0, 30, 32), (3, 1, 2)]
    assert pieces(empty=True) == [(0, 3, 5), (0, 10, 10), (0, 30, 32), (3, 1, 2)]
