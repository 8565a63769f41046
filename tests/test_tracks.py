"""Obstacle tracks: batch and stream, and the rules one by one."""

import random
import time

import numpy as np
import pytest

from plinth.streaming import telemetry as X
from plinth.streaming import tracks as T

SIGHTING = "floor long, t double, id long, category string, x double, y double, confidence double, uncertainty double"


def test_obstacle_tracks(spark, tmp_path):
    person = [(1, t, i, "PERSON", t, 0.0, 0.9, 0.1) for i, t in enumerate((0.0, 0.5, 1.0, 1.5))]
    box = [(1, t, 10 + i, "UNCLASSIFIED", 20.0, 20.0, 0.5, 0.1) for i, t in enumerate((0.0, 1.0))]
    clear = [(1, t, 20 + i, None, 20.0, 20.0, 0.0, 1.0) for i, t in enumerate((2.0, 2.5, 3.0))]
    lost = [(2, 0.0, 30, "PERSON", 0.0, 0.0, 0.9, 0.1), (2, 11.0, 31, "UNCLASSIFIED", 50.0, 0.0, 0.9, 0.1), (None, 0.0, 32, "PERSON", 0.0, 0.0, 0.9, 0.1)]
    frame = spark.createDataFrame(person + box + clear + lost, SIGHTING)
    got = sorted((r["floor"], r["category"], r["hits"], r["status"]) for r in T.track_obstacles(frame).collect())
    assert got == [(1, "PERSON", 4, "MOVING"), (2, "UNCLASSIFIED", 1, "TENTATIVE")]
    for n in range(4):  # the same rows on a stream, a file after another
        frame.where(f"floor IS NULL OR cast(t as int) = {n} OR ({n} = 3 AND t > 3)").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    log = X.run_available(T.track_obstacles(stream), f"{tmp_path}/out")
    newest = log.groupBy("floor").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    assert sorted((r["floor"], r["category"], r["hits"], r["status"]) for r in log.join(newest, ["floor", "batch"]).collect()) == got


def feed(*frames):
    """frames: (t, [(category, x, y)] or, for a place seen clear, (None, x, y))."""
    tracks, n = np.zeros(0, T._STATE), 1
    for t, rows in frames:
        frame = np.array([(c is None, c == "PERSON", x, y, 0.8, 0.1 if c else 0.5) for c, x, y in rows], T._SEEN)
        tracks, n = T.advance(tracks, n, t, frame)
    return T._rows(1, tracks)


def states(rows):
    return sorted(zip(rows["category"], rows["hits"], rows["status"], strict=True))


O, P = "UNCLASSIFIED", "PERSON"


def test_two_sightings_confirm():
    assert states(feed((0.0, [(O, 0, 3)]))) == [(O, 1, "TENTATIVE")]
    assert states(feed((0.0, [(O, 0, 3)]), (0.25, [(O, 0.05, 3.02)]))) == [(O, 2, "STATIONARY")]


def test_a_person_who_stops_no_longer_moves():
    walk = [(0.0, [(P, -1, 3)]), (0.5, [(P, -0.5, 3)]), (1.0, [(P, 0, 3)])]
    assert states(feed(*walk)) == [(P, 3, "MOVING")]
    assert states(feed(*walk, *[(1.5 + k / 2, [(P, 0.02, 3)]) for k in range(3)])) == [(P, 6, "STATIONARY")]


def test_time_to_live():
    both = [(t, [(P, 0, 3), (O, 2, 6)]) for t in (0.0, 0.3)]
    assert states(feed(*both, (10.301, []))) == [(O, 2, "STATIONARY")]
    assert states(feed(*both, (30.301, []))) == []


def test_three_clear_looks_in_a_row_end_a_track():
    seen, look = [(t, [(O, 0, 3)]) for t in (0.0, 0.25)], [(1.0 + k, [(None, 0, 3.2)]) for k in range(3)]
    assert len(feed(*seen, *look[:2])) == 1 and len(feed(*seen, *look)) == 0
    assert len(feed(*seen, *look[:2], (4.0, [(O, 0, 3)]), (5.0, [(None, 0, 3)]))) == 1  # a sighting between them
    assert len(feed(*seen, *[(1.0 + k, [(None, 5, 3)]) for k in range(6)])) == 1  # clear elsewhere


def test_two_detectors_on_one_person_are_one_track():
    rows = feed((0.0, [(P, 0, 3), (O, 0.1, 3.05)]), (0.25, [(P, 0.02, 3), (O, 0.08, 3.1)]))
    assert states(rows) == [(P, 2, "STATIONARY")]
    assert len(feed(*[(t, [(O, 0, 3), (O, 0, 6), (O, 1.5, 4)]) for t in (0.0, 0.25)])) == 3


def test_nearest_pairs_go_first():
    apart = np.array([[0.5, 0.1], [0.4, 0.2]])
    assert T.one_to_one(apart, apart < 1).tolist() == [1, 0]
    assert T.one_to_one(apart, apart < 0.3).tolist() == [1, -1]
    assert T.one_to_one(np.zeros((0, 2)), np.zeros((0, 2), bool)).tolist() == []


def walk(frames, rows, seed=5):
    """Frames of up to `rows` sightings on a grid on which many distances are the same."""
    rng = random.Random(seed)
    return [(k * 0.25, [(rng.choice((O, O, P, None)), rng.randrange(17) * 0.7, rng.randrange(5) * 0.7) for _ in range(rng.randrange(rows + 1))]) for k in range(frames)]


@pytest.mark.parametrize("rows", [3, 40])
def test_loops_and_arrays_find_the_same_pairs(monkeypatch, rows):
    frames = walk(200, rows)
    loops = feed(*frames)
    monkeypatch.setattr(T, "MANY", 0)
    arrays = feed(*frames)
    assert len(loops) and loops.equals(arrays)


def test_small_frames_cost_microseconds(spark):
    """A floor is followed frame by frame, so the seconds of a busy floor are those of its frames."""
    n = 200_000
    rows = spark.range(n).selectExpr("1L AS floor", "id * 0.5 AS t", "id", "IF(id % 3 = 0, 'PERSON', 'UNCLASSIFIED') AS category", "id % 17 * 0.7 AS x", "id % 5 * 0.7 AS y", "0.5 AS confidence", "0.2 AS uncertainty")
    start = time.monotonic()
    assert T.track_obstacles(rows).count() > 0
    assert time.monotonic() - start < 20
