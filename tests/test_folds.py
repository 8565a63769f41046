"""Folds over sessions go from batch to batch and never hold a session."""

import random

import pytest

from plinth.operators.sequences import clean_trajectory, suppress_repeats


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def streamed(found):
    plan = found._jdf.queryExecution().executedPlan().toString()
    return "FlatMapGroupsInPandas" not in plan and "FlatMapGroupsInArrow" not in plan and "MapInArrow" in plan


def sessions(rng):
    """One session with most rows, some small ones and one without a number."""
    return [None if i % 50 == 0 else 1 if rng.random() < 0.8 else rng.randrange(2, 6) for i in range(2500)]


def kept(rows, ok):
    out, last = [], {}
    for s, i, *row in sorted(rows, key=lambda r: r[1]):
        if s not in last or ok(last[s], row):
            last[s] = row
            out.append((s, i))
    return sorted(out, key=repr)


def test_trajectories(spark, small_batches):
    rng = random.Random(3)
    rows = [(s, i, float(i + rng.randrange(-2, 3)), rng.uniform(0, 9), rng.uniform(0, 9)) for i, s in enumerate(sessions(rng))]
    found = clean_trajectory(spark.createDataFrame(rows, "session long, id long, t double, x double, y double").repartition(5), 1.5, 2.0)
    step = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5
    wanted = kept(rows, lambda last, row: row[0] > last[0] and 2.0 <= step(last, row) <= 1.5 * (row[0] - last[0]))
    assert sorted(((r["session"], r["id"]) for r in found.collect()), key=repr) == wanted
    assert streamed(found)


def test_near_repeats(spark, small_batches):
    rng = random.Random(4)
    rows = [(s, i, [rng.random() for _ in range(4)]) for i, s in enumerate(sessions(rng))]
    found = suppress_repeats(spark.createDataFrame(rows, "session long, id long, v array<double>").repartition(5), "session", "id", "v", 30.0)
    wanted = kept(rows, lambda last, row: 100 * sum(abs(a - b) for a, b in zip(last[0], row[0], strict=True)) / 4 >= 30.0)
    assert sorted(map(tuple, found.collect()), key=repr) == wanted
    assert streamed(found)
