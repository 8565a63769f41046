"""Sequential rules and resampling against plain Python."""

import math
import random

import numpy as np
import pytest

from plinth.operators import datasets, evaluation, search, sequences, spatial, surfaces
from plinth.operators.relational import running_sums


def iou(a, b):
    ix, iy = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(ix, 0) * max(iy, 0)
    return shared / (a[2] * a[3] + b[2] * b[3] - shared)


def boxes(rng, n, first=0):
    return [(first + i, rng.randrange(4), rng.randrange(2), rng.random(), float(rng.randrange(12)), float(rng.randrange(12)), float(rng.randrange(4, 9)), float(rng.randrange(4, 9))) for i in range(n)]


BOX = "id long, image long, class long, score double, x double, y double, w double, h double"


def test_matching_takes_the_best_score_first(spark):
    rng = random.Random(1)
    said, truth = boxes(rng, 60), boxes(rng, 40, 100)
    got = {r["id"]: r["hit"] for r in spatial.match_detections(spark.createDataFrame(said, BOX), spark.createDataFrame(truth, BOX), 0.4).collect()}
    want, free = {}, {t[0]: t for t in truth}
    for d in sorted(said, key=lambda d: (-d[3], d[0])):
        fits = [(iou(d[4:], t[4:]), -t[0]) for t in free.values() if t[1:3] == d[1:3]]
        best = max(fits, default=(0.0, 0))
        want[d[0]] = best[0] >= 0.4
        if want[d[0]]:
            del free[-best[1]]
    assert got == want and set(got.values()) == {True, False}


def test_merged_boxes(spark):
    rng = random.Random(2)
    rows = boxes(rng, 50)
    got = sorted((r["frame"], r["x"], r["y"], r["w"], r["h"]) for r in spatial.merge_boxes(spark.createDataFrame(rows, BOX).withColumnRenamed("image", "frame")).collect())
    want = []
    for frame in range(4):
        merged = []
        for b in sorted((r for r in rows if r[1] == frame), key=lambda r: (-r[6] * r[7], r[0])):
            for k, m in enumerate(merged):
                if iou(m, b[4:]) > 0.3:
                    x, y = min(m[0], b[4]), min(m[1], b[5])
                    merged[k] = (x, y, max(m[0] + m[2], b[4] + b[6]) - x, max(m[1] + m[3], b[5] + b[7]) - y)
                    break
            else:
                merged.append(b[4:])
        want += [(frame, *m) for m in merged]
    assert got == sorted(want)


def test_resampled_paths(spark):
    rng = random.Random(3)
    rows = [(s, i, float(i), rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 360)) for s in range(3) for i in range(12)]
    rows += [(s, 50, 50.0, r[3], r[4], r[5]) for s in range(3) for r in rows if r[:2] == (s, 11)]  # stands still
    got = {(r["session"], r["k"]): (r["x"], r["y"], r["yaw"]) for r in sequences.resample(spark.createDataFrame(rows, "session long, id long, t double, x double, y double, yaw double"), 2.5).collect()}
    want = {}
    for s in range(3):
        own, along = sorted(r for r in rows if r[0] == s), 0.0
        for a, b in zip(own, own[1:], strict=False):
            step = math.dist(a[3:5], b[3:5])
            k = math.floor(along / 2.5) + 1
            while k * 2.5 <= along + step and step:
                f = (k * 2.5 - along) / step
                turn = (b[5] - a[5] + 180) % 360 - 180
                want[s, k] = (a[3] + f * (b[3] - a[3]), a[4] + f * (b[4] - a[4]), (a[5] + f * turn) % 360)
                k += 1
            along += step
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_folded_duplicates(spark):
    rng = random.Random(4)
    rows = [(n, n, rng.randrange(2), rng.choice("ab"), rng.random() < 0.8, rng.uniform(0, 6), rng.uniform(0, 6)) for n in range(120)]
    got = {r["id"] for r in search.fold_duplicates(spark.createDataFrame(rows, "rank int, id int, floor int, fold_group string, foldable boolean, x double, y double"), 1.0).collect()}
    kept = []
    for r in rows:
        if not (r[4] and any(k[4] and k[2:4] == r[2:4] and math.dist(k[5:], r[5:]) <= 1.0 for k in kept)):
            kept.append(r)
    assert got == {r[1] for r in kept} and len(got) < 120


def test_bootstrap_intervals(spark):
    """The spread of resampled means is that of the mean; pairs that differ by a constant leave no spread."""
    rng = np.random.default_rng(5)
    rows = [(k, float(v), float(v) + 2.0) for k, n in (("a", 400), ("b", 100)) for v in rng.normal(10, 3, n)] + [("a", None, 1.0)]
    frame = spark.createDataFrame(rows, "key string, value double, other double")
    found = {r["key"]: r for r in evaluation.bootstrap_interval(frame, "key", "value").collect()}
    for key, row in found.items():
        own = np.array([v for k, v, _ in rows if k == key and v is not None])
        error = own.std() / math.sqrt(len(own))
        assert abs(row["low"] - (own.mean() - 1.96 * error)) < 0.25 * error and abs(row["high"] - (own.mean() + 1.96 * error)) < 0.25 * error
    assert all(abs(r["low"] + 2.0) < 1e-9 and abs(r["high"] + 2.0) < 1e-9 for r in evaluation.paired_bootstrap(frame, "key", "value", "other").collect())
    again = {r["key"]: r["low"] for r in evaluation.bootstrap_interval(frame.repartition(5), "key", "value").collect()}
    assert all(abs(again[k] - found[k]["low"]) < 1e-9 for k in found)


def test_running_sums_over_several_parts(spark):
    rng = random.Random(6)
    values = [(i, rng.randrange(9)) for i in range(3000)]
    got = {r["k"]: r["upto"] for r in running_sums(spark.createDataFrame(values, "k int, v int").repartition(5), ["k"], {"upto": "v"}).collect()}
    assert got == {k: sum(v for _, v in values[: k + 1]) for k, _ in values}


def test_hull_of_many_slices(spark):
    rng = random.Random(7)
    rows = [(p, rng.gauss(0, 1), rng.gauss(0, 1)) for p in ("a", "b") for _ in range(2000)] + [("c", 1.0, 1.0), (None, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "part string, x double, y double")
    one, many = ({r["part"]: r["hull"] for r in surfaces.convex_hulls(frame, most).collect()} for most in (50_000, 100))
    assert one == many and len(one["a"]) > 5 and one["c"] == [[1.0, 1.0]] and one[None] == [[0.0, 0.0]]


def test_regions_larger_and_smaller_than_a_cell(spark):
    rng = random.Random(8)
    points = [(i, i % 2, "AUTO_DETECTED", False, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(300)]
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    regions = [(0, 5, square(-15.0, -15.0, 25.0)), (0, 3, square(1.0, 1.0, 6.0)), (1, 7, square(0.5, 0.5, 0.7))]
    got = {r["id"]: r["superseded_by"] for r in datasets.supersede_in_region(spark.createDataFrame(points, "id int, floor int, source string, deleted boolean, x double, y double"), spark.createDataFrame(regions, "floor int, version int, ring array<struct<x:double,y:double>>")).collect()}
    for i, floor, _, _, x, y in points:
        inside = [v for f, v, ring in regions if f == floor and ring[0][0] < x < ring[2][0] and ring[0][1] < y < ring[2][1]]
        assert got[i] == min(inside, default=None)
