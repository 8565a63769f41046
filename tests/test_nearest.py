"""Nearest points within a bound, against brute force, and without a row for every pair within it."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import spatial as S
from plinth.operators import surfaces

POINT = "id long, x double, y double, z double"


@pytest.mark.parametrize("bound", [0.02, 0.3, 5.0])
def test_bounded_nearest_equals_brute_force(spark, bound):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.uniform(-1, 1, (300, 3)), 1), np.round(np.r_[rng.uniform(-1, 0.4, (200, 3)), rng.uniform(-0.1, 0.1, (200, 3))], 1)  # many ties
    a[:5] += 3
    bad = [(900, math.nan, 0.0, 0.0), (901, None, 0.0, 0.0), (902, math.inf, 0.0, 0.0)]
    frame = lambda p: spark.createDataFrame([*[(i, *map(float, x)) for i, x in enumerate(p)], *bad], POINT)
    wanted = {i: (None, None) for i in (900, 901, 902)}
    for i, p in enumerate(a):
        d, j = min((math.sqrt(sum((s - t) ** 2 for s, t in zip(p, q, strict=True))), j) for j, q in enumerate(b))
        wanted[i] = (j, pytest.approx(d, abs=1e-12)) if d <= bound else (None, None)
    got = {r["id"]: (r["b_id"], r["distance"]) for r in S.nearest(frame(a), frame(b), bound).collect()}
    assert got == wanted
    assert {r["b_id"] for r in S.nearest(frame(a), frame(b).limit(0), bound).collect()} == {None}


def dense(spark, n, salt):
    at = lambda k: (F.pmod(F.xxhash64("id", F.lit(salt + k)), F.lit(1 << 20)) / (1 << 20)).alias("xyz"[k])
    return spark.range(n).select("id", at(0), at(1), at(2))


def test_a_wide_bound_makes_no_row_for_every_pair(spark):
    a, b = dense(spark, 60_000, 10), dense(spark, 60_000, 20)
    start = time.monotonic()
    assert S.nearest(a, b, 2.0).where("b_id IS NOT NULL").count() == 60_000  # 3.6 billion pairs lie within
    assert time.monotonic() - start < 60


def test_changes_and_metrics_with_a_wide_tolerance(spark):
    a = dense(spark, 60_000, 30)
    start = time.monotonic()
    assert S.changes(a, a, 2.0, 0.1).first()["ratio"] == 0.0
    assert surfaces.alignment_metrics(a, a, 2.0).first()["rms"] == 0.0
    assert time.monotonic() - start < 120
