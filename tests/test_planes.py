"""RANSAC takes one plane after the other from a cloud."""

import numpy as np

from plinth.operators.spatial import fit_planes

NORMALS, OFFSETS, SIZES = np.array([[0, 0, 1.0], [1.0, 0, 0], [0.6, 0.8, 0]]), (0.0, -3.0, 4.0), (600, 250, 150)


def cloud(spark):
    """Three planes, the first dominant, 200 scattered points and two without coordinates; and the ids of each plane."""
    rng, rows, owners = np.random.default_rng(5), [], []
    for n, d, size in zip(NORMALS, OFFSETS, SIZES, strict=True):
        p = rng.uniform(-10, 10, (size, 3))
        p -= np.outer(p @ n + d + rng.uniform(-0.005, 0.005, size), n)
        owners.append(set(range(len(rows), len(rows) + size)))
        rows += p.tolist()
    rows += rng.uniform(-10, 10, (200, 3)).tolist()
    rows = [(i, *p) for i, p in enumerate(rows)] + [(-1, None, 0.0, 0.0), (-2, float("nan"), 0.0, 0.0)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(5), owners


def test_every_plane_is_found_with_its_inliers(spark):
    points, owners = cloud(spark)
    rows = fit_planes(points, 0.03, max_planes=6, min_inliers=60).collect()
    assert {r["plane"] for r in rows} == {0, 1, 2}
    assert len({r["id"] for r in rows}) == len(rows)
    for k, owned in enumerate(owners):
        mine = [r for r in rows if r["plane"] == k]
        assert len({r["id"] for r in mine} & owned) >= 0.95 * len(owned) and len(mine) <= 1.1 * len(owned)
        assert np.allclose([mine[0][c] for c in "abcd"], [*NORMALS[k], OFFSETS[k]], atol=0.02)


def test_the_loop_stops(spark):
    points, _ = cloud(spark)
    assert {r["plane"] for r in fit_planes(points, 0.03, max_planes=1, min_inliers=60).collect()} == {0}
    assert {r["plane"] for r in fit_planes(points, 0.03, max_planes=6, min_inliers=400).collect()} == {0}
    assert fit_planes(points.limit(0), 0.03, max_planes=6, min_inliers=1).collect() == []
    assert fit_planes(points.limit(2), 0.03, max_planes=6, min_inliers=1).collect() == []
