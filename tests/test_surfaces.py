"""Hulls, rooms, coverage and tracks against brute force; odd points."""

import random

import numpy as np
import pytest

from plinth.operators import spatial, surfaces


def test_hulls_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(p, float(rng.randrange(12)), float(rng.randrange(12))) for p in range(5) for _ in range(40)] + [(9, 1.0, 1.0), (8, 0.0, 0.0), (8, 1.0, 1.0), (8, 2.0, 2.0), (7, float("nan"), 1.0), (7, 1.0, 2.0)]
    got = {r["part"]: {tuple(p) for p in r["hull"]} for r in surfaces.convex_hulls(spark.createDataFrame(rows, "part int, x double, y double")).collect()}
    for part in range(5):
        pts = sorted({r[1:] for r in rows if r[0] == part})
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        corners = set()
        for a in pts:  # a corner is an end of an edge that has everything else on its left or on itself
            for b in pts:
                if a != b and all(cross(a, b, p) > 0 or (cross(a, b, p) == 0 and min(a, b) <= p <= max(a, b)) for p in pts):
                    corners |= {a, b}
        assert got[part] == corners
    assert got[9] == {(1.0, 1.0)} and got[8] == {(0.0, 0.0), (2.0, 2.0)} and got[7] == {(1.0, 2.0)}


def rooms(spark, seed):
    rng = random.Random(seed)
    names = [(b, b * 100 + r, rng.random() < 0.15) for b in range(4) for r in range(12)]
    doors = [(b, *sorted(rng.sample([r for c, r, _ in names if c == b], 2))) for b in range(4) for _ in range(13)]
    return names, doors


def reach(names, doors, building):
    seen = {r for b, r, f in names if b == building and f}
    while True:
        more = {y for b, p, q in doors for x, y in ((p, q), (q, p)) if b == building and x in seen} - seen
        if not more:
            return seen
        seen |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loop_confirmation_equals_taking_doors_away(spark, seed):
    names, doors = rooms(spark, seed)
    found = surfaces.loop_confirmed(spark.createDataFrame(names, "building int, room int, fixed boolean"), spark.createDataFrame(doors, "building int, a int, b int"))
    got = {(r["building"], r["room"]): r["confirmed"] for r in found.collect()}
    wanted = {}
    for b in range(4):
        fixed = {r for c, r, f in names if c == b and f}
        for r in reach(names, doors, b):
            wanted[b, r] = r in fixed or all(r in reach(names, doors[:i] + doors[i + 1 :], b) for i in range(len(doors)))
    assert got == wanted


def test_strongest_placement_follows_the_strongest_doors(spark):
    names = [(1, r, r == 0, 0.0, 0.0) for r in range(5)]
    doors = [(1, 10, 0, 1, 5.0, 1.0, 0.0), (1, 11, 1, 2, 9.0, 1.0, 0.0), (1, 12, 0, 2, 4.0, 7.0, 7.0), (1, 13, 3, 2, 6.0, 0.0, -2.0)]
    found = surfaces.strongest_placement(spark.createDataFrame(names, "building int, room int, fixed boolean, x double, y double"), spark.createDataFrame(doors, "building int, id long, a int, b int, weight double, dx double, dy double"))
    assert {tuple(r)[1:] for r in found.collect()} == {(0, 0.0, 0.0, None), (1, 1.0, 0.0, 10), (2, 2.0, 0.0, 11), (3, 2.0, 2.0, 13)}


def test_nearest_neighbours_with_odd_points(spark):
    rng = np.random.default_rng(2)
    pts = [(i, *map(float, rng.normal(size=3) * (1 if i % 7 else 50))) for i in range(300)] + [(300 + i, 0.25, 0.25, 0.25) for i in range(30)]
    odd = [(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0), (902, float("inf"), 0.0, 0.0)]
    frame = spark.createDataFrame(pts + odd, "id long, x double, y double, z double")
    got = {}
    for r in spatial.k_nearest(frame, frame, 4).collect():
        got.setdefault(r["id"], []).append((round(r["distance"], 9), r["b_id"]))
    xyz = np.array([p[1:] for p in pts])
    for i, p in enumerate(xyz):
        d = np.sqrt(((xyz - p) ** 2).sum(axis=1))
        assert sorted(got[pts[i][0]]) == sorted((round(float(x), 9), pts[j][0]) for x, j in sorted(zip(d, range(len(d)), strict=True), key=lambda t: (round(float(t[0]), 9), t[1]))[:4])
    assert not {900, 901, 902} & set(got)
    empty = frame.limit(0)
    assert spatial.k_nearest(frame, empty, 2).count() == 0 and spatial.k_nearest(empty, frame, 2).count() == 0


def test_widest_angle_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(c, rng.random(), float(rng.randrange(-400, 400))) for c in range(20) for _ in range(rng.randrange(1, 9))] + [(99, 0.5, None), (98, 0.5, 10.0)]
    got = {r["cell"]: r["angle"] for r in surfaces.coverage_state(spark.createDataFrame(rows, "cell int, weight double, bearing double"), 1.0, 90.0).collect()}
    for c in range(20):
        own = [b for x, _, b in rows if x == c]
        assert got[c] == pytest.approx(max(180 - abs((a - b) % 360 - 180) for a in own for b in own))
    assert got[99] == 0 and got[98] == 0


def test_greedy_clusters_equal_one_fold(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"l{i % 2}", float(rng.random()), *map(float, rng.normal(size=3) * (1 + i % 3))) for i in range(150)]
    got = {r["id"]: r["cluster"] for r in spatial.cluster_by_label(spark.createDataFrame(rows, "id long, label string, confidence double, x double, y double, z double"), 0.6).collect()}
    wanted = {}
    for label in ("l0", "l1"):
        clusters = []
        for i, _, _, *p in sorted((r for r in rows if r[1] == label), key=lambda r: (-r[2], r[0])):
            p = np.array(p)
            near = [(float(np.linalg.norm(c[1] - p)), n) for n, c in enumerate(clusters)]
            if near and min(near)[0] <= 0.6:
                c = clusters[min(near)[1]]
                c[1], c[2] = (c[1] * c[2] + p) / (c[2] + 1), c[2] + 1
            else:
                clusters.append(c := [i, p, 1])
            wanted[i] = c[0]
    assert got == wanted
