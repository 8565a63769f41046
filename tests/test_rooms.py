"""Rooms in cells and how they hang together, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import rooms as R

SIDES = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def frame(spark, cells, part="a"):
    return spark.createDataFrame([(part, i, j) for i, j in cells], "part string, i int, j int")


def found(df):
    return {(r["i"], r["j"]) for r in df.collect()}


def enclosed(cells):
    i0, i1, j0, j1 = (f(c[k] for c in cells) + d for k in (0, 1) for f, d in ((min, -1), (max, 1)))
    out, front = {(i0, j0)}, [(i0, j0)]
    while front:
        i, j = front.pop()
        for a, b in SIDES:
            c = (i + a, j + b)
            if i0 <= c[0] <= i1 and j0 <= c[1] <= j1 and c not in cells and c not in out:
                out.add(c)
                front.append(c)
    return {(i, j) for i in range(i0, i1 + 1) for j in range(j0, j1 + 1)} - out - set(cells)


def test_holes_and_frontier_equal_brute_force(spark):
    rng = random.Random(2)
    cells = {(i, j) for i in range(-9, 12) for j in range(0, 25) if rng.random() < 0.7}
    assert found(R.holes(frame(spark, cells).unionByName(frame(spark, [(0, 0)], "b")))) == enclosed(cells)
    free = {c for c in cells if rng.random() < 0.8}
    want = {(i, j) for i, j in free if any((i + a, j + b) not in cells for a, b in SIDES)}
    assert found(R.frontier(frame(spark, free), frame(spark, cells - free))) == want


def test_outline_of_a_planted_room(spark):
    """An L of 3 by 2 m with a pillar, in cells of 0.1 m, some bitten out of the wall."""
    rng = random.Random(3)
    room = {(i, j) for i in range(30) for j in range(20) if i < 15 or j < 10}
    pillar = {(i, j) for i in range(4, 7) for j in range(4, 7)}
    cells = room - pillar - {(0, j) for j in range(20) if rng.random() < 0.3}
    rows = R.outlines(frame(spark, cells), 0.1, 0.12).orderBy(F.desc("area")).collect()
    assert [r["outer"] for r in rows] == [True, False] and rows[1]["area"] == pytest.approx(-0.09)
    assert sum(r["area"] for r in rows) == pytest.approx(0.01 * len(cells))
    truth = [(0, 0), (3, 0), (3, 1), (1.5, 1), (1.5, 2), (0, 2)]
    ring = rows[0]["corners"]
    assert len(ring) <= 12 and all(min(np.hypot(x - a, y - b) for x, y in ring) <= 0.15 for a, b in truth)


def test_rings_that_touch_at_a_corner_stay_apart(spark):
    rows = R.outlines(frame(spark, [(0, 0), (1, 1)]), 1.0).collect()
    assert sorted((r["area"], len(r["corners"])) for r in rows) == [(1.0, 4), (1.0, 4)]
    assert R.outlines(frame(spark, [(0, 0)]).limit(0), 1.0).count() == 0 and R.holes(frame(spark, [(0, 0)]).limit(0)).count() == 0


def test_seeds_are_in_the_middle(spark):
    rows = [("f", 1, i, j) for i in range(21) for j in range(11) if (i, j) != (5, 5)] + [("f", 2, i, 40) for i in range(9)] + [("g", 1, 0, 0)]
    got = {(r["part"], r["room"]): (round(r["x"], 3), round(r["y"], 3)) for r in R.room_seeds(spark.createDataFrame(rows, "part string, room int, i int, j int"), 0.1).collect()}
    assert got == {("f", 1): (1.05, 0.55), ("f", 2): (0.45, 4.05), ("g", 1): (0.05, 0.05)}


@pytest.mark.parametrize("task_edges", [10, 200_000])
def test_widest_ways_equal_brute_force(spark, task_edges):
    rng = random.Random(4)
    edges = [(p, a, b, rng.choice([0.5, 0.8, 0.9, 1.2, 2.0])) for p in (1, 2) for a in range(30) for b in range(a) if rng.random() < 0.08]
    seeds = [(p, f"r{n}", n * 5) for p in (1, 2) for n in range(6)] + [(1, "twin", 5), (3, "alone", 1), (1, "lost", None)]
    odd = [(1, 3, 4, None), (1, 3, 4, float("nan")), (1, 7, 7, 9.0), (1, None, 2, 1.0)]
    got = {(r["part"], r["room"], r["other"]): r["width"] for r in R.widest_ways(spark.createDataFrame(edges + odd, "part int, a long, b long, width double"), spark.createDataFrame(seeds, "part int, room string, node long"), task_edges).collect()}
    want = {}
    for p in (1, 2):
        best = {a: {b: float("inf") if a == b else 0.0 for b in range(30)} for a in range(30)}
        for q, a, b, w in edges:
            if q == p:
                best[a][b] = best[b][a] = max(best[a][b], w)
        for k in range(30):
            for a in range(30):
                for b in range(30):
                    best[a][b] = max(best[a][b], min(best[a][k], best[k][b]))
        own = [(r, n) for q, r, n in seeds if q == p and n is not None]
        want |= {(p, r, s): best[n][m] for r, n in own for s, m in own if r < s and best[n][m] > 0}
    assert got == want


def test_connectivity_of_three_rooms(spark):
    """Room 1 and 2 meet at two doors, one of them with a step; room 3 is cut off; part h has one room of its own."""
    footprints = [("f", 1, i, j) for i in range(10) for j in range(10)] + [("f", 2, i, j) for i in range(10, 20) for j in range(10)] + [("f", 3, i, j) for i in range(30, 40) for j in range(10)]
    nodes = [("f", n, x, y) for n, (x, y) in enumerate([(2.5, 5.5), (9.5, 2.5), (9.5, 7.5), (10.5, 2.5), (10.5, 7.5), (15.5, 5.5), (35.5, 5.5)])] + [("h", 100, 0.5, 0.5)]
    links = [(0, 1, 1.0, True), (0, 2, 1.0, True), (1, 3, 0.8, True), (2, 4, 1.1, False), (3, 5, 1.0, True), (4, 5, 1.0, True)]
    edges = [("f", a, b, c, s, [float(a), float(b)]) for a, b, c, s in links]
    seeds = [("f", 1, 3.0, 5.5), ("f", 2, 15.0, 5.5), ("f", 3, 35.0, 5.5), ("f", 4, 80.0, 80.0), ("h", 1, 0.5, 0.5)]
    rooms, between = R.room_connectivity(spark.createDataFrame(seeds, "part string, room int, x double, y double"), spark.createDataFrame(footprints, "part string, room int, i int, j int"), spark.createDataFrame(nodes, "part string, id long, x double, y double"), spark.createDataFrame(edges, "part string, a long, b long, clearance double, step_free boolean, portal array<double>"), 1.0)
    assert {(r["part"], r["room"]): (r["node"], r["reached"], r["step_free_reached"]) for r in rooms.collect()} == {("f", 1): (0, True, True), ("f", 2): (5, True, True), ("f", 3): (6, False, False), ("f", 4): (None, False, False), ("h", 1): (100, True, True)}
    assert [tuple(r) for r in between.collect()] == [("f", 1, 2, 2, True, 1.1, [2.0, 4.0])]
