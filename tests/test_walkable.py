"""The walkable surface and routing graphs against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import searches
from plinth.operators import walkable as W


@pytest.mark.parametrize("density", [0.3, 0.85, 0.99])
def test_clearance_equals_brute_force(spark, density):
    rng = random.Random(3)
    free = {(p, i, j) for p in ("a", "b") for i in range(-30, 100) for j in range(-5, 25) if rng.random() < density}
    got = {(r["part"], r["i"], r["j"]): r["cells"] for r in W.clearance(spark.createDataFrame(list(free), "part string, i long, j long")).collect()}
    want = {}
    for p, i, j in free:
        reach = 1
        while True:  # the nearest cell that is not free lies in a square of this half width, or farther
            near = [math.hypot(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (p, i + a, j + b) not in free]
            if near and min(near) <= reach:
                want[p, i, j] = min(near)
                break
            reach *= 2
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_surface_of_three_floors(spark):
    """A room of 4 by 3 m with a table, a step along x = 2 and a hole; and floors without obstacles or ground of their own."""
    rng = random.Random(5)
    ground = [("a", i * 0.1 + 0.05, j * 0.1 + 0.05, (0.15 if i >= 20 else 0.0) + rng.uniform(-0.01, 0.01)) for i in range(40) for j in range(30) for _ in range(4) if not (30 <= i < 33 and 10 <= j < 13)]
    ground += [("a", 0.55, 0.55, -0.4)] + [("b", i * 0.1 + 0.05, 0.05, 0.0) for i in range(10) for _ in range(3)] + [("a", float("nan"), 0.0, 0.0)]
    obstacles = [("a", 1.05 + a * 0.1, 1.05, z) for a in range(3) for z in (0.7, 0.75)] + [("a", 0.55, 2.05, 0.05), ("a", 0.75, 2.05, 2.5), ("c", 0.0, 0.0, 1.0)]
    frame = lambda rows: spark.createDataFrame(rows, "part string, x double, y double, z double")
    cells = {(r["part"], r["i"], r["j"]): r for r in W.surface_model(frame(ground), frame(obstacles), reference=0.0, size=0.1, least=3, band=0.05, climb=0.2, height=1.8, step=0.05, above=1.0, accessible=0.9, cap=2.0).collect()}
    a = {k[1:]: r for k, r in cells.items() if k[0] == "a"}
    assert len(a) == 40 * 30 - 9 and abs(a[5, 5]["ground"]) < 0.02  # the stray point below decides nothing
    assert {k for k, r in a.items() if r["obstacle"]} == {(10, 10), (11, 10), (12, 10)} and a[10, 10]["top"] == 0.75
    assert {k for k, r in a.items() if r["level_change"]} == {(i, j) for i in (19, 20) for j in range(30)}
    shut = {(i, j) for i in range(-1, 41) for j in range(-1, 31)} - {k for k, r in a.items() if r["free"]}
    for (i, j), r in a.items():
        clear = 0.1 * min(math.hypot(i - p, j - q) for p, q in shut) if r["free"] else 0.0
        assert abs(r["clear"] - clear) < 1e-9 and abs(r["width"] - (min(2.0, max(0.0, 2 * clear - 0.1)) if r["free"] else 0.0)) < 1e-9
        assert r["narrow"] == (r["free"] and not r["level_change"] and r["width"] < 0.9)
    assert len([k for k in cells if k[0] == "b"]) == 10 and cells["c", 0, 0]["obstacle"] and cells["c", 0, 0]["ground"] is None


def ring(*points):
    return [{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in points]


SCHEMA = "part string, polygon long, ring array<struct<x:double,y:double,z:double>>, level_change boolean"


@pytest.mark.parametrize("turn", [0.0, 0.3, math.pi / 2, 2.0, math.pi - 0.001])
def test_polygons_share_parts_of_sides_whatever_way_they_are_turned(spark, turn):
    c, s = math.cos(turn), math.sin(turn)
    placed = lambda *points: ring(*[(c * x - s * y + 3, s * x + c * y - 7, z) for x, y, z in points])
    rows = [
        ("f", 1, placed((0, 0, 0), (4, 0, 0), (4, 3, 0), (0, 3, 0)), False),
        ("f", 2, placed((1, 3, 0), (2, 3, 0), (2, 6, 0), (1, 6, 0)), False),  # a corridor on a part of the long side
        ("f", 3, placed((4, 1, 0), (6, 1, 0.1), (6, 2, 0.1), (4, 2, 0)), False),  # a ramp
        ("f", 4, placed((4, 2.5, 1), (5, 2.5, 1), (5, 3, 1), (4, 3, 1)), False),  # a table's height above
        ("f", 5, placed((4, 0, 0.0), (5, 0, 0), (5, 0.97, 0), (4, 0.97, 0)), True),
        ("f", 6, placed((2, 6, 0), (3, 6, 0), (3, 7, 0), (2, 7, 0)), False),  # touches 2 at a corner only
        ("g", 7, placed((0, 3, 0), (4, 3, 0), (4, 5, 0), (0, 5, 0)), False),  # another part
    ]
    nodes, edges = W.routing_graph(spark.createDataFrame(rows, SCHEMA), climb=0.3, ramp=4.8)
    got = {(r["a"], r["b"]): r for r in edges.collect()}
    assert {k: round(r["width"], 6) for k, r in got.items()} == {(1, 2): 1.0, (1, 3): 1.0, (1, 5): 0.97}
    assert {k: r["step_free"] for k, r in got.items()} == {(1, 2): True, (1, 3): True, (1, 5): False}
    assert abs(got[1, 3]["slope"] - math.degrees(math.atan2(0.1, 2))) < 1e-6 and abs(got[1, 3]["rise"] - 0.05) < 1e-9
    assert nodes.count() == 7


def brute_sides(rows, climb, tolerance=0.02, least=0.05):
    """{(a, b): width}: every side of a polygon against every side of the others."""
    found = {}
    sides = [(part, n, r[k], r[(k + 1) % len(r)]) for part, n, r, _ in rows for k in range(len(r))]
    for part, a, p, q in sides:
        long = math.hypot(q["x"] - p["x"], q["y"] - p["y"])
        if long < least:
            continue
        ux, uy = (q["x"] - p["x"]) / long, (q["y"] - p["y"]) / long
        for other, b, bp, bq in sides:
            if other != part or not a < b or math.hypot(bq["x"] - bp["x"], bq["y"] - bp["y"]) < least:
                continue
            if any(abs((v["y"] - p["y"]) * ux - (v["x"] - p["x"]) * uy) > tolerance for v in (bp, bq)):
                continue
            s, t = ((v["x"] - p["x"]) * ux + (v["y"] - p["y"]) * uy for v in (bp, bq))
            low, high = max(0.0, min(s, t)), min(long, max(s, t))
            if high - low < least:
                continue
            middle = (low + high) / 2
            if abs(p["z"] + (q["z"] - p["z"]) * middle / long - bp["z"] - (bq["z"] - bp["z"]) * (middle - s) / (t - s)) <= climb:
                found[a, b] = max(found.get((a, b), 0.0), high - low)
    return found


@pytest.mark.parametrize("away", [0.0, 5000.0])
def test_sides_of_all_lengths_meet_wherever_the_polygons_lie(spark, away):
    """Sides of 0.06 to 90 m with ends that stand off by less than the tolerance, so that short ones point elsewhere; parts far from the origin."""
    rng = random.Random(8)
    rows, n = [], 0
    for turn in [rng.uniform(0, math.pi) for _ in range(30)] + [0.0, math.pi / 2]:
        c, s, x0, y0 = math.cos(turn), math.sin(turn), rng.uniform(-90, 90) + away, rng.uniform(-90, 90) - away
        for _ in range(7):
            u, v, size, off = rng.uniform(0, 3), 0.0, rng.choice([0.06, 0.1, 0.5, 3.0, 90.0]), lambda: rng.uniform(-0.012, 0.012)
            corners = [(u, v + off()), (u + size, v + off()), (u + size / 2, v + rng.choice([-2, 2]))]
            rows.append((rng.choice("fg"), n, ring(*[(c * x - s * y + x0, s * x + c * y + y0, rng.uniform(0, 0.3)) for x, y in corners]), False))
            n += 1
    want = brute_sides(rows, 0.2)
    got = {(r["a"], r["b"]): r["width"] for r in W.shared_sides(spark.createDataFrame(rows, SCHEMA), climb=0.2).collect()}
    assert len(want) > 30 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_a_side_meets_those_beside_it_and_not_all_of_its_line(spark, monkeypatch):
    """900 rooms on either side of one line: the pairs that meet by their keys stay in proportion to the rooms."""
    rows = [("f", 2 * n + k, ring((2 * n, 3 * k, 0), (2 * n + 2, 3 * k, 0), (2 * n + 2, 3 * k + 3, 0), (2 * n, 3 * k + 3, 0)), False) for n in range(900) for k in (0, 1)]
    rooms = spark.createDataFrame(rows, SCHEMA)
    asked, plain = [], type(rooms).join
    monkeypatch.setattr(type(rooms), "join", lambda a, b, on=None, how=None: asked.append((a, b, on)) or plain(a, b, on, how))
    assert W.shared_sides(rooms, climb=0.1).count() == 900 + 2 * 899
    (a, b, on), *more = asked
    assert not more and plain(a, b, on).count() < 60 * len(rows)


def test_a_route_over_the_built_graph(spark):
    """Rooms along a corridor; the way from room A to room E leads through it, and around the steps if it must be step-free."""
    rows = [("f", n, ring((2 * n, 2, 0), (2 * n + 2, 2, 0), (2 * n + 2, 5, 0), (2 * n, 5, 0)), False) for n in range(5)]  # rooms, that share walls
    rows = [(p, n, [{**v, "x": v["x"] + (0.1 if k in (0, 3) else -0.1)} for k, v in enumerate(r)], lc) for p, n, r, lc in rows]  # walls are thick
    rows += [("f", 10 + n, ring((2 * n, 0, 0), (2 * n + 2, 0, 0), (2 * n + 2, 2, 0), (2 * n, 2, 0)), n == 2) for n in range(5)]  # the corridor; its middle has a step
    rows += [("f", 20 + n, ring((2 * n, -2, 0), (2 * n + 2, -2, 0), (2 * n + 2, 0, 0), (2 * n, 0, 0)), False) for n in range(5)]  # beside it
    _, edges = W.routing_graph(spark.createDataFrame(rows, SCHEMA), climb=0.2, ramp=5.0)
    for only in (edges, edges.where("step_free")):
        way = searches.shortest_paths(only.select("a", "b", "length").unionByName(only.select(F.col("b").alias("a"), F.col("a").alias("b"), "length")), 0)
        costs = {r["id"]: r["distance"] for r in way.collect()}
        assert len(costs) == (15 if only is edges else 13)  # the room at the step has no other way
        assert costs[4] == pytest.approx(2.5 + 8 + 2.5 + (0 if only is edges else 4))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "part string, x double, y double, z double")
    assert W.surface_model(none, none, reference=0.0, size=0.1, least=3, band=0.05, climb=0.2, height=1.8, step=0.05, above=1.0, accessible=0.9, cap=2.0).count() == 0
    nodes, edges = W.routing_graph(spark.createDataFrame([], SCHEMA), climb=0.3, ramp=4.8)
    assert nodes.count() == edges.count() == 0
