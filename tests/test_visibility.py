"""Line of sight and the choice of views against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import visibility as V

SIZE, NEAR, FAR, IDEAL = 0.5, 0.4, 3.0, 1.5


def clear(a, b, blocked):
    """Walks from cell to cell with an error term."""
    (x, y), (tx, ty) = a, b
    dx, dy = abs(tx - x), abs(ty - y)
    sx, sy, err = (1 if tx > x else -1), (1 if ty > y else -1), dx - dy
    while (x, y) != (tx, ty):
        twice, before = 2 * err, (x, y)
        if twice > -dy:
            err, x = err - dy, x + sx
        if twice < dx:
            err, y = err + dx, y + sy
        if x != before[0] and y != before[1] and (x, before[1]) in blocked and (before[0], y) in blocked:
            return False
        if (x, y) != (tx, ty) and (x, y) in blocked:
            return False
    return True


@pytest.fixture(scope="module")
def room():
    rng = random.Random(4)
    cells = [(s, i, j, rng.random() < 0.8, rng.random() < 0.15) for s in ("a", "b") for i in range(-6, 8) for j in range(-5, 7)]
    views = [(s, v, rng.uniform(-2.5, 3), rng.uniform(-2, 3)) for s in ("a", "b") for v in range(12)] + [("c", 99, 0.0, 0.0)]
    return cells, views


def frames(spark, room):
    cells, views = room
    return spark.createDataFrame(views, "scene string, view int, x double, y double"), spark.createDataFrame(cells, "scene string, i int, j int, target boolean, blocked boolean")


def brute(room):
    cells, views = room
    out = {}
    for scene, view, x, y in views:
        blocked = {(i, j) for s, i, j, _, b in cells if s == scene and b}
        own = (math.floor(x / SIZE), math.floor(y / SIZE))
        for s, i, j, target, _ in cells:
            dx, dy = (i + 0.5) * SIZE - x, (j + 0.5) * SIZE - y
            far = math.hypot(dx, dy)
            if s == scene and target and (i, j) != own and NEAR <= far <= FAR:
                out[scene, view, i, j] = (clear(own, (i, j), blocked), round(1 - abs(far - IDEAL) / IDEAL, 9), round(math.atan2(dy, dx), 9))
    return out


def test_observations_equal_brute_force(spark, room):
    got = {(r["scene"], r["view"], r["i"], r["j"]): (r["clear"], round(r["weight"], 9), round(r["bearing"], 9)) for r in V.observations(*frames(spark, room), SIZE, NEAR, FAR, IDEAL).collect()}
    assert got == brute(room) and {x[0] for x in got.values()} == {True, False}


def test_a_ray_cannot_slip_between_two_blocked_corners(spark):
    cells = [(0, i, j, (i, j) == (1, 1), (i, j) in ((1, 0), (0, 1))) for i in range(2) for j in range(2)]
    views = spark.createDataFrame([(0, 1, 0.25, 0.25)], "scene int, view int, x double, y double")
    for blocked, want in (([(1, 0), (0, 1)], False), ([(1, 0)], True), ([], True)):
        frame = spark.createDataFrame([(s, i, j, t, (i, j) in blocked) for s, i, j, t, _ in cells], "scene int, i int, j int, target boolean, blocked boolean")
        assert [r["clear"] for r in V.observations(views, frame, 0.5, 0.1, 2.0, 0.7).collect()] == [want]


def test_field_of_view(spark, room):
    views, cells = frames(spark, room)
    seen = V.observations(views, cells, SIZE, NEAR, FAR, IDEAL)
    headings = views.select("scene", "view", F.radians(F.col("view") * 30.0).alias("heading"))
    got = {(r["scene"], r["view"], r["i"], r["j"]): round(r["weight"], 6) for r in V.facing(seen, headings, math.radians(70), 0.1).collect()}
    want = {}
    for (scene, view, i, j), (_, weight, bearing) in brute(room).items():
        off = abs((bearing - math.radians(view * 30.0) + math.pi) % (2 * math.pi) - math.pi)
        own = weight * (1 - 0.5 * (off / math.radians(35)) ** 2)
        if off <= math.radians(35) and own >= 0.1:
            want[scene, view, i, j] = round(own, 6)
    assert got == want


def plain_greedy(seen, places, targets, most, mass, angle, start, travel, penalty, apart, known):
    apart_of = lambda a, b: 180 - abs((a - b) % 360 - 180)
    f = lambda m, g: min(1, m / mass) * (min(1, g / angle) if angle > 0 else 1)
    state = {}
    for cell, weight, bearing in known:
        state.setdefault(cell, []).append((weight, bearing))
    value = lambda obs: f(sum(w for w, _ in obs), max((apart_of(a, b) for _, a in obs for _, b in obs), default=0))
    picks, here, evaluated = [], start, 0
    while len(picks) < most:
        best = None
        for view, x, y in places:
            if any(p[0] == view or math.hypot(x - p[1], y - p[2]) < apart for p in picks):
                continue
            own = [o for o in seen if o[0] == view and o[1] in targets]
            evaluated += 1
            gain = round(sum((value([*state.get(c, []), (w, b)]) - value(state.get(c, []))) * targets[c] for _, c, w, b in own), 9)
            full = sum(w for _, c, w, _ in own if value(state.get(c, [])) >= 1 - 1e-9)
            redundancy = round(full / sum(w for _, _, w, _ in own), 9) if own else 0
            way = round(math.hypot(x - here[0], y - here[1]), 9)
            key = (round(gain * (1 - penalty * redundancy) / max(1e-6, travel + way), 9), gain, -way, -view)
            if gain > 0 and (best is None or key > best[0]):
                best = (key, view, x, y)
        if best is None:
            break
        picks.append((best[1], best[2], best[3], best[0][1], best[0][0]))
        here = best[2:]
        for v, c, w, b in seen:
            if v == best[1]:
                state.setdefault(c, []).append((w, b))
    return picks, evaluated


@pytest.mark.parametrize("angle", [0.0, 90.0])
def test_lazy_greedy_picks_what_plain_greedy_picks(spark, angle):
    rng = random.Random(6)
    places = [(v, round(rng.uniform(0, 10), 3), round(rng.uniform(0, 10), 3)) for v in range(60)]
    targets = {c: rng.choice([1.0, 2.0]) for c in range(120)}
    seen = [(v, c, round(rng.uniform(0.2, 1), 3), float(rng.randrange(360))) for v, x, y in places for c in range(125) if math.hypot(x - c % 11, y - c // 11) < 2.5]
    known = [(c, 0.3, float(rng.randrange(360))) for c in range(0, 120, 2)]
    args = (5, 1.5, angle, (5.0, 5.0), 0.5, 0.3, 0.7)
    want, plain = plain_greedy(seen, places, targets, *args, known)
    picks, told = V.choose_views(spark.createDataFrame(seen, "view int, cell int, weight double, bearing double"), spark.createDataFrame(places, "view int, x double, y double"), spark.createDataFrame(list(targets.items()), "cell int, importance double"), *args, known=spark.createDataFrame(known, "cell int, weight double, bearing double"), head=6)
    assert [p[0] for p in picks] == [p[0] for p in want] and all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(picks, want, strict=True))
    assert told["evaluated"] < 0.6 * plain


def test_nothing_to_choose(spark):
    seen = spark.createDataFrame([], "view int, cell int, weight double, bearing double")
    picks, told = V.choose_views(seen, spark.createDataFrame([(1, 0.0, 0.0)], "view int, x double, y double"), spark.createDataFrame([(1, 1.0)], "cell int, importance double"), 3, 1.0, 0.0, (0.0, 0.0), 1.0)
    assert picks == [] and told["evaluated"] == 0
