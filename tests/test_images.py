"""Image metrics against plain loops."""

import random

import pytest

from plinth.operators import images as I


def mirrored(g, y, x):
    h, w = len(g), len(g[0])
    y, x = abs(y), abs(x)
    return g[2 * h - 2 - y if y >= h else y][2 * w - 2 - x if x >= w else x]


def brute(g):
    h, w = len(g), len(g[0])
    bend = [[sum(mirrored(g, y + a, x + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))) - 4 * g[y][x] for x in range(w)] for y in range(h)]
    var = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)
    gx = [sum(k * (mirrored(g, y + a, x + 1) - mirrored(g, y + a, x - 1)) for a, k in ((-1, 1), (0, 2), (1, 1))) for y in range(h) for x in range(w)]
    gy = [sum(k * (mirrored(g, y + 1, x + a) - mirrored(g, y - 1, x + a)) for a, k in ((-1, 1), (0, 2), (1, 1))) for y in range(h) for x in range(w)]
    mean = lambda v: sum(v) / len(v)
    xx, yy, xy = mean([a * a for a in gx]), mean([a * a for a in gy]), mean([a * b for a, b in zip(gx, gy, strict=True)])
    root = ((xx - yy) ** 2 + 4 * xy * xy) ** 0.5
    flat = [v for row in g for v in row]
    score = {}
    for y in range(3, h - 3):
        for x in range(3, w - 3):
            ring = [g[y + a][x + b] - g[y][x] for a, b in I.CIRCLE]
            if any(all(s * ring[(k + n) % 16] > I.CORNER for n in range(9)) for k in range(16) for s in (1, -1)):
                score[y, x] = sum(max(abs(r) - I.CORNER, 0) for r in ring)
    kept = sum(all(score.get((y + a, x + b), 0) < s or ((a, b) > (0, 0) and score.get((y + a, x + b), 0) == s) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)) for (y, x), s in score.items())
    return var([v for row in bend for v in row]), var([v for row in bend[1:-1] for v in row[1:-1]]), (xx + yy + root) / 2 / max(1e-5, (xx + yy - root) / 2), mean(flat), mean([v < 20 for v in flat]), mean([v > 235 for v in flat]), kept


def test_equals_plain_loops(spark):
    rng, rows = random.Random(1), []
    for k in range(12):
        h, w = rng.randrange(3, 30), rng.randrange(3, 30)
        g = [[float(rng.choice([0, 30, 128, 250]) if k % 2 else 100 + 20 * (x // 7 % 2) + 60 * (y // 6 % 2)) for x in range(w)] for y in range(h)]
        rows.append((k, w, g))
    frame = spark.createDataFrame([(k, w, [v for row in g for v in row]) for k, w, g in rows], "id long, width int, pixels array<double>")
    got = {r["id"]: tuple(r)[1:] for r in I.image_metrics(frame).collect()}
    for k, _, g in rows:
        assert got[k] == pytest.approx(brute(g), rel=1e-9, abs=1e-9)
    assert sum(x[6] for x in got.values()) > 0


def test_odd_images(spark):
    frame = spark.createDataFrame([(1, 3, None), (2, 3, []), (3, 3, [1.0, 2.0]), (4, 0, [1.0]), (5, None, [1.0]), (6, 1, [float("nan")]), (7, 1, [None]), (8, 1, [5.0])], "id long, width int, pixels array<double>")
    got = {r["id"]: r["brightness"] for r in I.image_metrics(frame).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None, 8: 5.0}
    assert I.image_metrics(frame.limit(0)).count() == 0
