"""Depth layers of boxes with planted surfaces."""

from plinth.operators.localisation import localise

POINTS = "frame int, id int, px double, py double, depth double, visible boolean, x double, y double, z double"
BOXES = "frame int, box int, x0 double, y0 double, x1 double, y1 double"


def grid(frame, first, x0, y0, n, depth, visible=True):
    return [(frame, first + k, x0 + (k % 10) * 8.0, y0 + (k // 10) * 8.0, depth + 0.001 * (k % 3), visible, 1.0 * depth, 2.0, 3.0) for k in range(n)]


def found(spark, points, boxes, **options):
    return {r["box"]: r for r in localise(spark.createDataFrame(points, POINTS), spark.createDataFrame(boxes, BOXES), **options).collect()}


def test_the_nearest_layer_that_covers_enough(spark):
    points = grid(1, 0, 0, 0, 100, 2.0) + grid(1, 1000, 0, 0, 13, 1.0)  # an edge of something in front
    got = found(spark, points, [(1, 1, 0.0, 0.0, 80.0, 80.0)])[1]
    assert got["reason"] is None and got["layers"] == 2 and abs(got["depth"] - 2.001) < 1e-9 and got["x"] == 2.0
    assert got["hidden"] > 0 and 0.7 < got["coverage"] < 1 and abs(got["spread"] - 1.4826 * 0.001) < 1e-9


def test_reasons(spark):
    points = grid(1, 0, 0, 0, 5, 2.0) + grid(1, 100, 400, 0, 50, 3.0, False) + grid(2, 200, 0, 0, 50, 2.0)
    points += [p for k in range(5) for p in grid(3, 1000 * k, k * 100.0, 0, 20, 1.0 + 2 * k)] + [(1, 999, None, 1.0, 1.0, True, 0.0, 0.0, 0.0), (1, 998, 1.0, float("nan"), 1.0, True, 0.0, 0.0, 0.0)]
    boxes = [(1, 1, 0.0, 0.0, 80.0, 80.0), (1, 2, 400.0, 0.0, 480.0, 80.0), (1, 3, 10.0, 10.0, 10.0, 20.0), (3, 4, 0.0, 0.0, 500.0, 50.0)]
    assert {k: r["reason"] for k, r in found(spark, points, boxes).items()} == {1: "INSUFFICIENT_DEPTH", 2: "NO_DEPTH", 3: "NO_DEPTH", 4: "AMBIGUOUS_DEPTH"}


def test_empty_tables(spark):
    assert found(spark, [], [(1, 1, 0.0, 0.0, 9.0, 9.0)])[1]["reason"] == "NO_DEPTH"
    assert found(spark, grid(1, 0, 0, 0, 50, 2.0), []) == {}
