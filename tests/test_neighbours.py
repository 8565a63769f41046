import numpy as np

from plinth.operators import spatial


def brute(here, there, ids, k):
    """Per row of here the k smallest (distance, id)."""
    found = []
    for p in here:
        d = np.sqrt(((there - p) ** 2).sum(axis=1))
        found.append(sorted(zip(d.tolist(), ids, strict=True))[:k])
    return found


def test_uneven_density_equals_brute_force(spark):
    """A third of the points in one thousandth of the width, a surface, a sparse volume far off the origin, and copies."""
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(0, 0.01, (500, 3)), np.c_[rng.uniform(0, 10, (600, 2)), np.zeros(600)], rng.uniform(-300, 900, (200, 3)), np.repeat(rng.uniform(0, 10, (4, 3)), 30, axis=0)])
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double, z double").repartition(4)
    want = brute(pts, pts, range(len(pts)), 9)
    got = {}
    for r in spatial.k_nearest(frame, frame, 9).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["distance"], r["b_id"])
    assert len(got) == len(pts)
    for i, nearest in enumerate(want):
        mine = [got[i][n] for n in range(1, 10)]
        assert np.allclose([d for d, _ in mine], [d for d, _ in nearest], rtol=0, atol=1e-9)
        assert [b for _, b in mine] == [b for _, b in nearest]
    means = {r["id"]: r["mean_distance"] for r in spatial.mean_distances(frame, frame, 9).collect()}
    assert np.allclose([means[i] for i in range(len(pts))], [np.mean([d for d, _ in w]) for w in want], atol=1e-9)


def test_small_blocks_and_steps_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pts, other = rng.normal(0, 5, (300, 2)), np.vstack([rng.normal(0, 5, (400, 2)), rng.normal(3, 0.02, (200, 2))])
    a = spark.createDataFrame([(f"a{i}", *map(float, p)) for i, p in enumerate(pts)], "id string, x double, y double")
    b = spark.createDataFrame([(f"b{i}", *map(float, p)) for i, p in enumerate(other)], "id string, x double, y double")
    rows = lambda: sorted(map(tuple, spatial.k_nearest(a, b, 3, axes=("x", "y")).collect()))
    whole = rows()
    want = brute(pts, other, [f"b{i}" for i in range(len(other))], 3)
    assert [(r[0], r[1], r[3]) for r in whole] == sorted((f"a{i}", b_id, n + 1) for i, w in enumerate(want) for n, (_, b_id) in enumerate(w))
    monkeypatch.setattr(spatial, "BLOCK_POINTS", 40)  # read on the driver: a smaller first radius and more rounds
    assert rows() == whole


def test_lattice_ties_take_the_smaller_id(spark):
    pts = np.array([(x, y, 1_000_000) for x in range(12) for y in range(12)], float)
    frame = spark.createDataFrame([(len(pts) - i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double, z double")
    want = brute(pts, pts, [len(pts) - i for i in range(len(pts))], 4)
    got = {}
    for r in spatial.k_nearest(frame, frame, 4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["distance"], r["b_id"]))
    assert all(got[len(pts) - i] == w for i, w in enumerate(want))


def test_null_ids_and_more_neighbours_than_points(spark):
    big = 2**60 + 1  # a double would round it
    frame = spark.createDataFrame([(None, 0.0, 0.0), (big, 1.0, 0.0), (big + 2, 3.0, 0.0)], "id long, x double, y double")
    got = {(r["id"], r["rank"]): r["b_id"] for r in spatial.k_nearest(frame, frame, 10, axes=("x", "y")).collect()}
    assert len(got) == 9 and got[big, 1] == big and got[big + 2, 2] == big and got[None, 1] is None
