import hashlib
import math
import random

import numpy as np
import pytest

from plinth.llm.ballmeans import ball_kmeans, nearest, neighbours, op11_ball_kmeans, reassign


def brute(rows, k=40, rounds=5):
    """rows: (id, components). Plain Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        to = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, to, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    to = assign()
    per = {}
    for c, d in to:
        per[c] = per.get(c, 0) + d
    return sorted([(i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, to, strict=True)], key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, op11_ball_kmeans(spark, str(tmp_path)).select(*COLUMNS).collect()), key=repr)


def clouds(n, k, seed, spread=0.05):
    rng = random.Random(seed)
    middles = [[rng.randrange(-256, 256) / 256 for _ in range(64)] for _ in range(k)]
    return [(i, [m + rng.randrange(-8, 8) / 256 * (spread / 0.05) for m in middles[i % k]]) for i in range(n)]


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = clouds(150, 12, 2) + [(1000 + i, [rng.choice([0.0, 1 / 256]) for _ in range(64)]) for i in range(60)]  # the latter with many ties
    rows += [(2000, None), (2001, [0.5] * 63), (2002, [0.5] * 63 + [None]), (2003, [0.5] * 63 + [float("nan")]), (2004, [0.5] * 63 + [float("inf")]), rows[0], rows[0], (None, [0.25] * 64)]
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_vectors(spark, tmp_path, n):
    rows = clouds(n, 3, 4)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_components_beyond_the_bound_take_no_part(spark):
    rows = [(1, [1.0] * 64), (2, [1e30] * 64), (3, [-2.0] * 64)]
    found, centroids = ball_kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2)
    assert sorted(r["id"] for r in found.collect()) == [1, 3] and len(centroids) == 2


@pytest.mark.parametrize("most", [20, 1 << 25])
def test_annuli_lose_no_nearer_centroid_and_ties_take_the_smaller_number(most):
    rng = np.random.default_rng(7)
    for _ in range(30):
        d, k = int(rng.integers(1, 5)), int(rng.integers(2, 30))
        v = rng.integers(-most, most, (300, d))
        old = v[rng.choice(300, k)]
        cluster, far, _ = nearest(v, old)
        new = old + rng.integers(-3, 4, old.shape)
        radius = np.array([math.sqrt(far[cluster == i].max(initial=0)) + math.sqrt(((new[i] - old[i]) ** 2).sum()) for i in range(k)])
        to, best, _ = reassign(v, cluster, new, neighbours(new, radius))
        want, least, _ = nearest(v, new)
        assert (to == want).all() and (best == least).all()


def test_cores_and_annuli_save_comparisons(spark):
    """Well separated balls: after the first pass, nearly every vector is in a core."""
    rows = spark.createDataFrame(clouds(2000, 20, 9), "vec_id long, embedding array<double>")
    found, centroids = ball_kmeans(rows, k=20)
    compared = found.agg({"compared": "sum"}).first()[0]
    assert 2000 <= compared < 0.5 * 2000 * len(centroids)
