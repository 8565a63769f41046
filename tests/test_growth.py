"""Work that must not grow faster than the tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plinth.operators import graphs, registration, relational, searches, spatial, visibility


def test_clusters_make_no_pairs_of_detections(spark, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("a row per pair")

    monkeypatch.setattr(spatial, "radius_pairs", pairs)
    rows = [(i, "a" if i % 2 else None, (i * 7 % 10) / 10, i * 0.01, 0.0, 0.0) for i in range(40)] + [(99, "a", 0.5, 50.0, 0.0, 0.0)]
    got = {r["id"]: r["cluster"] for r in spatial.cluster_by_label(spark.createDataFrame(rows, "id long, label string, confidence double, x double, y double, z double"), 0.6).collect()}
    assert len(got) == 41 and got[99] == 99 and len({got[i] for i in range(1, 40, 2)}) == 1
    assert all(got[i] == i for i in range(0, 40, 2))  # without a label each is its own


def test_a_search_gathers_nodes_whose_ids_lie_apart(spark):
    n = 4 * 601  # cycles of 25, every step far from the ids before it
    edges = spark.range(n).select(F.lit(0).alias("graph"), F.col("id").alias("a"), (F.col("id") * 2 % n).alias("b"), (1.0 + F.col("id") % 7).alias("length"))
    start = spark.createDataFrame([(0, 0, 3)], "search int, graph int, id long")
    got = {r["id"]: (r["distance"], r["previous"]) for r in searches.searches(edges, start, block_nodes=200, rounds=4).collect()}
    want, at, far, before = {}, 3, 0.0, None
    while at not in want:
        want[at] = (far, before)
        far, before, at = far + 1.0 + at % 7, at, at * 2 % n
    assert got == want


def test_clusters_stay_below_their_size(spark):
    ids = spark.range(300).select(F.xxhash64("id").alias("id"))
    chain = spark.range(299).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    found = graphs.clusters(ids, chain, 50).groupBy("cluster").count().toPandas()["count"]
    assert found.sum() == 300 and found.max() <= 50 and len(found) < 60


def test_placements_that_are_the_same_are_scored_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(400, 3))
    turn = registration._yawed(np.array(0.7))
    q = np.where((np.arange(400) < 250)[:, None], p @ turn.T + [1.0, 0.5, 0.1], rng.normal(size=(400, 3)) * 3)
    pairs = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(p, q, strict=True))], "id long, x double, y double, z double, u double, v double, w double")
    asked, plain = [], registration.scores
    monkeypatch.setattr(registration, "scores", lambda pairs, linear, move, reach: asked.append(len(linear)) or plain(pairs, linear, move, reach))
    found = registration.yaw_hypotheses(pairs, 0.01, most=1, support=20)
    assert abs(found[0][0] - 0.7) < 1e-6 and found[0][2] == 250
    drawn = len(asked) and sum(asked)
    yaw, move = np.array([0.7, 0.7 + 1e-12, 0.3, 0.7 - 2e-12]), np.array([[1.0, 0.5, 0.1]] * 4)
    asked.clear()
    reach = 0.5 + 1e-3
    got = registration._counts(pairs, yaw, move, reach, 5.0, 15.0)
    assert (got == plain(pairs, registration._yawed(yaw), move, reach)[0]).all()
    assert drawn < 500  # 1,000 draws and more, most of them two right correspondences


def test_many_small_groups_share_a_call(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.floor(F.col("id") / 3)).alias("k"), "id")

    def run(pdf, begins):
        size = np.diff(np.r_[begins, len(pdf)])
        return pd.DataFrame({"k": pdf["k"], "n": np.repeat(size, size), "calls": len(begins)})

    got = relational.in_groups(rows, ["k"], [F.col("id")], run, "k long, n int, calls int", rows=500).toPandas()
    want = rows.groupBy(F.coalesce("k", F.lit(-1)).alias("k")).count().toPandas().set_index("k")["count"]
    assert len(got) == 3000 and (got.groupby(got["k"].fillna(-1))["n"].first().to_numpy() == want.sort_index().to_numpy()).all()
    assert got["calls"].max() > 20


def test_systems_side_by_side_equal_each_alone():
    rng = np.random.default_rng(1)
    diagonal = np.eye(2) * 5 + rng.normal(size=(7, 2, 2)) * 0.1
    diagonal, right, owner = diagonal + np.swapaxes(diagonal, 1, 2), rng.normal(size=(7, 2)), np.array([0, 0, 0, 1, 1, 1, 1])
    a, b, block = np.array([0, 1, 3, 4, 5]), np.array([1, 2, 4, 5, 6]), rng.normal(size=(5, 2, 2))
    both = registration.conjugate_gradients(diagonal, a, b, block, right, owner=owner)
    for own, at in ((slice(0, 3), slice(0, 2)), (slice(3, 7), slice(2, 5))):
        alone = registration.conjugate_gradients(diagonal[own], a[at] - own.start, b[at] - own.start, block[at], right[own])
        assert np.abs(alone - both[own]).max() < 1e-9


def test_a_cell_keeps_few_bearings(spark, monkeypatch):
    asked, plain = [], visibility.gains
    monkeypatch.setattr(visibility, "gains", lambda seen, state, *rest: asked.append(state.agg(F.max(F.size("bearings"))).first()[0]) or plain(seen, state, *rest))
    known = spark.range(2000).select(F.lit(1).alias("cell"), F.lit(1e-5).alias("weight"), (F.col("id") * 0.05).alias("bearing"))  # 100 degrees of them
    seen = spark.createDataFrame([(1, 1, 0.5, 130.0), (2, 1, 0.5, 50.0)], "view int, cell int, weight double, bearing double")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "view int, x double, y double")
    targets = spark.createDataFrame([(1, 1.0)], "cell int, importance double")
    picks, _ = visibility.choose_views(seen, places, targets, 1, 1.0, 120.0, (0.0, 0.0), 1.0, known=known)
    assert max(asked) <= 72
    assert picks[0][0] == 1 and abs(picks[0][3] - (0.52 - 0.02 * 99.95 / 120)) < 1e-8  # 130 against 0 degrees is wide enough


def test_percentiles_equal_the_built_in_ones(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a key has several parts
    try:
        rows = spark.range(3000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.hash("id") % 90 / 4).alias("v"))
        rows = rows.unionByName(spark.createDataFrame([(7, None), (8, 1.5), (9, float("nan")), (9, 2.0), (9, 0.0)], "k long, v double"))
        shares = {"least": 0.0, "some": 0.37, "half": 0.5, "p99": 0.99, "most": 1.0}
        for keys in (["k"], []):
            want = rows.groupBy(*keys).agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()])
            assert sorted(map(str, relational.percentiles(rows, keys, "v", shares).collect())) == sorted(map(str, want.collect()))
        assert relational.percentiles(rows.limit(0), [], "v", shares).first()["half"] is None
        assert relational.percentiles(rows.limit(0), ["k"], "v", shares).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_percentiles_of_a_table_hold_no_group_in_one_task(spark):
    from plinth.plans import catalog

    for name in ("g11_percentiles", "g46_latency_percentiles", "s22_metrics"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "percentile(" not in plan
