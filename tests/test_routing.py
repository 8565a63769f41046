"""Routes against brute force, and the hand-made building with a narrow passage and two steps."""

import heapq
import math
import random
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import graphs, searches
from plinth.operators import routing as R
from plinth.operators.graphs import materialize
from plinth.plans import catalog

NODES = {"A": (0, 0), "B": (10, 0), "C": (20, 0), "D": (20, 10), "E": (10, 10), "S": (5, 5), "L": (25, 5)}
EDGES = [("A", "B", 2.0, True), ("B", "C", 2.0, True), ("C", "D", 2.0, True), ("D", "E", 2.0, True), ("B", "E", 0.7, True), ("A", "E", 1.5, False), ("A", "S", 2.0, True), ("C", "L", 2.0, True)]


@pytest.mark.parametrize(("step_free", "metres", "speed", "seconds"), [(False, 14.14, R.WALKING, 10.9), (True, 40.0, R.STEP_FREE_WALKING, 40.0)])
def test_room_e(spark, step_free, metres, speed, seconds):
    names = {n: i for i, n in enumerate(NODES)}
    nodes = spark.createDataFrame([(0, names[n], float(x), float(y), 0.0, 0) for n, (x, y) in NODES.items()], "graph int, id long, x double, y double, z double, floor int")
    edges = spark.createDataFrame([(0, names[a], names[b], c, s) for a, b, c, s in EDGES], "graph int, a long, b long, clearance double, step_free boolean")
    walks = graphs.both_ways(R.usable_edges(R.placed_edges(nodes, edges), step_free, 0.9).select("graph", "a", "b", "length"))
    both = R.building_edges(walks, spark.createDataFrame([], "graph int, a long, b long, length double, kind string"), speed)
    found = R.routes(spark.createDataFrame([(1, 0, names["A"], names["E"])], "request int, graph int, source long, target long"), both, "seconds")
    points, total = R.assemble(found, nodes, both, speed)
    row = total.first()
    assert (round(row["distance"], 2), round(row["seconds"], 1), row["transitions"]) == (metres, seconds, 0)
    kinds = [r["kind"] for r in points.orderBy("at").collect()]
    assert kinds[0] == "START" and kinds[-1] == "DESTINATION" and set(kinds[1:-1]) <= {"WAYPOINT"}


def test_unknown_clearance_is_never_step_free(spark):
    edges = spark.createDataFrame([(1, 2, None, True), (1, 3, 1.0, True), (1, 4, 1.0, False)], "a long, b long, clearance double, step_free boolean")
    assert [r["b"] for r in R.usable_edges(edges, True, 0.9).collect()] == [3]


def test_routes_equal_all_pairs_and_find_nothing_out_of_reach(spark):
    rng = random.Random(3)
    n, edges = 30, {}
    for _ in range(70):
        a, b = rng.randrange(n), rng.randrange(n)
        edges[a, b] = min(edges.get((a, b), math.inf), rng.random())
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for (a, b), w in edges.items():
        d[a, b] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    asked = [(a * n + b, 7, a, b) for a in range(n) for b in range(n)]
    found = R.routes(spark.createDataFrame(asked, "request long, graph int, source long, target long"), spark.createDataFrame([(7, a, b, w) for (a, b), w in edges.items()], "graph int, a long, b long, length double"), parts=3)
    for r in found.collect():
        a, b = divmod(r["request"], n)
        if np.isinf(d[a, b]):
            assert r["cost"] is None and r["path"] is None
        else:
            assert abs(r["cost"] - d[a, b]) < 1e-9 and r["path"][0] == a and r["path"][-1] == b
            assert abs(sum(edges[p] for p in zip(r["path"], r["path"][1:], strict=False)) - d[a, b]) < 1e-9
    with pytest.raises(ValueError, match="edges"):
        R.routes(spark.createDataFrame(asked, "request long, graph int, source long, target long"), spark.createDataFrame([(7, 0, 1, -1.0)], "graph int, a long, b long, length double"))


def test_taut_paths_equal_a_search_over_sampled_portals(spark):
    rng = random.Random(5)
    rows, wanted = [], {}
    for route in range(12):
        n = rng.randrange(0, 9)
        mids = [(2.0 * i, rng.uniform(-3, 3), rng.uniform(0.2, 1.5)) for i in range(n + 2)]
        mids[0], mids[-1] = (*mids[0][:2], 0.0), (*mids[-1][:2], 0.0)
        rows += [(route, i, x, y + h, x, y - h) for i, (x, y, h) in enumerate(mids)]
        best = {mids[0][1]: 0.0}
        for x, y, h in mids[1:]:
            best = {v: min(c + math.hypot(2.0, v - u) for u, c in best.items()) for v in (np.linspace(y - h, y + h, 201).tolist() if h else [y])}
        wanted[route] = min(best.values())
    frame = spark.createDataFrame(rows, "route int, at int, lx double, ly double, rx double, ry double")
    middle = {r["route"]: r["length"] for r in R.midpoints(frame).collect()}
    for r in R.pull_tight(frame).collect():
        assert wanted[r["route"]] - 0.01 <= r["length"] <= wanted[r["route"]] + 1e-9 <= middle[r["route"]] + 0.01


def test_cheapest_order_equals_permutations_and_null_costs(spark):
    rng = random.Random(6)
    costs, wanted = [], {}
    for tour in range(6):
        c = {(a, b): None if rng.random() < 0.15 else rng.random() for a in range(6) for b in range(6) if a != b}
        costs += [(tour, a, b, s) for (a, b), s in c.items()]
        totals = [sum(c[p] for p in zip((0, *q), q, strict=False)) for q in permutations(range(1, 6)) if all(c[p] is not None for p in zip((0, *q), q, strict=False))]
        wanted[tour] = min(totals, default=None)
    starts = spark.createDataFrame([(t, 0) for t in range(6)], "tour int, start long")
    for r in R.cheapest_orders(spark.createDataFrame(costs, "tour int, a long, b long, seconds double"), starts).collect():
        assert (r["seconds"] is None) == (wanted[r["tour"]] is None) and (r["seconds"] is None or abs(r["seconds"] - wanted[r["tour"]]) < 1e-9)


def test_portal_without_boxes_and_a_shut_one(spark):
    portals = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 0.0), (2, 0.0, 0.0, 2.0, 0.0), (3, 0.0, 5.0, 0.0, 6.0)], "id int, ax double, ay double, bx double, by double")
    boxes = spark.createDataFrame([(2, -1.0, -1.0, 3.0, 1.0), (3, -0.2, 5.5, 0.2, 5.6)], "id int, min_x double, min_y double, max_x double, max_y double")
    got = {r["id"]: (round(r["widest"], 6), r["passes"]) for r in R.portal_openings(portals, boxes, 0.1).collect()}
    assert got == {1: (2.0, True), 2: (0.0, False), 3: (0.4, True)}


def brute_paths(edges, source):
    """Plain best-first search: distance, and the smallest predecessor that gives it."""
    done, heap = {}, [(0.0, source)]
    while heap:
        far, at = heapq.heappop(heap)
        if at not in done:
            done[at] = far
            for a, b, length in edges:
                if a == at:
                    heapq.heappush(heap, (far + length, b))
    before = {i: min((a for a, b, length in edges if b == i and a in done and length > 0 and done[a] + length == d), default=None) for i, d in done.items()}
    return {i: (d, None if i == source else before[i]) for i, d in done.items()}


@pytest.mark.parametrize("block_nodes", [3, 20_000])
def test_blocks_of_any_size_give_the_shortest_paths(spark, block_nodes):
    rng = random.Random(9)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(1, 9))) for _ in range(90)]
    odd = [(1, None, 1.0), (None, 2, 1.0), (3, 39, None), (3, 38, float("nan"))]
    frame = spark.createDataFrame([*edges, *odd], "a long, b long, length double")
    got = {r["id"]: (r["distance"], r["previous"]) for r in searches.shortest_paths(frame, 3, block_nodes).collect()}
    assert got == brute_paths(edges, 3)
    start = spark.createDataFrame([(3,), (7,), (None,)], "id long")
    assert {r["id"] for r in searches.reachable(frame, start, block_nodes).collect()} >= set(got)
    with pytest.raises(ValueError):
        searches.shortest_paths(spark.createDataFrame([(1, 2, -1.0)], "a long, b long, length double"), 1)


def test_string_ids_and_a_source_without_edges(spark):
    frame = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.0), ("c", "b", 0.0)], "a string, b string, length double")
    assert {(r["id"], r["distance"], r["previous"]) for r in searches.shortest_paths(frame, "a", 1).collect()} == {("a", 0.0, None), ("b", 1.0, "a"), ("c", 1.0, "b")}
    assert [tuple(r) for r in searches.shortest_paths(frame, "z").collect()] == [("z", 0.0, None)]


def test_three_hundred_thousand_edges(spark):
    """A grid of 280 by 280 with steps to four sides, far beyond one task of routes()."""
    n = 280
    cells = spark.range(n * n).select(F.lit(5).alias("graph"), F.col("id").alias("a"), F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("m"))
    edges = cells.withColumns({"i": F.floor(F.col("a") / n) + F.col("m.x"), "j": F.col("a") % n + F.col("m.y")}).where(f"i BETWEEN 0 AND {n - 1} AND j BETWEEN 0 AND {n - 1}").select("graph", "a", (F.col("i") * n + F.col("j")).alias("b"), F.lit(1.0).alias("length"))
    edges = materialize(edges)
    assert edges.count() > 300_000
    found = searches.searches(edges, spark.createDataFrame([(1, 5, 0)], "search int, graph int, id long"))
    assert found.where(F.col("distance") != F.floor(F.col("id") / n) + F.col("id") % n).count() == 0 and found.count() == n * n
    asked = spark.createDataFrame([(1, 5, 0, n * n - 1), (2, 5, 7, 7), (3, 6, 1, 2)], "request int, graph int, source long, target long")
    got = {r["request"]: (r["cost"], r["path"]) for r in R.routes(asked, edges).collect()}
    assert got[1][0] == 2.0 * (n - 1) and len(got[1][1]) == 2 * n - 1 and got[2] == (0.0, [7]) and got[3] == (None, None)


def test_two_opt_leaves_no_stretch_to_turn(spark):
    rng = random.Random(12)
    stops = [(t, at, t * 100 + at, rng.random(), rng.random()) for t in range(5) for at in range(rng.randrange(1, 25))]
    place = {s: (x, y) for _, _, s, x, y in stops}
    length = lambda p: sum(math.dist(place[a], place[b]) for a, b in zip(p, p[1:], strict=False))
    rows = R.two_opt(spark.createDataFrame(stops, "tour int, at int, stop long, x double, y double")).collect()
    for t in range(5):
        path = [r["stop"] for r in sorted((r for r in rows if r["tour"] == t), key=lambda r: r["at"])]
        assert sorted(path) == [s for u, _, s, _, _ in stops if u == t] and path[0] == t * 100
        own = length(path)
        assert next(r["length"] for r in rows if r["tour"] == t) == pytest.approx(own)
        for i in range(1, len(path)):
            for j in range(i + 1, len(path)):
                assert length(path[:i] + path[i : j + 1][::-1] + path[j + 1 :]) >= own - 1e-9


@pytest.mark.parametrize("block_nodes", [4, 20_000])
def test_ids_beyond_53_bits_keep_their_predecessors(spark, block_nodes):
    at, n = 1 << 62, 30
    edges = spark.createDataFrame([(0, at + k, at + k + 1, 1.0) for k in range(n)] + [(0, at + n + 2, at + n + 3, 1.0)], "graph int, a long, b long, length double")
    found = materialize(searches.searches(edges, spark.createDataFrame([(1, 0, at)], "search int, graph int, id long"), block_nodes))
    assert sorted((r["id"] - at, r["previous"] and r["previous"] - at) for r in found.collect()) == [(0, None)] + [(k, k - 1) for k in range(1, n + 1)]
    asked = spark.createDataFrame([(1, 100, at + n), (1, 101, at), (1, 102, at + n + 3), (1, 103, None), (2, 104, at)], "search int, request int, target long")
    got = {r["request"]: (r["cost"], r["path"]) for r in searches.paths(found, asked).collect()}
    assert got == {100: (float(n), [at + k for k in range(n + 1)]), 101: (0.0, [at]), 102: (None, None), 103: (None, None), 104: (None, None)}


def test_paths_of_a_search_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(searches, "REQUESTS", 7)
    monkeypatch.setattr(searches, "PATHS", 3)
    found = spark.createDataFrame([(0, k, float(k.bit_length()), k // 2 or None) for k in range(1, 200)] + [(1, 5, 0.0, None)], "search int, id long, distance double, previous long")
    asked = spark.createDataFrame([(0, f"r{k}", k) for k in range(250)] + [(1, "one", 5)], "search int, request string, target int")
    up = lambda k: [*up(k // 2), k] if k else []
    wanted = {f"r{k}": (float(k.bit_length()), up(k)) if 0 < k < 200 else (None, None) for k in range(250)} | {"one": (0.0, [5])}
    assert {r["request"]: (r["cost"], r["path"]) for r in searches.paths(found, asked).collect()} == wanted
    with pytest.raises(Exception, match="circle"):
        searches.paths(spark.createDataFrame([(0, 1, 0.0, 2), (0, 2, 1.0, 1)], "search int, id long, distance double, previous long"), asked).collect()


def test_grid_paths_of_connected_cells_equal_the_oracle(spark, tmp_path):
    """In the small tables the first cell has no neighbour, so no way was ever walked there."""
    rng = random.Random(26)
    cells = [(i, j) for i in range(12) for j in range(1, 9) if rng.random() < 0.8 or (i, j) == (0, 1)] + [(20, 3)]
    points = [(3 * k, [0.05 * i + 0.025, 0.05 * j + 0.025, 0.0], 0) for k, (i, j) in enumerate(cells)]
    spark.createDataFrame(points, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    columns = "i, j, reached, cost, whole"
    wanted = sorted(con.execute(f"SELECT {columns} FROM ({catalog.ORACLES['r26_grid_paths']})").fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["r26_grid_paths"](spark, str(tmp_path)).select(*columns.split(", ")).collect())
    assert got == wanted and sum(r[2] for r in got) > 50
