"""Surfaces, registration, coverage and grids (C11 to C41, R22 to R27) over the points of the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import graphs
from ..operators import routing as R
from ..operators import searches
from ..operators import surfaces as S
from ..sources.tables import table
from .clouds import _P, _cloud
from .registry import query

_RING = [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]
_ADDED, _REMOVED = f"SELECT * FROM ({_P}) WHERE id % 3 = 0", f"SELECT * FROM ({_P}) WHERE id % 3 = 1"


def _thirds(spark, d):
    p = _cloud(spark, d)
    return p.where("id % 3 = 0"), p.where("id % 3 = 1")


@query("c11_surface_normals", f"SELECT id, -0.3 AS nx, 0.2 AS ny, 1.0 AS nz FROM ({_P})")
def c11(spark, d):
    plane = _cloud(spark, d).withColumn("z", 0.3 * F.col("x") - 0.2 * F.col("y") + 0.5)
    n = S.surface_normals(plane, 8)
    return n.select("id", F.round(F.col("nx") / F.col("nz"), 6).alias("nx"), F.round(F.col("ny") / F.col("nz"), 6).alias("ny"), F.round(F.col("nz") / F.col("nz"), 6).alias("nz"))


@query("c13_convex_hull")
def c13(spark, d):
    hulls = S.convex_hulls(_cloud(spark, d).select(F.col("label").alias("part"), "x", "y"))
    return hulls.select("part", F.size("hull").alias("corners"), F.transform("hull", lambda p: F.transform(p, lambda v: F.round(v, 8))).alias("hull"))


_TURN = np.array([[0.96, -0.28, 0.0], [0.28, 0.96, 0.0], [0.0, 0.0, 1.0]])


_NEAR = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


@query("c17_alignment_metrics", f"WITH n AS (SELECT a.id, min({_NEAR}) AS d FROM ({_ADDED}) a LEFT JOIN ({_REMOVED}) b ON {_NEAR} <= 0.08 GROUP BY 1) SELECT count(*) AS points, count(d) AS inliers, round(count(d) / count(*), 8) AS ratio, round(avg(d), 8) AS mean, round(median(d), 8) AS median, round(sqrt(avg(d * d)), 8) AS rms FROM n")
def c17(spark, d):
    m = S.alignment_metrics(*_thirds(spark, d), 0.08)
    return m.select("points", "inliers", *[F.round(c, 8).alias(c) for c in ("ratio", "mean", "median", "rms")])


@query("c19_splice_coverage", f"""WITH a AS (SELECT DISTINCT floor(x / 0.05)::BIGINT AS i, floor(y / 0.05)::BIGINT AS j FROM ({_ADDED})), r AS (SELECT floor(x / 0.05)::BIGINT AS i, floor(y / 0.05)::BIGINT AS j FROM ({_REMOVED})),
m AS (SELECT *, NOT EXISTS (SELECT 1 FROM a WHERE abs(a.i - r.i) <= 1 AND abs(a.j - r.j) <= 1) AS bare FROM r) SELECT count(*) AS removed, count(DISTINCT (i, j)) AS removed_cells, count(*) FILTER (bare) AS uncovered, count(DISTINCT (i, j)) FILTER (bare) AS uncovered_cells, round(count(*) FILTER (bare) / count(*), 8) AS fraction FROM m""")
def c19(spark, d):
    added, removed = _thirds(spark, d)
    return S.splice_coverage(removed, added, 0.05).withColumn("fraction", F.round("fraction", 8))


@query("c20_seam_step", "SELECT 0.02::DOUBLE AS step, true AS matched")
def c20(spark, d):
    added, kept = _thirds(spark, d)
    plane = 0.5 * F.col("x")  # the kept surface; the added one lies 0.02 across it
    lifted = added.withColumn("z", plane + 0.02 * F.sqrt(F.lit(1.25)))
    return S.seam_step(lifted, kept.withColumn("z", plane), _RING, 0.1).select(F.round("step", 6).alias("step"), (F.col("matched") >= 3).alias("matched"))


@query("c22_floor_footprint", f"WITH q AS (SELECT quantile_cont(z, 0.02) AS low FROM ({_P})) SELECT DISTINCT floor(x / 0.1)::BIGINT AS i, floor(y / 0.1)::BIGINT AS j FROM ({_P}), q WHERE z <= low + 0.15")
def c22(spark, d):
    return S.floor_footprint(_cloud(spark, d), 0.1)


@query("c23_free_space_conflict", f"""WITH o AS (SELECT * FROM ({_ADDED})), f AS (SELECT floor(x / 0.1) AS i, floor(y / 0.1) AS j, min(z) - 0.4 AS z FROM o GROUP BY 1, 2), c AS (SELECT b.* FROM ({_REMOVED}) b JOIN f ON floor(b.x / 0.1) = i AND floor(b.y / 0.1) = j WHERE b.z - f.z BETWEEN 0.3 AND 1.8),
m AS (SELECT NOT EXISTS (SELECT 1 FROM o a WHERE {_NEAR} <= 0.15) AS alone FROM c b) SELECT count(*) AS candidates, CASE WHEN count(*) >= 50 THEN count(*) FILTER (alone) ELSE 0 END AS conflicting, CASE WHEN count(*) >= 50 THEN round(count(*) FILTER (alone) / count(*), 8) ELSE 0 END AS fraction, count(*) >= 50 AS measurable FROM m""")
def c23(spark, d):
    observer, other = _thirds(spark, d)
    floor = S.cells_of(observer, 0.1).groupBy("i", "j").agg((F.min("z") - 0.4).alias("z"))
    return S.free_space_conflict(observer, floor, other, 0.1).withColumn("fraction", F.round("fraction", 8))


_OUT = "greatest(abs((i + 0.5) * 0.05) - 0.1, abs((j + 0.5) * 0.05) - 0.1) > 0 AND sqrt(greatest(0, abs((i + 0.5) * 0.05) - 0.1) ** 2 + greatest(0, abs((j + 0.5) * 0.05) - 0.1) ** 2) > 0.04"
_SURFACE = "SELECT floor(x / 0.05)::BIGINT AS i, floor(y / 0.05)::BIGINT AS j, round(min(z), 6) AS ground, count(*) % 2 = 0 AS obstacle, count(*) > 3 AS level_change FROM ({0}) GROUP BY 1, 2"


@query("c24_distance_transform", f"""WITH c AS (SELECT floor(x / 0.05)::BIGINT AS i, floor(y / 0.05)::BIGINT AS j, count(*) AS n FROM ({_P}) GROUP BY 1, 2) SELECT a.i, a.j, round(min(sqrt((a.i - b.i) ** 2 + (a.j - b.j) ** 2)) * 0.05, 8) AS distance FROM c a, c b WHERE b.n > 4 GROUP BY 1, 2""")
def c24(spark, d):
    cells = S.cells_of(_cloud(spark, d), 0.05).groupBy("i", "j").agg(F.count("*").alias("n"))
    return S.distance_to_mask(cells, cells.where("n > 4"), 0.05).withColumn("distance", F.round("distance", 8))


@query("c26_cells_outside_region", f"SELECT i, j FROM (SELECT DISTINCT floor(x / 0.05)::BIGINT AS i, floor(y / 0.05)::BIGINT AS j FROM ({_P})) WHERE {_OUT}")
def c26(spark, d):
    return S.outside_region(S.cells_of(_cloud(spark, d), 0.05).select("i", "j").distinct(), _RING, 0.05, 0.04)


@query("c27_compare_surfaces", f"""WITH p AS ({_SURFACE.format(_ADDED)}), m AS ({_SURFACE.format(_REMOVED)}), b AS (SELECT i, j, p.ground AS pg, m.ground AS mg, coalesce(p.obstacle, false) AS po, coalesce(m.obstacle, false) AS mo, coalesce(p.level_change, false) AS pl, coalesce(m.level_change, false) AS ml FROM p FULL JOIN m USING (i, j)),
t AS (SELECT (pg IS NULL) <> (mg IS NULL) OR coalesce(abs(pg - mg) > 1e-6, false) AS g, po AND NOT mo AS lost, NOT po AND mo AS added, pl <> ml AS l FROM b WHERE {_OUT})
SELECT count(*) AS compared, count(*) FILTER (g OR lost OR added OR l) AS differing, count(*) FILTER (g) AS ground_differing, count(*) FILTER (lost) AS obstacle_lost, count(*) FILTER (added) AS obstacle_added, count(*) FILTER (l) AS level_differing, count(*) FILTER (g OR lost OR added OR l) = 0 AS consistent FROM t""")
def c27(spark, d):
    surface = lambda p: S.cells_of(p, 0.05).groupBy("i", "j").agg(F.round(F.min("z"), 6).alias("ground"), (F.count("*") % 2 == 0).alias("obstacle"), (F.count("*") > 3).alias("level_change"))
    added, removed = _thirds(spark, d)
    return S.compare_surfaces(surface(added), surface(removed), _RING, 0.05, 0.04)


_SEEN = "SELECT p_size AS cell, p_retailprice / 10000 AS weight, (p_partkey * 37 % 360)::DOUBLE AS bearing FROM part"
_STATE = f"""o AS ({_SEEN}), w AS (SELECT a.cell, max(180 - abs((a.bearing - b.bearing + 360) % 360 - 180)) AS angle FROM o a JOIN o b USING (cell) GROUP BY 1), s AS (SELECT cell, sum(weight) AS mass, any_value(angle) AS angle FROM o JOIN w USING (cell) GROUP BY 1)"""


def _observed(spark, d):
    return table(spark, d, "part").select(F.col("p_size").alias("cell"), (F.col("p_retailprice") / 10000).alias("weight"), (F.col("p_partkey") * 37 % 360).cast("double").alias("bearing"))


@query("c34_coverage_state", f"WITH {_STATE} SELECT cell, round(mass, 8) AS mass, angle, round(least(1, mass / 0.5) * least(1, angle / 120), 8) AS f FROM s")
def c34(spark, d):
    return S.coverage_state(_observed(spark, d), 0.5, 120.0).select("cell", F.round("mass", 8).alias("mass"), "angle", F.round("f", 8).alias("f"))


@query("c35_coverage_metrics", f"""WITH {_STATE}, t AS (SELECT n.cell, 1 + n.cell % 3 AS importance, coalesce(mass, 0) AS mass, coalesce(angle, 0) AS angle, CASE WHEN s.mass IS NULL THEN 0 ELSE least(1, s.mass / 0.5) * least(1, s.angle / 120) END AS f FROM (SELECT unnest(generate_series(1, 60)) AS cell) n LEFT JOIN s USING (cell))
SELECT count(*) * 0.25 AS target_area, count(*) FILTER (mass >= 0.5 - 1e-9 AND angle >= 120 - 1e-9) * 0.25 AS covered_area, round(sum(importance * f) / sum(importance), 8) AS weighted, round((sum(mass) - sum(least(mass, 0.5))) / sum(mass), 8) AS redundant FROM t""")
def c35(spark, d):
    targets = spark.range(1, 61).select(F.col("id").alias("cell"), (1 + F.col("id") % 3).cast("double").alias("importance"))
    m = S.coverage_metrics(targets, S.coverage_state(_observed(spark, d), 0.5, 120.0), 0.5, 120.0, 0.25)
    return m.select("target_area", "covered_area", F.round("weighted", 8).alias("weighted"), F.round("redundant", 8).alias("redundant"))


_CELLS = f"SELECT DISTINCT floor(x / 0.05)::BIGINT AS i, floor(y / 0.05)::BIGINT AS j FROM ({_ADDED})"


@query("c38_uncovered_regions", f"""WITH RECURSIVE c AS ({_CELLS}), r AS (SELECT i, j, i AS ri, j AS rj FROM c UNION SELECT c.i, c.j, r.ri, r.rj FROM r JOIN c ON abs(c.i - r.i) + abs(c.j - r.j) = 1), m AS (SELECT i, j, min((ri, rj)) AS first FROM r GROUP BY 1, 2)
SELECT i, j, first[1] AS region_i, first[2] AS region_j, count(*) OVER (PARTITION BY first) AS size FROM m""")
def c38(spark, d):
    return S.cell_regions(S.cells_of(_thirds(spark, d)[0], 0.05))


@query("c39_reprojection", f"""WITH v AS (SELECT id // 2 AS id, id % 2 + 1 AS version, CASE WHEN id % 5 = 0 THEN 'b' ELSE 'a' END AS frame, x, y, z FROM ({_P})), l AS (SELECT * FROM v QUALIFY version = max(version) OVER (PARTITION BY id))
SELECT id, version + 1 AS version, 'c' AS frame, round(1 + 2 * (0.96 * x - 0.28 * y), 8) AS x, round(2 + 2 * (0.28 * x + 0.96 * y), 8) AS y, round(3 + 2 * z, 8) AS z FROM l WHERE frame = 'a'""")
def c39(spark, d):
    p = _cloud(spark, d)
    versions = p.select(F.floor(F.col("id") / 2).alias("id"), (F.col("id") % 2 + 1).alias("version"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("frame"), *S.AXES)
    return S.reproject(versions, 2.0, _TURN, (1.0, 2.0, 3.0), "a", "c").select("id", "version", "frame", *[F.round(a, 8).alias(a) for a in S.AXES])


@query("c40_triangulation", f"SELECT id AS point, 4 AS rays, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, 0.0::DOUBLE AS rms FROM ({_P})")
def c40(spark, d):
    eyes = F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(f"o{a}") for a, v in zip(S.AXES, eye, strict=True)]) for eye in ((2, 0, 1), (-2, 1, 1), (0, 3, 2), (1, -2, 0.5))])).alias("e")
    rays = _cloud(spark, d).select(F.col("id").alias("point"), *S.AXES, eyes).select("point", "e.*", *[((F.col(a) - F.col(f"e.o{a}")) * (1 + F.col("point") % 3)).alias(f"d{a}") for a in S.AXES])
    return S.triangulate(rays).select("point", "rays", *[F.round(a, 6).alias(a) for a in S.AXES], F.round("rms", 6).alias("rms"))


@query("c41_scale_from_distances", """WITH p AS (SELECT p_brand AS part, p_size::DOUBLE AS built, p_size * 2.5 + p_partkey % 3 AS measured FROM part), f AS (SELECT part, sum(built * measured) / sum(built * built) AS scale, count(*) AS pairs FROM p GROUP BY 1)
SELECT part, round(any_value(scale), 8) AS scale, any_value(pairs) AS pairs, round(max(abs(built * scale / measured - 1)), 8) AS spread FROM p JOIN f USING (part) GROUP BY 1""")
def c41(spark, d):
    pairs = table(spark, d, "part").select(F.col("p_brand").alias("part"), F.col("p_size").cast("double").alias("built"), (F.col("p_size") * 2.5 + F.col("p_partkey") % 3).alias("measured"))
    return S.scale_from_distances(pairs).select("part", F.round("scale", 8).alias("scale"), "pairs", F.round("spread", 8).alias("spread"))




_ROOMS = "SELECT c_custkey // 50 AS building, c_custkey AS room, (c_custkey % 10)::DOUBLE AS x, (c_custkey % 7)::DOUBLE AS y FROM customer"


def _rooms(spark, d):
    """Fifty customers make a building. Doors lead two rooms back and, from some, five or eleven; the first room stands where it is."""
    k = F.col("c_custkey")
    rooms = table(spark, d, "customer").select(F.floor(k / 50).alias("building"), k.alias("room"), (k % 50 == 0).alias("fixed"), (k % 10).cast("double").alias("x"), (k % 7).cast("double").alias("y"))
    doors = rooms.select("building", F.col("room").alias("a"), F.explode(F.array(F.col("room") - 2, F.when(F.col("room") % 7 == 0, F.col("room") - 5), F.when(F.col("room") % 10 == 3, F.col("room") - 11))).alias("b")).where("b IS NOT NULL AND a <> b")
    doors = doors.join(rooms.select("building", F.col("room").alias("b")), ["building", "b"], "left_semi")
    return rooms, doors.select("building", "a", "b", (F.col("a") * 1000 + F.col("b") % 1000).alias("id"), ((F.col("a") * 31 + F.col("b") * 17) % 101).cast("double").alias("weight"), (F.col("b") - F.col("a")).cast("double").alias("dx"), F.lit(1.0).alias("dy"))


_PLANES = "SELECT s_suppkey AS plane, (s_suppkey % 5 - 2) * 0.2::DOUBLE AS nx, (s_suppkey % 3 - 1) * 0.3::DOUBLE AS ny, CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS nz, (s_nationkey - 12) * 0.02::DOUBLE AS d, round(s_acctbal) AS inliers FROM supplier"


@query("c42_gravity", f"""WITH c AS (SELECT x, y, abs(z) AS z, x * 0.2 AS ux, y * 0.2 AS uy, 1.0::DOUBLE AS uz FROM ({_P})), m AS (SELECT avg(ux / l) AS mx, avg(uy / l) AS my, avg(uz / l) AS mz FROM (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS l FROM c)), n AS (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS m FROM m),
p AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM ({_PLANES})), t AS (SELECT p.*, (nx * mx + ny * my + nz * mz) / (l * m) AS dot FROM p, n WHERE m >= 0.5), k AS (SELECT plane, inliers, degrees(acos(least(1, abs(dot)))) AS angle, sign(dot) * nx / l AS nx, sign(dot) * ny / l AS ny, sign(dot) * nz / l AS nz, sign(dot) * d / l AS d FROM t),
s AS (SELECT plane, avg((nx * x + ny * y + nz * z + d > 0)::INT) AS share FROM k, c GROUP BY 1) SELECT plane, round(nz, 8) AS nz, round(angle, 6) AS angle, round(share, 8) AS share FROM k JOIN s USING (plane) WHERE angle <= 30 AND share >= 0.5 ORDER BY inliers DESC, plane LIMIT 1""")
def c42(spark, d):
    k = F.col("s_suppkey")
    planes = table(spark, d, "supplier").select(k.alias("plane"), ((k % 5 - 2) * 0.2).alias("nx"), ((k % 3 - 1) * 0.3).alias("ny"), F.when(k % 2 == 0, 1.0).otherwise(-1.0).alias("nz"), ((F.col("s_nationkey") - 12) * 0.02).alias("d"), F.round("s_acctbal").alias("inliers"))
    cameras = _cloud(spark, d).select("x", "y", F.abs("z").alias("z"), (F.col("x") * 0.2).alias("ux"), (F.col("y") * 0.2).alias("uy"), F.lit(1.0).alias("uz"))
    return S.estimate_gravity(planes, cameras, above=0.5).select("plane", F.round("nz", 8).alias("nz"), F.round("angle", 6).alias("angle"), F.round("share", 8).alias("share"))


@query("r22_loop_confirmed")
def r22(spark, d):
    return S.loop_confirmed(*_rooms(spark, d))


@query("r23_strongest_placement")
def r23(spark, d):
    return S.strongest_placement(*_rooms(spark, d))


def _grid(spark, d):
    return S.cells_of(_thirds(spark, d)[0], 0.05).select(F.lit(0).alias("graph"), "i", "j").distinct()


@query("r26_grid_paths", f"""WITH RECURSIVE c AS MATERIALIZED ({_CELLS}), s AS (SELECT min((i, j)) AS first FROM c), e AS MATERIALIZED (SELECT a.i, a.j, b.i AS ti, b.j AS tj, CASE abs(a.i - b.i) + abs(a.j - b.j) WHEN 1 THEN 1 ELSE sqrt(2) END AS length FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i, a.j) <> (b.i, b.j)
WHERE abs(a.i - b.i) + abs(a.j - b.j) = 1 OR ((b.i, a.j) IN (SELECT (i, j) FROM c) AND (a.i, b.j) IN (SELECT (i, j) FROM c))),
w(i, j, d) USING KEY (i, j) AS (SELECT first[1], first[2], 0.0::DOUBLE FROM s UNION SELECT e.ti, e.tj, min(w.d + e.length) FROM w JOIN e USING (i, j) LEFT JOIN recurring.w r ON r.i = e.ti AND r.j = e.tj WHERE r.d IS NULL OR w.d + e.length < r.d - 1e-12 GROUP BY e.ti, e.tj)
SELECT c.i, c.j, w.d IS NOT NULL AS reached, round(w.d, 6) AS cost, w.d IS NOT NULL AS whole FROM c LEFT JOIN w USING (i, j)""")
def r26(spark, d):
    """Every cell with the cost of its way from the first cell; whole: the cells of the way stand next to each other, and their steps add up to the cost."""
    cells = graphs.materialize(_grid(spark, d).withColumn("id", S.cell_id(F.col("i"), F.col("j"))))
    edges = graphs.materialize(S.grid_edges(cells).select("graph", "a", "b", "length"))
    first = cells.agg(F.min(F.struct("i", "j")).alias("s")).select(F.lit(0).alias("search"), F.lit(0).alias("graph"), S.cell_id(F.col("s.i"), F.col("s.j")).alias("id"))
    found = graphs.materialize(searches.searches(edges, first))
    ways = graphs.materialize(searches.paths(found, cells.select(F.lit(0).alias("search"), F.col("id").alias("request"), F.col("id").alias("target"))))
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.struct(F.get("path", k - 1).alias("a"), F.get("path", k).alias("b")))
    steps = ways.where("size(path) > 1").select("request", F.explode(pairs).alias("step")).select("request", "step.*").join(edges, ["a", "b"], "left")
    sums = steps.groupBy("request").agg(F.sum("length").alias("walked"), F.count("*").alias("n"), F.count("length").alias("known"))
    whole = F.coalesce((F.abs(F.coalesce("walked", F.lit(0.0)) - F.col("cost")) < 1e-9) & (F.coalesce("n", F.lit(0)) == F.coalesce("known", F.lit(0))), F.lit(False))
    return cells.withColumnRenamed("id", "request").join(ways, "request").join(sums, "request", "left").select("i", "j", F.col("cost").isNotNull().alias("reached"), F.round("cost", 6).alias("cost"), whole.alias("whole"))


@query("r27_grid_reachability", f"""WITH RECURSIVE c AS ({_CELLS}), r AS (SELECT min(i) AS i, min((i, j))[2] AS j FROM c UNION SELECT c.i, c.j FROM r JOIN c ON abs(c.i - r.i) + abs(c.j - r.j) = 1) SELECT i, j FROM r""")
def r27(spark, d):
    cells = _grid(spark, d)
    first = cells.agg(F.min(F.struct("i", "j")).alias("s")).select(S.cell_id(F.col("s.i"), F.col("s.j")).alias("id"))
    straight = S.grid_edges(cells).where("length = 1").select("a", "b")
    return cells.withColumn("id", S.cell_id(F.col("i"), F.col("j"))).join(searches.reachable(straight, first), "id", "left_semi").select("i", "j")
