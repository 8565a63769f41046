"""Spatial joins, point clouds and routes (J20-J30, G33-G39, C, R)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graphs
from ..operators import searches
from ..operators import spatial as S
from ..sources.tables import table
from .registry import query

_P = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings"
_PAIR = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


def _cloud(spark, d):
    x = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), x(0).alias("x"), x(1).alias("y"), x(2).alias("z"), "label")


def _halves(spark, d):
    p = _cloud(spark, d)
    return p.where("id % 2 = 0"), p.where("id % 2 = 1")


@query("j20_nearest_neighbour", f"WITH p AS ({_P}), r AS (SELECT a.id, b.id AS b_id, {_PAIR} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {_PAIR}, b.id) AS k FROM p a, p b WHERE a.id % 2 = 0 AND b.id % 2 = 1) SELECT id, b_id, round(dist, 8) AS distance FROM r WHERE k = 1")
def j20(spark, d):
    a, b = _halves(spark, d)
    return S.k_nearest(a, b, 1).select("id", "b_id", F.round("distance", 8).alias("distance"))


@query("j21_k_nearest", f"WITH p AS ({_P}), r AS (SELECT a.id, {_PAIR} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {_PAIR}, b.id) AS k FROM p a, p b) SELECT id, round(avg(dist), 8) AS mean_distance FROM r WHERE k <= 5 GROUP BY 1")
def j21(spark, d):
    p = _cloud(spark, d)
    return S.k_nearest(p, p, 5).groupBy("id").agg(F.round(F.avg("distance"), 8).alias("mean_distance"))


@query("j22_radius_pairs", f"WITH p AS ({_P}) SELECT a.id AS a_id, b.id AS b_id FROM p a JOIN p b ON a.id < b.id AND {_PAIR} <= 0.03")
def j22(spark, d):
    p = _cloud(spark, d)
    return S.radius_pairs(p, p, 0.03).where("a_id < b_id").select("a_id", "b_id")


@query("j23_radius_counts", f"WITH p AS ({_P}) SELECT a.id, count(*) AS n FROM p a JOIN p b ON {_PAIR} <= 0.04 GROUP BY 1")
def j23(spark, d):
    return S.neighbour_counts(_cloud(spark, d), 0.04)


@query("j24_bounded_nearest", f"WITH p AS ({_P}), r AS (SELECT a.id, min({_PAIR}) AS dist FROM p a JOIN p b ON a.id % 2 = 0 AND b.id % 2 = 1 AND {_PAIR} <= 0.03 GROUP BY 1) SELECT p.id, round(dist, 8) AS distance FROM p LEFT JOIN r USING (id) WHERE p.id % 2 = 0")
def j24(spark, d):
    a, b = _halves(spark, d)
    return S.nearest(a, b, 0.03).select("id", F.round("distance", 8).alias("distance"))


_RINGS = [(1, [(-0.2, -0.2), (0.1, -0.2), (0.1, 0.15), (-0.2, 0.05)]), (2, [(0.0, 0.0), (0.3, 0.0), (0.1, 0.3)])]


def _regions(spark):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in ring]) for i, ring in _RINGS], "region int, ring array<struct<x:double,y:double>>")


def _inside_sql(ring):
    tests = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ay != by:
            tests.append(f"(CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END)")
    return f"({' + '.join(tests)}) % 2 = 1"


@query("j27_points_in_regions", f"WITH p AS ({_P}) " + " UNION ALL ".join(f"SELECT id, {i} AS region FROM p WHERE {_inside_sql(ring)}" for i, ring in _RINGS))
def j27(spark, d):
    return S.points_in_regions(_cloud(spark, d), _regions(spark), 0.1)


@query("j28_segment_box", f"WITH p AS ({_P}) SELECT id, (least(x, x + 0.1) <= 0.05 AND x + 0.1 >= -0.05 AND y BETWEEN -0.02 AND 0.08) AS blocked FROM p")
def j28(spark, d):
    a, b = F.struct("x", "y"), F.struct((F.col("x") + 0.1).alias("x"), "y")
    box = F.struct(F.lit(-0.05).alias("min_x"), F.lit(-0.02).alias("min_y"), F.lit(0.05).alias("max_x"), F.lit(0.08).alias("max_y"))
    return _cloud(spark, d).select("id", G.segment_hits_box(a, b, box).alias("blocked"))


@query("j29_grid_neighbours", f"WITH c AS (SELECT DISTINCT floor(x / 0.1)::BIGINT AS i, floor(y / 0.1)::BIGINT AS j FROM ({_P})) SELECT a.i, a.j, count(*) AS n FROM c a JOIN c b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2")
def j29(spark, d):
    cells = _cloud(spark, d).select(F.floor(F.col("x") / 0.1).alias("i"), F.floor(F.col("y") / 0.1).alias("j")).distinct()
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = cells.withColumn("m", F.explode(moves)).select("i", "j", (F.col("i") + F.col("m.a")).alias("ni"), (F.col("j") + F.col("m.b")).alias("nj"))
    return near.join(cells.toDF("ni", "nj"), ["ni", "nj"]).groupBy("i", "j").agg(F.count("*").alias("n"))


def _boxes(spark, d, shift):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.floor(k / 20).alias("image"), (F.col("p_size") % 3).cast("long").alias("class"), F.col("p_retailprice").alias("score"), ((k * 7 + shift) % 40).cast("double").alias("x"), ((k * 3) % 30).cast("double").alias("y"), F.lit(12.0).alias("w"), F.lit(10.0).alias("h"))


@query("j30_greedy_matching")
def j30(spark, d):
    return S.match_detections(_boxes(spark, d, 1), _boxes(spark, d, 0).where("id % 2 = 0"))


@query("g33_voxel_downsample", f"SELECT floor(x / 0.1)::BIGINT AS c_x, floor(y / 0.1)::BIGINT AS c_y, floor(z / 0.1)::BIGINT AS c_z, count(*) AS n, round(avg(x), 8) AS x, round(avg(y), 8) AS y, round(avg(z), 8) AS z FROM ({_P}) GROUP BY 1, 2, 3")
def g33(spark, d):
    return S.voxel_downsample(_cloud(spark, d), 0.1).select("c_x", "c_y", "c_z", "n", *[F.round(a, 8).alias(a) for a in "xyz"])


@query("g34_median_floor_height", f"SELECT floor(x / 0.1)::BIGINT AS i, floor(y / 0.1)::BIGINT AS j, round(median(z), 8) AS z FROM ({_P}) GROUP BY 1, 2")
def g34(spark, d):
    return _cloud(spark, d).groupBy(F.floor(F.col("x") / 0.1).alias("i"), F.floor(F.col("y") / 0.1).alias("j")).agg(F.round(F.percentile("z", 0.5), 8).alias("z"))


@query("g35_lowest_dense_band", f"WITH c AS (SELECT id, z, floor(x / 0.2)::BIGINT AS c_x, floor(y / 0.2)::BIGINT AS c_y FROM ({_P})), l AS (SELECT *, lead(z, 2) OVER (PARTITION BY c_x, c_y ORDER BY z, id) AS top FROM c) SELECT c_x, c_y, min(z) AS z FROM l WHERE top - z <= 0.05 GROUP BY 1, 2")
def g35(spark, d):
    return S.lowest_dense_band(_cloud(spark, d), 0.2, 3, 0.05)


@query("g36_cell_extremes", f"SELECT floor(x / 0.1)::BIGINT AS i, max(z) AS top, min(z) AS front FROM ({_P}) GROUP BY 1")
def g36(spark, d):
    return _cloud(spark, d).groupBy(F.floor(F.col("x") / 0.1).alias("i")).agg(F.max("z").alias("top"), F.min("z").alias("front"))


@query("g37_occupied_area", f"SELECT round(count(DISTINCT (floor(x / 0.1), floor(y / 0.1))) * 0.01, 6) AS area FROM ({_P})")
def g37(spark, d):
    return _cloud(spark, d).agg(F.round(F.count_distinct(F.floor(F.col("x") / 0.1), F.floor(F.col("y") / 0.1)) * 0.01, 6).alias("area"))


@query("g38_median_spacing", f"WITH p AS ({_P}), n AS (SELECT a.id, min({_PAIR}) AS s FROM p a JOIN p b ON a.id <> b.id GROUP BY 1) SELECT round(median(s), 8) AS spacing FROM n")
def g38(spark, d):
    return S.median_spacing(_cloud(spark, d)).select(F.round("spacing", 8).alias("spacing"))


@query("g39_sigma_threshold", "SELECT round(avg(l_quantity) + 2 * stddev_pop(l_quantity), 6) AS threshold FROM lineitem")
def g39(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.avg("l_quantity") + 2 * F.stddev_pop("l_quantity"), 6).alias("threshold"))


@query("c01_statistical_outliers", f"WITH p AS ({_P}), r AS (SELECT a.id, {_PAIR} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {_PAIR}, b.id) AS k FROM p a, p b), m AS (SELECT id, avg(dist) AS md FROM r WHERE k <= 20 GROUP BY 1) SELECT id, md <= (SELECT avg(md) + 2 * stddev_pop(md) FROM m) AS keep FROM m")
def c01(spark, d):
    return S.statistical_outliers(_cloud(spark, d), 20, 2.0).select("id", "keep")


@query("c02_radius_outliers", f"WITH p AS ({_P}) SELECT a.id, count(*) >= 4 AS keep FROM p a JOIN p b ON {_PAIR} <= 0.05 GROUP BY 1")
def c02(spark, d):
    return S.radius_outliers(_cloud(spark, d), 0.05, 4).select("id", "keep")


@query("c03_adaptive_threshold", f"WITH p AS ({_P}), c AS (SELECT a.id, count(*) AS n FROM p a JOIN p b ON {_PAIR} <= 0.06 GROUP BY 1) SELECT least(8, greatest(3, ceil(0.35 * median(n))))::INT AS threshold FROM c")
def c03(spark, d):
    return S.adaptive_threshold(S.neighbour_counts(_cloud(spark, d), 0.06), 0.35, 8)


@query("c04_opacity_mask", f"SELECT id FROM ({_P}) WHERE 1 / (1 + exp(-x * 30)) >= 0.05")
def c04(spark, d):
    return _cloud(spark, d).where(1 / (1 + F.exp(-F.col("x") * 30)) >= 0.05).select("id")


@query("c05_sparse_opacity", f"WITH p AS ({_P}), c AS (SELECT a.id, count(*) AS n FROM p a JOIN p b ON {_PAIR} <= 0.05 GROUP BY 1) SELECT id, NOT (1 / (1 + exp(-x * 30)) < 0.3 AND n < 3) AS keep FROM p JOIN c USING (id)")
def c05(spark, d):
    p = _cloud(spark, d)
    faint = 1 / (1 + F.exp(-F.col("x") * 30)) < 0.3
    return p.join(S.neighbour_counts(p, 0.05), "id").select("id", (~(faint & (F.col("n") < 3))).alias("keep"))


@query("c06_clutter_mask", f"WITH p AS (SELECT id, x, y, z, CASE WHEN label = 3 THEN 'clutter' ELSE 'floor' END AS l FROM ({_P})), c AS (SELECT a.id, count(*) - 1 AS n FROM p a JOIN p b ON a.l = 'clutter' AND b.l = 'clutter' AND {_PAIR} <= 0.1 GROUP BY 1) SELECT id, l <> 'clutter' OR n >= 1 AS keep FROM p LEFT JOIN c USING (id)")
def c06(spark, d):
    p = _cloud(spark, d).withColumn("label", F.when(F.col("label") == 3, "clutter").otherwise("floor"))
    return S.clutter_mask(p, 0.1, 1)


@query("c07_cleanup_report", f"WITH p AS ({_P}), c AS (SELECT a.id, count(*) AS n FROM p a JOIN p b ON {_PAIR} <= 0.05 GROUP BY 1), m AS (SELECT 1 / (1 + exp(-x * 30)) >= 0.05 AS o, n >= 4 AS r FROM p JOIN c USING (id)) SELECT count(*) AS total, count(*) FILTER (NOT o) AS by_opacity, count(*) FILTER (NOT r) AS by_radius, count(*) FILTER (o AND r) AS kept FROM m")
def c07(spark, d):
    p = _cloud(spark, d)
    masks = p.join(S.radius_outliers(p, 0.05, 4), "id").select((1 / (1 + F.exp(-F.col("x") * 30)) >= 0.05).alias("o"), F.col("keep").alias("r"))
    return masks.agg(F.count("*").alias("total"), F.count_if(~F.col("o")).alias("by_opacity"), F.count_if(~F.col("r")).alias("by_radius"), F.count_if(F.col("o") & F.col("r")).alias("kept"))


@query("c08_ransac_planes")
def c08(spark, d):
    return S.fit_planes(_cloud(spark, d), 0.03, max_planes=6, min_inliers=30)


@query("c09_plane_class", "SELECT p_partkey, CASE WHEN p_size * 2 <= 25 THEN 'floor' WHEN p_size * 2 >= 65 THEN 'wall' ELSE 'other' END AS kind FROM part")
def c09(spark, d):
    tilt = F.degrees(F.acos(F.abs(F.cos(F.radians(F.col("p_size") * 2.0)))))
    tilt = F.when(F.col("p_size") * 2 > 90, F.col("p_size") * 2.0).otherwise(tilt)
    return table(spark, d, "part").select("p_partkey", F.when(F.round(tilt, 6) <= 25, "floor").when(F.round(tilt, 6) >= 65, "wall").otherwise("other").alias("kind"))


@query("c10_label_agreement", "SELECT p_size, round(avg((p_type = 'STEEL')::INT), 8) AS agreement FROM part GROUP BY 1")
def c10(spark, d):
    return table(spark, d, "part").groupBy("p_size").agg(F.round(F.avg((F.col("p_type") == "STEEL").cast("int")), 8).alias("agreement"))


@query("c12_change_detection", f"WITH p AS ({_P}), b AS (SELECT * FROM p WHERE id % 10 <> 0), a AS (SELECT * FROM p WHERE id % 10 <> 1), ad AS (SELECT x, y FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_PAIR} <= 0.05)), re AS (SELECT x, y FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_PAIR} <= 0.05)), u AS (SELECT * FROM ad UNION ALL SELECT * FROM re) SELECT (SELECT count(*) FROM ad) AS added, (SELECT count(*) FROM re) AS removed, round((SELECT count(DISTINCT (floor(x / 0.25), floor(y / 0.25))) FROM u) * 0.0625, 6) AS area, round((SELECT count(*) FROM u) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)), 8) AS ratio")
def c12(spark, d):
    p = _cloud(spark, d)
    return S.changes(p.where("id % 10 <> 0"), p.where("id % 10 <> 1"), 0.05, 0.25).select("added", "removed", F.round("area", 6).alias("area"), F.round("ratio", 8).alias("ratio"))


@query("c14_similarity_fit", "SELECT 2.0::DOUBLE AS scale, 0.28::DOUBLE AS r00, 1.0::DOUBLE AS tx")
def c14(spark, d):
    p = _cloud(spark, d)
    turned = p.select("x", "y", "z", (2 * (0.28 * F.col("x") - 0.96 * F.col("y")) + 1).alias("u"), (2 * (0.96 * F.col("x") + 0.28 * F.col("y")) - 2).alias("v"), (2 * F.col("z")).alias("w"))
    scale, rotation, move = S.similarity_fit(turned)
    return spark.createDataFrame([(round(scale, 6), round(float(rotation[0, 0]), 6), round(float(move[0]), 6))], "scale double, r00 double, tx double")


@query("c18_region_splice", f"WITH p AS ({_P}) SELECT id, CASE WHEN {_inside_sql(_RINGS[0][1])} THEN 'new' ELSE 'old' END AS piece FROM p WHERE ({_inside_sql(_RINGS[0][1])}) = (id % 2 = 1)")
def c18(spark, d):
    p = _cloud(spark, d)
    inside = S.points_in_regions(p, _regions(spark).where("region = 1"), 0.1).select("id")
    old = p.where("id % 2 = 0").join(inside, "id", "left_anti").select("id", F.lit("old").alias("piece"))
    return old.unionByName(p.where("id % 2 = 1").join(inside, "id", "left_semi").select("id", F.lit("new").alias("piece")))


@query("c21_voxel_ownership", f"WITH p AS (SELECT id, id % 3 AS capture, (id % 7)::DOUBLE AS depth, floor(x / 0.2) AS i, floor(y / 0.2) AS j, floor(z / 0.2) AS k FROM ({_P})), o AS (SELECT i, j, k, arg_max(capture, (depth, -capture)) AS capture FROM p GROUP BY 1, 2, 3) SELECT id, capture FROM p JOIN o USING (i, j, k, capture)")
def c21(spark, d):
    return S.voxel_owner(_cloud(spark, d).withColumns({"capture": F.col("id") % 3, "depth": (F.col("id") % 7).cast("double")}), 0.2)


@query("c28_front_surface", f"WITH p AS (SELECT id, floor(x / 0.1)::BIGINT AS u, floor(y / 0.1)::BIGINT AS v, z AS depth FROM ({_P})), m AS (SELECT *, min(depth) OVER (PARTITION BY u, v) AS f FROM p) SELECT id FROM m WHERE depth <= f + 0.05")
def c28(spark, d):
    p = _cloud(spark, d).select("id", F.floor(F.col("x") / 0.1).alias("u"), F.floor(F.col("y") / 0.1).alias("v"), F.col("z").alias("depth"))
    return S.front_surface(p, 0.05).select("id")


@query("c30_greedy_clusters")
def c30(spark, d):
    return S.cluster_by_label(_cloud(spark, d).withColumn("confidence", F.abs("z")), 0.15)


@query("c31_box_merge")
def c31(spark, d):
    return S.merge_boxes(_boxes(spark, d, 0).withColumnRenamed("image", "frame"))


_EDGES = "SELECT vec_id AS a, vec_id * 2 % (SELECT max(vec_id) + 1 FROM embeddings) AS b, (1.0 + vec_id % 7)::DOUBLE AS length FROM embeddings"


def _edges(spark, d):
    """The edges of every row, and the number of ids, which no path without a cycle exceeds."""
    i, rows = F.col("vec_id"), table(spark, d, "embeddings")
    n = rows.agg(F.coalesce(F.max(i), F.lit(0)) + 1).first()[0]
    return rows.select(i.alias("a"), (i * 2 % n).alias("b"), (1.0 + i % 7).cast("double").alias("length")), n


@query("r04_bidirectional", f"WITH e AS ({_EDGES}) SELECT a, b, length FROM e UNION ALL SELECT b, a, length FROM e")
def r04(spark, d):
    return graphs.both_ways(_edges(spark, d)[0])


@query("r05_snap_to_node", f"WITH p AS ({_P}) SELECT id FROM p ORDER BY sqrt(x * x + y * y + z * z), id LIMIT 1")
def r05(spark, d):
    return _cloud(spark, d).orderBy(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), "id").limit(1).select("id")


@query("r06_shortest_paths", f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT count(*) AS n FROM e), w AS (SELECT 1::BIGINT AS id, 0.0::DOUBLE AS distance, 0 AS hops UNION ALL SELECT b, distance + length, hops + 1 FROM w JOIN e ON a = id CROSS JOIN n WHERE hops < n)
SELECT id, min(distance) AS distance FROM w GROUP BY 1""")
def r06(spark, d):
    edges, n = _edges(spark, d)
    return searches.shortest_paths(edges, 1).select("id", "distance")


@query("r10_hop_seconds", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 45.0 WHEN 'O' THEN o_totalprice / 1000 / 0.5 ELSE o_totalprice / 1000 / 1.3 END AS seconds FROM orders")
def r10(spark, d):
    length = F.col("o_totalprice") / 1000
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 45.0).when(F.col("o_orderstatus") == "O", length / 0.5).otherwise(length / 1.3).alias("seconds"))


@query("r11_connection_usability", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'CLOSED' WHEN o_totalprice < 20000 THEN 'TOO_NARROW' WHEN o_orderpriority LIKE '5%' THEN 'NOT_STEP_FREE' END AS reason FROM orders")
def r11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "CLOSED").when(F.col("o_totalprice") < 20000, "TOO_NARROW").when(F.col("o_orderpriority").startswith("5"), "NOT_STEP_FREE").alias("reason"))


_FLOORS = "SELECT DISTINCT s_nationkey AS a, (s_nationkey * 3 + 1) % 25 AS b FROM supplier"


@query("r12_mutual_components", f"""WITH RECURSIVE e AS ({_FLOORS}), n AS (SELECT n_nationkey AS id FROM nation), r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1""")
def r12(spark, d):
    k = F.col("s_nationkey")
    e = table(spark, d, "supplier").select(k.alias("a"), ((k * 3 + 1) % 25).alias("b")).distinct()
    return graphs.mutual_components(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), e)


@query("r13_reachability", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT 3::BIGINT AS id UNION SELECT b FROM r JOIN e ON a = id) SELECT id FROM r")
def r13(spark, d):
    edges, n = _edges(spark, d)
    return searches.reachable(edges, spark.createDataFrame([(3,)], "id long"))


@query("r17_obstacle_admission", "SELECT event_id, CASE WHEN epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts) > 86400000000 THEN 'STALE' WHEN epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15') > 10000000 THEN 'FUTURE' WHEN event_type = 'view' THEN 'FRAME_MISMATCH' END AS reason FROM events")
def r17(spark, d):
    age = F.unix_micros(F.lit("2024-01-15").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.when(age > 86_400_000_000, "STALE").when(-age > 10_000_000, "FUTURE").when(F.col("event_type") == "view", "FRAME_MISMATCH").alias("reason"))


@query("r18_readiness_reason", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'NO_GRAPH' END, CASE WHEN c_nationkey > 20 THEN 'NO_SCALE' END, 'READY') AS reason FROM customer")
def r18(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") < 0, "NO_GRAPH"), F.when(F.col("c_nationkey") > 20, "NO_SCALE"), F.lit("READY")).alias("reason"))


@query("r19_connected_components", f"""WITH RECURSIVE p AS ({_P}), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND {_PAIR} <= 0.03), r AS (SELECT id AS a, id AS b FROM p UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS id, min(b) AS component FROM r GROUP BY 1""")
def r19(spark, d):
    p = _cloud(spark, d)
    edges = S.radius_pairs(p, p, 0.03).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return graphs.components(p.select("id"), edges)


@query("r20_floaters", f"""WITH RECURSIVE p AS ({_P}), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND {_PAIR} <= 0.04), r AS (SELECT id AS a, id AS b FROM p UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT id, size >= 5 AS keep FROM c JOIN s USING (component)""")
def r20(spark, d):
    return S.floaters(_cloud(spark, d), 0.04, 5).select("id", "keep")
