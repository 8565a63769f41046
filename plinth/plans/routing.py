"""Routes (R01 to R03, R07 to R09, R14 to R16). A nation is a building, its customers are the nodes of a corridor in the order of their keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import routing as R
from ..operators import searches
from ..sources.tables import table
from .registry import query

_N = "SELECT c_nationkey AS graph, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, (c_custkey * 7 % 10)::DOUBLE AS y, lead(c_custkey) OVER w AS next, lead(c_custkey, 2) OVER w AS after, lead((c_custkey * 7 % 10)::DOUBLE) OVER w AS y1, lag((c_custkey * 7 % 10)::DOUBLE) OVER w AS y0 FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)"


def _nodes(spark, d):
    w, k = Window.partitionBy("c_nationkey").orderBy("c_custkey"), F.col("c_custkey")
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("graph"), k.alias("id"), F.row_number().over(w).cast("double").alias("x"), (k * 7 % 10).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(0).alias("floor"), F.lead(k).over(w).alias("next"), F.lead(k, 2).over(w).alias("after"))


def _edges(nodes):
    return nodes.select("graph", F.col("id").alias("a"), F.explode(F.array("next", "after")).alias("b")).where("b IS NOT NULL")


@query("r01_graph_bounds", f"SELECT graph, count(*) AS nodes, min(r)::DOUBLE AS min_x, max(r)::DOUBLE AS max_x, min(y) AS min_y, max(y) AS max_y, 0.0::DOUBLE AS min_z, 0.0::DOUBLE AS max_z, count(next) + count(after) AS edges FROM ({_N}) GROUP BY 1")
def r01(spark, d):
    n = _nodes(spark, d)
    return R.graph_bounds(n, _edges(n))


_CROSS = "greatest(0, (3.5 - xa) / (xb - xa), CASE WHEN ya <> yb THEN least((2.5 - ya) / (yb - ya), (6.5 - ya) / (yb - ya)) ELSE 0 END) <= least(1, (6.5 - xa) / (xb - xa), CASE WHEN ya <> yb THEN greatest((2.5 - ya) / (yb - ya), (6.5 - ya) / (yb - ya)) WHEN ya BETWEEN 2.5 AND 6.5 THEN 1 ELSE -1 END)"


@query("r02_obstacle_exclusion", f"""WITH n AS ({_N}), e AS (SELECT graph, id AS a, next AS b, r AS xa, r + 1 AS xb, y AS ya, y1 AS yb FROM n WHERE next IS NOT NULL UNION ALL SELECT n.graph, n.id, n.after, n.r, n.r + 2, n.y, m.y FROM n JOIN n m ON m.id = n.after)
SELECT graph, 'node' AS kind, id AS a, NULL::BIGINT AS b FROM n WHERE NOT (r BETWEEN 3.5 AND 6.5 AND y BETWEEN 2.5 AND 6.5) UNION ALL SELECT graph, 'edge', a, b FROM e WHERE NOT ({_CROSS})""")
def r02(spark, d):
    n = _nodes(spark, d)
    box = F.struct(F.lit(3.5).alias("min_x"), F.lit(2.5).alias("min_y"), F.lit(6.5).alias("max_x"), F.lit(6.5).alias("max_y"))
    nodes, edges = R.clear_of_boxes(n, _edges(n), n.select("graph").distinct().withColumn("box", box))
    return nodes.select("graph", F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(edges.select("graph", F.lit("edge").alias("kind"), "a", "b"))


@query("r03_portal_openings", """WITH p AS (SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS length FROM part), b AS (SELECT id, length, (id % 7) * 0.2::DOUBLE AS lo, (id % 7) * 0.2::DOUBLE + 0.3 AS hi FROM p UNION ALL SELECT id, length, 1 + (id % 5) * 0.4::DOUBLE, 1.5 + (id % 5) * 0.4::DOUBLE FROM p),
c AS (SELECT id, greatest(0, (lo - 0.35) / length) AS s, least(1, (hi + 0.35) / length) AS e FROM b), m AS (SELECT * FROM c WHERE s <= e UNION ALL SELECT id, 1, 1 FROM p),
g AS (SELECT id, greatest(0, s - coalesce(max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gap FROM m)
SELECT id, round(max(gap) * any_value(length), 8) AS widest, round(max(gap) * any_value(length), 8) > 0 AS passes FROM g JOIN p USING (id) GROUP BY 1""")
def r03(spark, d):
    k = F.col("p_partkey")
    portals = table(spark, d, "part").select(k.alias("id"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), (F.col("p_size") / 10).alias("bx"), F.lit(0.0).alias("by"))
    low = F.explode(F.array(F.struct(((k % 7) * 0.2).alias("lo"), ((k % 7) * 0.2 + 0.3).alias("hi")), F.struct((1 + (k % 5) * 0.4).alias("lo"), (1.5 + (k % 5) * 0.4).alias("hi"))))
    boxes = table(spark, d, "part").select(k.alias("id"), low.alias("b")).select("id", F.col("b.lo").alias("min_x"), F.lit(-0.1).alias("min_y"), F.col("b.hi").alias("max_x"), F.lit(0.1).alias("max_y"))
    found = R.portal_openings(portals, boxes, 0.35)
    return found.select("id", F.round("widest", 8).alias("widest"), (F.round("widest", 8) > 0).alias("passes"))


@query("r07_path_reconstruction", f"""WITH RECURSIVE n AS ({_N}), p AS (SELECT graph, id, r, next, y0, y, y1, 0.0::DOUBLE AS d1, 'inf'::DOUBLE AS d0 FROM n WHERE r = 1
UNION ALL SELECT n.graph, n.id, n.r, n.next, n.y0, n.y, n.y1, least(p.d1 + sqrt(1 + (n.y - p.y) ** 2), coalesce(p.d0 + sqrt(4 + (n.y - p.y0) ** 2), 'inf')), p.d1 FROM p JOIN n ON n.id = p.next)
SELECT graph, id AS target, round(d1, 6) AS cost, true AS whole FROM p""")
def r07(spark, d):
    n = _nodes(spark, d)
    edges = R.placed_edges(n, _edges(n)).select("graph", "a", "b", "length")
    first = n.where("x = 1").select("graph", F.col("id").alias("source"))
    found = searches.searches(edges, first.select(F.col("graph").alias("search"), "graph", F.col("source").alias("id")))
    # a path is whole if every node's cost is its predecessor's and the edge between them, down to the source
    before = found.select("search", F.col("id").alias("previous"), F.col("distance").alias("there"))
    steps = found.join(before, ["search", "previous"], "left").join(edges.groupBy("graph", F.col("a").alias("previous"), F.col("b").alias("id")).agg(F.min("length").alias("length")), ["graph", "previous", "id"], "left").join(first, "graph")
    whole = F.when(F.col("previous").isNull(), (F.col("id") == F.col("source")) & (F.col("distance") == 0)).otherwise(F.coalesce(F.abs(F.col("there") + F.col("length") - F.col("distance")) < 1e-9, F.lit(False)))
    return steps.select("graph", F.col("id").alias("target"), F.round("distance", 6).alias("cost"), whole.alias("whole"))


def _corridors(spark, d):
    n, k = _nodes(spark, d), F.col("id")
    half = F.when((F.col("x") == 1) | F.col("next").isNull(), 0.0).otherwise(0.5 + k % 3)
    return n.select(F.col("graph").alias("route"), F.col("x").alias("at"), (F.col("x") * 2).alias("lx"), (F.col("y") + half).alias("ly"), (F.col("x") * 2).alias("rx"), (F.col("y") - half).alias("ry"))


@query("r08_taut_paths")
def r08(spark, d):
    c = _corridors(spark, d)
    tight = R.pull_tight(c).select("route", F.col("length").alias("tight"), F.size("path").alias("corners"))
    return tight.join(R.midpoints(c).select("route", F.col("length").alias("middle")), "route").select("route", F.round("tight", 6).alias("tight"), F.round("middle", 6).alias("middle"), "corners")


def _building(spark, d):
    """Two floors: node 2k and 2k + 1 of customer k; lifts and stairs at some. Requests from the first of the lower to the last of the upper floor."""
    n, k = _nodes(spark, d), F.col("id")
    both = n.select("graph", F.explode(F.array(*[F.struct((k * 2 + f).alias("id"), "x", "y", F.lit(4.0 * f).alias("z"), F.lit(f).alias("floor")) for f in (0, 1)])).alias("n")).select("graph", "n.*")
    way = lambda f: F.struct((k * 2 + f).alias("a"), (F.col("next") * 2 + f).alias("b"), ((1 + k % 3) if f == 0 else (2 + k % 5)).cast("double").alias("length"))
    walks = n.where("next IS NOT NULL").select("graph", F.explode(F.array(way(0), way(1))).alias("e")).select("graph", "e.*")
    hops = n.where("id % 4 < 2").select("graph", (k * 2).alias("a"), (k * 2 + 1).alias("b"), F.lit(4.0).alias("length"), F.when(k % 4 == 0, "ELEVATOR").otherwise("STAIRS").alias("kind"))
    asked = n.groupBy("graph").agg((F.min("id") * 2).alias("source"), (F.max("id") * 2 + 1).alias("target")).withColumn("request", F.col("graph"))
    return both, R.building_edges(walks, hops, R.WALKING), asked


_HOPS = f"""WITH n AS ({_N}), s AS (SELECT graph, id, coalesce(sum(1 + id % 3) OVER (PARTITION BY graph ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, coalesce(sum(CASE WHEN next IS NOT NULL THEN 2 + id % 5 ELSE 0 END) OVER (PARTITION BY graph ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS above FROM n),
h AS (SELECT graph, (below + above)::DOUBLE AS walked, CASE WHEN id % 4 = 0 THEN 45.0 ELSE 8.0 END AS hop FROM s WHERE id % 4 < 2), b AS (SELECT graph, min(struct_pack(seconds := round(walked / 1.3 + hop, 6), distance := walked + 4)) AS best FROM h GROUP BY 1)"""


@query("r09_multi_floor_search", f"{_HOPS} SELECT DISTINCT n.graph, best.seconds AS seconds FROM n LEFT JOIN b USING (graph)")
def r09(spark, d):
    _, edges, asked = _building(spark, d)
    return R.routes(asked, edges, "seconds").select("graph", F.round("cost", 6).alias("seconds"))


@query("r16_route_assembly", f"{_HOPS} SELECT graph AS request, round(best.distance, 6) AS distance, best.seconds AS seconds, 1 AS transitions, (SELECT count(*) FROM n WHERE n.graph = b.graph) + 1 AS points FROM b")
def r16(spark, d):
    nodes, edges, asked = _building(spark, d)
    points, total = R.assemble(R.routes(asked, edges, "seconds"), nodes, edges, R.WALKING)
    return total.join(points.groupBy("request").agg(F.count("*").alias("points")), "request").select("request", F.round("distance", 6).alias("distance"), F.round("seconds", 6).alias("seconds"), "transitions", "points")


_TOURS = 'SELECT c_custkey // 5 AS tour, c_custkey % 5 AS "at", c_custkey AS stop, c_acctbal AS v, c_nationkey AS w FROM customer'


def _tours(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.floor(k / 5).alias("tour"), (k % 5).alias("at"), k.alias("stop"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("w"))


def _pairs(tours):
    a, b = tours.select("tour", F.col("stop").alias("a"), F.col("v").alias("va"), F.col("w").alias("wa")), tours.select("tour", F.col("stop").alias("b"), F.col("v").alias("vb"), F.col("w").alias("wb"))
    return a.join(b, "tour").where("a <> b")  # a tour has five stops


_COST = "(abs({0}.v - {1}.v) + abs({0}.w - {1}.w))"


@query("r14_held_karp", f"""WITH t AS ({_TOURS}) SELECT a.tour, round(min({_COST.format("a", "b")} + {_COST.format("b", "c")} + {_COST.format("c", "d")} + {_COST.format("d", "e")}), 6) AS seconds, 5 AS stops FROM t a JOIN t b ON b.tour = a.tour AND b."at" > 0 JOIN t c ON c.tour = a.tour AND c."at" > 0 AND c."at" <> b."at"
JOIN t d ON d.tour = a.tour AND d."at" > 0 AND d."at" NOT IN (b."at", c."at") JOIN t e ON e.tour = a.tour AND e."at" > 0 AND e."at" NOT IN (b."at", c."at", d."at") WHERE a."at" = 0 GROUP BY 1""")
def r14(spark, d):
    t = _tours(spark, d)
    costs = _pairs(t).select("tour", "a", "b", (F.abs(F.col("va") - F.col("vb")) + F.abs(F.col("wa") - F.col("wb"))).alias("seconds"))
    return R.cheapest_orders(costs, t.where("at = 0").select("tour", F.col("stop").alias("start"))).select("tour", F.round("seconds", 6).alias("seconds"), F.size("stops").alias("stops"))


@query("r15_visit_in_order", f"""WITH t AS ({_TOURS}), l AS (SELECT *, last_value(CASE WHEN "at" = 0 OR v >= 0 THEN v END IGNORE NULLS) OVER (PARTITION BY tour ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS here FROM t)
SELECT tour, "at", stop, v >= 0 AS reached, CASE WHEN v >= 0 THEN round(abs(v - here), 6) END AS seconds, CASE WHEN v < 0 THEN 'NOT_STEP_FREE' END AS failure FROM l WHERE "at" > 0""")
def r15(spark, d):
    t = _tours(spark, d)
    costs = _pairs(t).select("tour", "a", "b", F.abs(F.col("va") - F.col("vb")).alias("seconds"), F.when(F.col("vb") < 0, "NOT_STEP_FREE").alias("failure"))
    return R.visit_in_order(t, costs).withColumn("seconds", F.round("seconds", 6))


@query("q15_nearest_by_route", """WITH p AS (SELECT p_partkey AS id, p_partkey AS rank, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS straight, CASE WHEN p_size % 3 = 0 THEN p_retailprice * 1.5 END AS walked FROM part),
o AS (SELECT id, CASE WHEN walked IS NOT NULL THEN 'ROUTE' WHEN straight IS NOT NULL THEN 'STRAIGHT_LINE' ELSE 'NOT_EVALUATED' END AS by, row_number() OVER (ORDER BY CASE WHEN walked IS NOT NULL THEN 0 WHEN straight IS NOT NULL THEN 1 ELSE 2 END, coalesce(walked, straight) NULLS LAST, rank, id) AS place FROM p) SELECT * FROM o WHERE place <= 20""")
def q15(spark, d):
    p = table(spark, d, "part")
    ranked = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("rank"), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("straight"))
    walked = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 1.5).alias("walked"))
    return R.nearest_by_route(ranked, walked, 20).select("id", "by", "place")


@query("c37_two_opt", f"""WITH t AS ({_TOURS}) SELECT tour, count(*) AS stops, true AS not_longer FROM t GROUP BY 1""")
def c37(spark, d):
    t = _tours(spark, d).select("tour", "at", "stop", F.col("v").alias("x"), F.col("w").cast("double").alias("y"))
    w = Window.partitionBy("tour").orderBy("at")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    before = t.withColumn("step", step).groupBy("tour").agg(F.sum("step").alias("before"))
    after = R.two_opt(t).groupBy("tour").agg(F.count_distinct("stop").alias("stops"), F.max("length").alias("length"))
    return after.join(before, "tour").select("tour", "stops", (F.col("length") <= F.col("before") + 1e-9).alias("not_longer"))
