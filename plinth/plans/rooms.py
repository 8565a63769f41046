"""Cells of rooms (C32) and widest ways between rooms (R21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rooms as R
from ..operators import surfaces as S
from ..sources.tables import table
from .clouds import _P, _cloud
from .registry import query

_CELLS = f"SELECT DISTINCT label % 3 AS part, floor(x / 0.05)::BIGINT AS i, floor(y / 0.05)::BIGINT AS j FROM ({_P}) WHERE id % 5 <> 0"


def _occupied(spark, d, rest):
    p = _cloud(spark, d).where(rest).withColumn("part", F.col("label") % 3)
    return S.cells_of(p, 0.05).select("part", "i", "j").distinct()


@query("c32_holes", f"""WITH RECURSIVE c AS MATERIALIZED ({_CELLS}), b AS (SELECT part, min(i) - 1 AS i0, max(i) + 1 AS i1, min(j) - 1 AS j0, max(j) + 1 AS j1 FROM c GROUP BY 1),
g AS MATERIALIZED (SELECT part, i, unnest(range(j0, j1 + 1)) AS j FROM (SELECT part, unnest(range(i0, i1 + 1)) AS i, j0, j1 FROM b)), e AS MATERIALIZED (SELECT * FROM g WHERE (part, i, j) NOT IN (SELECT (part, i, j) FROM c)),
o AS (SELECT part, i0 AS i, j0 AS j FROM b UNION SELECT e.part, e.i, e.j FROM o JOIN e ON e.part = o.part AND abs(e.i - o.i) + abs(e.j - o.j) = 1) SELECT part, i, j FROM e WHERE (part, i, j) NOT IN (SELECT (part, i, j) FROM o)""")
def c32_holes(spark, d):
    return R.holes(_occupied(spark, d, "id % 5 <> 0"))


@query("c32_frontier", f"""WITH f AS ({_CELLS}), k AS (SELECT * FROM f UNION SELECT DISTINCT label % 3, floor(x / 0.05)::BIGINT, floor(y / 0.05)::BIGINT FROM ({_P}) WHERE id % 5 = 0)
SELECT part, i, j FROM f WHERE EXISTS (SELECT 1 FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS m(a, b) WHERE (f.part, f.i + a, f.j + b) NOT IN (SELECT (part, i, j) FROM k))""")
def c32_frontier(spark, d):
    return R.frontier(_occupied(spark, d, "id % 5 <> 0"), _occupied(spark, d, "id % 5 = 0"))


@query("c32_outline_area", f"SELECT part, round(count(*) * 0.0025, 8) AS area FROM ({_CELLS}) GROUP BY 1")
def c32_outline(spark, d):
    """The rings of a part, holes taken off, hold the area of its cells."""
    return R.outlines(_occupied(spark, d, "id % 5 <> 0"), 0.05, 0.06).groupBy("part").agg(F.round(F.sum("area"), 8).alias("area"))


_E = "SELECT c_custkey // 60 AS part, c_custkey AS a, unnest([c_custkey + 1, c_custkey + 7]) AS b, 0.5 + (c_custkey * 7 % 13) * 0.1 AS w FROM customer"


@query("r21_widest_ways", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT part, a, b, w FROM ({_E}) WHERE a // 60 = b // 60 AND b IN (SELECT c_custkey FROM customer) UNION ALL SELECT part, b, a, w FROM ({_E}) WHERE a // 60 = b // 60 AND b IN (SELECT c_custkey FROM customer)),
s AS (SELECT c_custkey AS room FROM customer WHERE c_custkey % 10 = 0), w(room, node, width) USING KEY (room, node) AS (SELECT room, room, 'inf'::DOUBLE FROM s
UNION SELECT w.room, e.b, max(least(w.width, e.w)) FROM w JOIN e ON e.a = w.node LEFT JOIN recurring.w r ON r.room = w.room AND r.node = e.b WHERE r.width IS NULL OR least(w.width, e.w) > r.width GROUP BY w.room, e.b)
SELECT room // 60 AS part, room, node AS other, round(width, 6) AS width FROM w WHERE node IN (SELECT room FROM s) AND room < node""")
def r21(spark, d):
    """Customers are cells of floors of sixty, every tenth a room's middle."""
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select(F.floor(k / 60).alias("part"), k.alias("a"))
    edges = own.select("part", "a", F.explode(F.array(F.col("a") + 1, F.col("a") + 7)).alias("b"), (0.5 + F.col("a") * 7 % 13 * 0.1).alias("width"))
    edges = edges.join(own.select("part", F.col("a").alias("b")), ["part", "b"], "left_semi")
    seeds = own.where("a % 10 = 0").select("part", F.col("a").alias("room"), F.col("a").alias("node"))
    return R.widest_ways(edges, seeds).withColumn("width", F.round("width", 6))
