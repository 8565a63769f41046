"""The walkable surface (C25) and routing graphs of polygons (R25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import walkable as W
from ..sources.tables import table
from .clouds import _P, _cloud
from .registry import query

_SIZE, _BAND, _CLIMB, _HIGH, _STEP = 0.05, 0.15, 0.12, 0.5, 0.03
_G = "(z BETWEEN -0.5 AND 0.5)"


@query("c25_surface_model", f"""WITH p AS (SELECT id, label % 3 AS part, floor(x / {_SIZE})::BIGINT AS i, floor(y / {_SIZE})::BIGINT AS j, z FROM ({_P})),
g AS (SELECT part, i, j, z, lead(z, 1) OVER (PARTITION BY part, i, j ORDER BY z) AS top FROM p WHERE id % 4 <> 0 AND {_G}),
f AS (SELECT part, i, j, min(z) FILTER (top <= z + {_BAND}) AS low FROM g GROUP BY ALL),
ground AS MATERIALIZED (SELECT part, i, j, median(z) AS ground FROM g JOIN f USING (part, i, j) WHERE z BETWEEN low AND low + {_BAND} GROUP BY ALL),
o AS (SELECT part, i, j, z, z - coalesce((SELECT ground FROM ground n WHERE n.part = p.part AND n.i = p.i AND n.j = p.j), (SELECT min(ground) FROM ground n WHERE n.part = p.part AND abs(n.i - p.i) <= 1 AND abs(n.j - p.j) <= 1), 0) AS over FROM p WHERE id % 4 = 0 AND z BETWEEN -0.5 AND 1.0),
tops AS (SELECT part, i, j, max(z) FILTER (over > {_CLIMB} AND over < {_HIGH}) AS top FROM o GROUP BY ALL),
c AS MATERIALIZED (SELECT part, i, j, ground, top, top IS NOT NULL AS obstacle, ground IS NOT NULL AND top IS NULL AS free,
  EXISTS (SELECT 1 FROM ground n WHERE n.part = part_ AND abs(n.i - i_) + abs(n.j - j_) = 1 AND abs(n.ground - g_) > {_STEP} AND abs(n.ground - g_) <= {_CLIMB}) AS level_change
  FROM (SELECT *, part AS part_, i AS i_, j AS j_, ground AS g_ FROM ground FULL JOIN tops USING (part, i, j))),
shut AS MATERIALIZED (SELECT DISTINCT part, i + a AS i, j + b AS j FROM c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) AS m(a, b) WHERE free AND NOT EXISTS (SELECT 1 FROM c f WHERE f.free AND f.part = c.part AND f.i = c.i + a AND f.j = c.j + b)),
d AS (SELECT c.part, c.i, c.j, min(sqrt((c.i - s.i) ** 2 + (c.j - s.j) ** 2)) * {_SIZE} AS clear FROM c JOIN shut s USING (part) WHERE free GROUP BY ALL),
e AS (SELECT c.*, coalesce(clear, 0) AS clear, CASE WHEN free THEN least(greatest(2 * clear - {_SIZE}, 0), 0.4) ELSE 0 END AS width FROM c LEFT JOIN d USING (part, i, j))
SELECT part, i, j, round(ground, 8) AS ground, obstacle, round(top, 8) AS top, free, level_change, round(clear, 8) AS clear, round(width, 8) AS width, free AND NOT level_change AND width < 0.1 AS narrow FROM e""")
def c25(spark, d):
    p = _cloud(spark, d).select("id", (F.col("label") % 3).alias("part"), "x", "y", "z")
    cells = W.surface_model(p.where("id % 4 <> 0"), p.where("id % 4 = 0"), reference=0.0, size=_SIZE, least=2, band=_BAND, climb=_CLIMB, height=_HIGH, step=_STEP, above=0.5, accessible=0.1, cap=0.4)
    return cells.select("part", "i", "j", *[F.round(c, 8).alias(c) for c in ("ground",)], "obstacle", F.round("top", 8).alias("top"), "free", "level_change", F.round("clear", 8).alias("clear"), F.round("width", 8).alias("width"), "narrow")


_ROOM = "c_custkey // 60 AS part, c_custkey AS polygon, ((c_custkey % 60) % 10) * 2.0 AS x0, ((c_custkey % 60) // 10) * 3.0 AS y0, (c_custkey % 7) * 0.1 AS z0, c_custkey % 11 = 0 AS level_change"


@query("r25_routing_graph", f"""WITH p AS (SELECT {_ROOM} FROM customer), e AS (SELECT a.part, a.polygon AS a, b.polygon AS b, b.x0 - a.x0 AS dx, b.y0 - a.y0 AS dy, b.z0 - a.z0 AS dz, a.level_change OR b.level_change AS level_change FROM p a JOIN p b ON a.part = b.part AND a.polygon < b.polygon AND abs(a.x0 - b.x0) / 2 + abs(a.y0 - b.y0) / 3 = 1 AND abs(a.z0 - b.z0) <= 0.35)
SELECT part, a, b, round(sqrt(dx * dx + dy * dy + dz * dz), 8) AS length, round(dz, 8) AS rise, round(degrees(atan2(abs(dz), sqrt(dx * dx + dy * dy))), 6) AS slope, level_change, degrees(atan2(abs(dz), sqrt(dx * dx + dy * dy))) <= 4.8 AND NOT level_change AS step_free, CASE WHEN dx <> 0 THEN 3.0 ELSE 2.0 END::DOUBLE AS width FROM e""")
def r25(spark, d):
    """Customers are level rectangles of 2 by 3 in rows of ten, sixty to a floor."""
    k = F.col("c_custkey")
    at = k % 60
    x, y, z = (at % 10) * 2.0, F.floor(at / 10) * 3.0, (k % 7) * 0.1
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"), z.alias("z"))
    ring = F.array(corner(0, 0), corner(2, 0), corner(2, 3), corner(0, 3))
    keys = table(spark, d, "customer").select("c_custkey").repartition("c_custkey")  # one task reads a small file, and a key of it becomes dozens of rows
    polygons = keys.select(F.floor(k / 60).alias("part"), k.alias("polygon"), ring.alias("ring"), (k % 11 == 0).alias("level_change"))
    _, edges = W.routing_graph(polygons, climb=0.35, ramp=4.8)
    return edges.select("part", "a", "b", F.round("length", 8).alias("length"), F.round("rise", 8).alias("rise"), F.round("slope", 6).alias("slope"), "level_change", "step_free", F.round("width", 8).alias("width"))
