"""Detections in space (C29): the cloud seen along z, with boxes around every tenth point."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.localisation import localise
from .clouds import _P, _cloud
from .registry import query

_B, _S, _MIN, _COV = 0.02, 0.05, 3, 0.4
_BAND = f"({_B} + {_S} * {{0}})"


@query("c29_depth_layers", f"""WITH p AS (SELECT label % 3 AS frame, id, (x + 1) * 400 AS px, (y + 1) * 400 AS py, z + 2 AS depth, x, y, z FROM ({_P}) WHERE id % 11 <> 0),
b AS (SELECT label % 3 AS frame, id AS box, (x + 1) * 400 - 40 AS x0, (y + 1) * 400 - 30 AS y0, (x + 1) * 400 + 40 AS x1, (y + 1) * 400 + 30 AS y1 FROM ({_P}) WHERE id % 10 = 0),
f AS (SELECT *, floor(px / 16) AS cu, floor(py / 16) AS cv, min(depth) OVER (PARTITION BY frame, floor(px / 16), floor(py / 16)) AS nearest FROM p),
h AS MATERIALIZED (SELECT b.frame, box, f.id, cu, cv, depth, x, y, z, depth <= nearest + {_BAND.format('nearest')} AS front FROM b JOIN f ON f.frame = b.frame AND px >= x0 AND px < x1 AND py >= y0 AND py < y1),
t AS (SELECT frame, box, count(*) FILTER (NOT front) AS hidden, count(DISTINCT (cu, cv)) FILTER (front) AS occupied FROM h GROUP BY ALL),
g AS (SELECT *, coalesce((depth - lag(depth) OVER w > {_BAND.format('lag(depth) OVER w')})::INT, 0) AS apart FROM h WHERE front WINDOW w AS (PARTITION BY frame, box ORDER BY depth, id)),
l AS MATERIALIZED (SELECT *, sum(apart) OVER (PARTITION BY frame, box ORDER BY depth, id ROWS UNBOUNDED PRECEDING) AS layer FROM g),
s AS (SELECT frame, box, layer, count(*) AS points, count(DISTINCT (cu, cv)) / any_value(occupied) AS coverage, median(depth) AS depth, median(x) AS x, median(y) AS y, median(z) AS z FROM l JOIN t USING (frame, box) GROUP BY ALL HAVING count(*) >= {_MIN}),
n AS (SELECT frame, box, count(*) AS layers FROM s GROUP BY ALL), c AS (SELECT * FROM s WHERE coverage >= {_COV} QUALIFY row_number() OVER (PARTITION BY frame, box ORDER BY layer) = 1),
d AS (SELECT l.frame, l.box, 1.4826 * median(abs(l.depth - c.depth)) AS spread FROM l JOIN c USING (frame, box, layer) GROUP BY ALL)
SELECT frame, box, CASE WHEN hidden IS NULL THEN 'NO_DEPTH' WHEN layers IS NULL THEN 'INSUFFICIENT_DEPTH' WHEN c.layer IS NULL THEN 'AMBIGUOUS_DEPTH' END AS reason, round(x, 8) AS x, round(y, 8) AS y, round(z, 8) AS z, points, round(c.depth, 8) AS depth, round(spread, 8) AS spread, round(coverage, 8) AS coverage, coalesce(layers, 0) AS layers, coalesce(hidden, 0) AS hidden
FROM b LEFT JOIN t USING (frame, box) LEFT JOIN n USING (frame, box) LEFT JOIN c USING (frame, box) LEFT JOIN d USING (frame, box)""")
def c29(spark, d):
    p = _cloud(spark, d).withColumns({"frame": F.col("label") % 3, "px": (F.col("x") + 1) * 400, "py": (F.col("y") + 1) * 400})
    points = p.select("frame", "id", "px", "py", (F.col("z") + 2).alias("depth"), (F.col("id") % 11 != 0).alias("visible"), "x", "y", "z")
    boxes = p.where("id % 10 = 0").select("frame", F.col("id").alias("box"), (F.col("px") - 40).alias("x0"), (F.col("py") - 30).alias("y0"), (F.col("px") + 40).alias("x1"), (F.col("py") + 30).alias("y1"))
    found = localise(points, boxes, band=_B, share=_S, support=_MIN, coverage=_COV)
    return found.select("frame", "box", "reason", *[F.round(c, 8).alias(c) for c in "xyz"], "points", F.round("depth", 8).alias("depth"), F.round("spread", 8).alias("spread"), F.round("coverage", 8).alias("coverage"), "layers", "hidden")
