"""Visibility and the choice of views (C33, C36) over the cells of the cloud in the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import surfaces as S
from ..operators import visibility as V
from .clouds import _P, _cloud
from .registry import query

_SIZE, _NEAR, _FAR, _IDEAL = 0.05, 0.06, 0.3, 0.2
_GRID = f"SELECT floor(x / {_SIZE})::BIGINT AS i, floor(y / {_SIZE})::BIGINT AS j, count(*) % 4 = 3 AS blocked FROM ({_P}) GROUP BY 1, 2"
#: A line of sight walked cell by cell with an error term, as an independent check of the closed form.
_WALK = f"""WITH RECURSIVE grid AS MATERIALIZED ({_GRID}), views AS (SELECT id AS view, x, y, floor(x / {_SIZE})::BIGINT AS vi, floor(y / {_SIZE})::BIGINT AS vj FROM ({_P}) WHERE id % 25 = 0),
rays AS MATERIALIZED (SELECT view, vi, vj, i, j, sqrt(((i + 0.5) * {_SIZE} - x) ** 2 + ((j + 0.5) * {_SIZE} - y) ** 2) AS distance FROM views, grid WHERE NOT blocked AND (i <> vi OR j <> vj)),
near AS MATERIALIZED (SELECT *, abs(i - vi) AS dx, abs(j - vj) AS dy, sign(i - vi)::BIGINT AS sx, sign(j - vj)::BIGINT AS sy FROM rays WHERE distance BETWEEN {_NEAR} AND {_FAR}),
walk AS (SELECT view, i AS ti, j AS tj, dx, dy, sx, sy, vi AS x, vj AS y, dx - dy AS err, false AS hit FROM near
  UNION ALL SELECT view, ti, tj, dx, dy, sx, sy, x + a * sx, y + b * sy, err - a * dy + b * dx,
    (a = 1 AND b = 1 AND (x + sx, y) IN (SELECT (i, j) FROM grid WHERE blocked) AND (x, y + sy) IN (SELECT (i, j) FROM grid WHERE blocked)) OR ((x + a * sx <> ti OR y + b * sy <> tj) AND (x + a * sx, y + b * sy) IN (SELECT (i, j) FROM grid WHERE blocked))
  FROM (SELECT *, (2 * err > -dy)::INT AS a, (2 * err < dx)::INT AS b FROM walk WHERE NOT hit AND (x <> ti OR y <> tj)))
SELECT view, ti AS i, tj AS j, round(any_value(1 - abs(distance - {_IDEAL}) / {_IDEAL}), 8) AS weight, NOT bool_or(hit) AS clear FROM walk JOIN (SELECT view AS v, i, j, distance FROM near) n ON n.v = view AND n.i = ti AND n.j = tj GROUP BY view, ti, tj"""


def _cells(spark, d):
    n = F.count("*")
    return S.cells_of(_cloud(spark, d), _SIZE).groupBy("i", "j").agg((n % 4 != 3).alias("target"), (n % 4 == 3).alias("blocked")).withColumn("scene", F.lit(0))


def _seen(spark, d, every, rest=0):
    views = _cloud(spark, d).where(F.col("id") % every == rest).select(F.lit(0).alias("scene"), F.col("id").alias("view"), "x", "y")
    return views, V.observations(views, _cells(spark, d), _SIZE, _NEAR, _FAR, _IDEAL)


@query("c33_line_of_sight", _WALK)
def c33(spark, d):
    return _seen(spark, d, 25)[1].select("view", "i", "j", F.round("weight", 8).alias("weight"), "clear")


@query("c36_chosen_views")
def c36(spark, d):
    def own(seen):
        return seen.where("clear AND weight >= 0.1").select("view", S.cell_id(F.col("i"), F.col("j")).alias("cell"), "weight", F.degrees("back").alias("bearing"))

    views, seen = _seen(spark, d, 10)
    targets = _cells(spark, d).where("target").select(S.cell_id(F.col("i"), F.col("j")).alias("cell"), F.lit(1.0).alias("importance"))
    picks, _ = V.choose_views(own(seen), views, targets, 6, 2.0, 120.0, (0.0, 0.0), 0.2, penalty=0.3, known=own(_seen(spark, d, 50, 5)[1]))
    return spark.createDataFrame([(n + 1, *p) for n, p in enumerate(picks)], "rank int, view long, x double, y double, gain double, score double, covered double")
