"""Placement of clouds and rooms (C15, C16, R24). Oracles are the planted truth: the rows as they were before they were moved."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import registration as R
from ..operators import surfaces as S
from ..sources.tables import table
from .clouds import _P, _cloud
from .registry import query
from .surfaces import _ROOMS, _rooms

_TURN = R.rotations(np.array([0.02, -0.03, 0.04]))
_MOVE = np.array([0.03, -0.02, 0.01])


@query("c16_icp", f"SELECT id, round(4 * x, 6) AS x, round(4 * y, 6) AS y, round(4 * z, 6) AS z FROM ({_P})")
def c16(spark, d):
    """A copy of the cloud, turned, scaled and moved, comes back point by point; no pair is told."""
    whole = _cloud(spark, d).withColumns({a: F.col(a) * 4 for a in S.AXES})
    away = S._moved(whole, 1.01, _TURN, _MOVE)
    scale, rotation, move = S.align_clouds(away, whole, [0.6, 0.3, 0.15], rounds=30)
    return S._moved(away, scale, rotation, move).select("id", *[F.round(a, 6).alias(a) for a in S.AXES])


def _putative(spark, d):
    """The cloud and where it stands after a turn; three of five correspondences are wrong."""
    whole = _cloud(spark, d).select("id", *[(F.col(a) * 4).alias(a) for a in S.AXES])
    there = S._moved(whole, 1.03, R.rotations(np.array([0.5, -0.2, 1.1])), np.array([1.0, 2.0, -0.5])).toDF("id", "u", "v", "w")
    right = F.col("id") % 5 < 2
    return whole.join(there, "id").withColumns({"u": F.when(right, F.col("u")).otherwise(F.col("y") * 2 + 1), "v": F.when(right, F.col("v")).otherwise(F.col("z") - 1), "w": F.when(right, F.col("w")).otherwise(-F.col("x"))})


@query("c15_robust_similarity", f"SELECT id, id % 5 < 2 AS agrees FROM ({_P})")
def c15(spark, d):
    pairs = _putative(spark, d)
    scale, rotation, move, _, _ = R.robust_similarity(pairs, 0.001, (0.9, 1.1))
    placed = S._moved(pairs, scale, rotation, move)
    return placed.select("id", (F.sqrt(sum(((F.col(a) - F.col(b)) ** 2 for a, b in zip(R.AXES, R.TARGETS, strict=True)), F.lit(0.0))) < 0.001).alias("agrees"))


@query("c15_yaw_hypotheses", "SELECT * FROM (VALUES (1, 0.7::DOUBLE, 1.0::DOUBLE), (2, -1.9::DOUBLE, -2.0::DOUBLE)) AS t(rank, yaw, x)")
def c15_yaw(spark, d):
    """Half of the correspondences follow one turn about the vertical, a quarter another, the rest none."""
    whole = _cloud(spark, d).select("id", *[(F.col(a) * 4).alias(a) for a in S.AXES])
    kind = F.col("id") % 4
    moved = [S._moved(whole, 1.0, R._yawed(np.array(yaw)), np.array(t)).select("id", *[F.col(a).alias(f"{a}{n}") for a in S.AXES]) for n, yaw, t in ((1, 0.7, [1.0, 0.5, 0.1]), (2, -1.9, [-2.0, 1.0, 0.0]))]
    pairs = whole.join(moved[0], "id").join(moved[1], "id")
    pairs = pairs.select("id", *S.AXES, *[F.when(kind < 2, F.col(f"{a}1")).when(kind == 2, F.col(f"{a}2")).otherwise(F.col(f"{a}1") * 2 + F.col(f"{a}2")).alias(b) for a, b in zip(S.AXES, R.TARGETS, strict=True)])
    found = R.yaw_hypotheses(pairs, 0.01, most=2, support=50)
    return spark.createDataFrame([(n + 1, round(yaw, 5), round(float(t[0]), 5)) for n, (yaw, t, _) in enumerate(found)], "rank int, yaw double, x double")


@query("c16_plane_alignment", f"SELECT id, id % 3 AS wall, 0.0::DOUBLE AS off FROM ({_P}) WHERE id % 7 = 0")
def c16_planes(spark, d):
    """The cloud pressed onto three walls; a seventh of it, turned and moved, is brought back onto them: what is left off its wall."""
    wall = F.col("id") % 3
    flat = _cloud(spark, d).select("id", *[F.when(wall == i, 0.0).otherwise(F.abs(F.col(a)) * 8 + 0.5).alias(a) for i, a in enumerate(S.AXES)])
    normals = flat.select("id", *[F.when(wall == i, 1.0).otherwise(0.0).alias(f"n{a}") for i, a in enumerate(S.AXES)])
    away = S._moved(flat.where("id % 7 = 0"), 1.0, _TURN, _MOVE)
    rotation, move, _ = R.align_to_planes(away, flat, normals, [0.8, 0.4], rounds=6)
    back = S._moved(away, 1.0, rotation, move)
    return back.select("id", wall.alias("wall"), F.abs(F.round(F.when(wall == 0, F.col("x")).when(wall == 1, F.col("y")).otherwise(F.col("z")), 3)).alias("off"))


@query("r24_pose_graph", f"SELECT building, room, round(x, 5) AS x, round(y, 5) AS y, round(room % 5 * 0.1, 5) AS yaw FROM ({_ROOMS}) WHERE building > 0")
def r24(spark, d):
    """Rooms of a building by their doors: the measurements are right, the poses to start from drift."""
    rooms, doors = (x.where("building > 0") for x in _rooms(spark, d))
    placed = rooms.withColumn("yaw", F.col("room") % 5 * 0.1)
    pose = lambda yaw, x, y: F.array(F.cos(yaw), -F.sin(yaw), F.lit(0.0), F.sin(yaw), F.cos(yaw), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), x, y, F.lit(0.0))
    off = F.when(F.col("fixed"), 0.0).otherwise((F.col("room") * 7 % 11 - 5) * 0.02)
    start = placed.select("building", "room", "fixed", pose(F.col("yaw") + off, F.col("x") + off * 3, F.col("y") - off * 2).alias("pose"), F.array(F.lit(0.5), F.lit(0.2), F.lit(1.0)).alias("centre"), F.lit(2.0).alias("extent"))
    end = lambda s: placed.select("building", F.col("room").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("x", "y", "yaw")])
    both = doors.select("building", "a", "b").distinct().join(end("a"), ["building", "a"]).join(end("b"), ["building", "b"])
    dx, dy, t = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"), F.col("b_yaw")
    edges = both.select("building", F.col("a").alias("source"), F.col("b").alias("target"), pose(F.col("a_yaw") - t, F.cos(t) * dx + F.sin(t) * dy, F.cos(t) * dy - F.sin(t) * dx).alias("measured"), F.lit(1.0).alias("weight"))
    found, _ = R.optimize_poses(start, edges, level=True, tolerance=1e-7)
    return found.select("building", "room", F.round(F.col("pose")[9], 5).alias("x"), F.round(F.col("pose")[10], 5).alias("y"), F.round(F.atan2(F.col("pose")[3], F.col("pose")[0]), 5).alias("yaw"))
