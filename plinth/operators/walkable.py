"""From cleaned points to where one can walk: the surface of a floor in cells, and the routing graph of walkable polygons.

Every table carries `part`, the floor or building it belongs to; parts never meet.
"""

from __future__ import annotations

from math import pi

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graphs
from .spatial import placeable

#: Rows of cells that one group of the distance transform holds.
STRIPE = 64
#: Depth below the reference height at which ground is still looked for (fixed value).
BELOW = 0.5
#: Directions that half a turn is cut into, and the part of a strip by which strips are moved, so that sides at round numbers do not lie between two.
TURNS, SHIFT = 16, 0.37


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def _moves(places: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in places])).alias("m")


def ground_heights(points: DataFrame, size: float, least: int, band: float) -> DataFrame:
    """(part, i, j, ground): per cell the median height of its lowest points that lie, `least` of them or more, within `band`; a stray point below does not count. Cells without such points are holes."""
    cell = Window.partitionBy("part", "i", "j")
    low = points.select("part", _cell("x", size).alias("i"), _cell("y", size).alias("j"), "z").withColumn("top", F.lead("z", least - 1).over(cell.orderBy("z")))
    low = low.withColumn("from", F.min(F.when(F.col("top") <= F.col("z") + band, F.col("z"))).over(cell))
    return low.where(F.col("z").between(F.col("from"), F.col("from") + band)).groupBy("part", "i", "j").agg(F.percentile("z", 0.5).alias("ground"))


def _envelope(at: list[int], height: list[int]) -> list[int]:
    """min over k of (at[i] - at[k]) ** 2 + height[k] for every i; at ascends. The parabolas that are lowest somewhere are kept in a stack, with where each begins to be."""
    kept: list[int] = []
    begins: list[float] = []
    for k, (x, h) in enumerate(zip(at, height, strict=True)):
        start = float("-inf")
        while kept:
            u = kept[-1]
            start = ((h + x * x) - (height[u] + at[u] * at[u])) / (2 * (x - at[u]))
            if start > begins[-1]:
                break
            kept.pop()
            begins.pop()
            start = float("-inf")
        kept.append(k)
        begins.append(start)
    out, now = [], 0
    for x in at:
        while now + 1 < len(kept) and begins[now + 1] <= x:
            now += 1
        out.append((x - at[kept[now]]) ** 2 + height[kept[now]])
    return out


def clearance(free: DataFrame) -> DataFrame:
    """(part, i, j, cells): for every free cell (part, i, j) the distance in cells, middle to middle, to the nearest cell that is not free. Exact.

    The nearest such cell always touches a free one by a side, so only those are looked at. First along i, by windows over each column; then along j: each row of cells is
    the lower envelope of its parabolas. Rows go to tasks in stripes, so a floor is spread over as many tasks as it has stripes."""
    free = free.select("part", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct()
    edge = free.select("part", "i", "j", _moves([(1, 0), (-1, 0), (0, 1), (0, -1)])).select("part", (F.col("i") + F.col("m.a")).alias("i"), (F.col("j") + F.col("m.b")).alias("j"))
    rows = free.withColumn("free", F.lit(True)).unionByName(edge.withColumn("free", F.lit(False))).groupBy("part", "i", "j").agg(F.max("free").alias("free"))
    column = Window.partitionBy("part", "j").orderBy("i")
    wall = F.when(~F.col("free"), F.col("i"))
    near = F.least(F.col("i") - F.last(wall, True).over(column), F.first(wall, True).over(column.rowsBetween(Window.currentRow, Window.unboundedFollowing)) - F.col("i"))
    rows = rows.withColumn("near", F.when(F.col("free"), near).otherwise(F.lit(0))).withColumn("stripe", F.floor(F.col("i") / STRIPE))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, row in pdf.sort_values(["i", "j"]).groupby("i"):
            row = row.assign(square=_envelope(row["j"].tolist(), (row["near"] ** 2).tolist()))
            found.append(row[row["free"]])
        out = pd.concat(found)
        return out.assign(cells=out["square"].astype(float) ** 0.5)[["part", "i", "j", "cells"]]

    return rows.groupBy("part", "stripe").applyInPandas(run, f"part {free.schema['part'].dataType.simpleString()}, i long, j long, cells double")


def surface_model(ground: DataFrame, obstacles: DataFrame, *, reference: float, size: float, least: int, band: float, climb: float, height: float, step: float, above: float, accessible: float, cap: float) -> DataFrame:
    """The cells of each part that hold ground or an obstacle: (part, i, j, ground, obstacle, top, free, level_change, clear, width, narrow).

    ground, obstacles: part, x, y, z; points without finite coordinates are left out. Ground is looked for from 0.5 below the reference height to `above` over it. An obstacle is a point between climb and height over its cell's
    ground, or, without ground there, over the lowest ground of the eight cells around, or else over the reference; top is the highest of them. level_change: the ground of a cell that shares a side is higher or lower by more than
    step and at most climb. Free cells have ground and no obstacle; clear is the distance to the nearest cell that is not free, width = 2 * clear - size, at most cap (0 where not free). narrow: free, no level change, width below accessible."""
    ground = placeable(ground).where(F.col("z").between(reference - BELOW, reference + above))
    obstacles = placeable(obstacles).where(F.col("z").between(reference - BELOW, reference + above + height))
    floor = graphs.materialize(ground_heights(ground, size, least, band))
    around = floor.select("part", "i", "j", "ground", _moves([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])).groupBy("part", (F.col("i") + F.col("m.a")).alias("i"), (F.col("j") + F.col("m.b")).alias("j"))
    under = around.agg(F.min("ground").alias("lowest"), F.max(F.when((F.col("m.a") == 0) & (F.col("m.b") == 0), F.col("ground"))).alias("own"))
    tall = obstacles.select("part", _cell("x", size).alias("i"), _cell("y", size).alias("j"), "z").join(under, ["part", "i", "j"], "left").withColumn("over", F.col("z") - F.coalesce("own", "lowest", F.lit(float(reference))))
    tops = tall.groupBy("part", "i", "j").agg(F.max(F.when((F.col("over") > climb) & (F.col("over") < height), F.col("z"))).alias("top"))
    sides = floor.select("part", "i", "j", F.col("ground").alias("next"), _moves([(1, 0), (-1, 0), (0, 1), (0, -1)])).select("part", (F.col("i") + F.col("m.a")).alias("i"), (F.col("j") + F.col("m.b")).alias("j"), "next")
    rise = F.abs(F.col("ground") - F.col("next"))
    steps = floor.join(sides, ["part", "i", "j"]).where((rise > step) & (rise <= climb)).select("part", "i", "j").distinct().withColumn("level_change", F.lit(True))
    cells = floor.join(tops, ["part", "i", "j"], "full").join(steps, ["part", "i", "j"], "left").withColumns({"obstacle": F.col("top").isNotNull(), "level_change": F.coalesce("level_change", F.lit(False))})
    cells = graphs.materialize(cells.withColumn("free", F.col("ground").isNotNull() & ~F.col("obstacle")))
    clear = clearance(cells.where("free")).select("part", "i", "j", (F.col("cells") * size).alias("clear"))
    cells = cells.join(clear, ["part", "i", "j"], "left").withColumn("clear", F.coalesce("clear", F.lit(0.0)))
    cells = cells.withColumn("width", F.when(F.col("free"), F.least(F.greatest(2 * F.col("clear") - size, F.lit(0.0)), F.lit(float(cap)))).otherwise(0.0))
    return cells.select("part", "i", "j", "ground", "obstacle", "top", "free", "level_change", "clear", "width", (F.col("free") & ~F.col("level_change") & (F.col("width") < accessible)).alias("narrow"))


def _sides(polygons: DataFrame) -> DataFrame:
    """The sides of polygons (part, polygon, ring), from p to q: (part, polygon, px, py, pz, qx, qy, qz)."""
    n = F.size("ring")
    pairs = F.transform("ring", lambda v, k: F.struct(v.alias("p"), F.element_at("ring", F.pmod(k + 1, n).cast("int") + 1).alias("q")))
    return polygons.where(n > 2).select("part", "polygon", F.explode(pairs).alias("s")).select("part", "polygon", *[F.col(f"s.{v}.{c}").cast("double").alias(v + c) for v in "pq" for c in "xyz"])


def _strips(sides: DataFrame, long: float, reach: float, inside: float, spread: Column) -> DataFrame:
    """A row per strip that a side passes: its columns and `cell`. A strip is `long` by an eighth of it and lies along one of TURNS directions; a side goes into those within `spread` of its own, in radians.

    A strip is passed if a point of the side, at least `inside` from its ends, lies within reach of it. Along a side, only the strips beside it are made, not all of its rectangle."""
    quantum = pi / TURNS
    wide, reach = long / 8, reach + 1e-6
    at = F.atan2(F.col("qy") - F.col("py"), F.col("qx") - F.col("px")) / quantum + 0.5
    far = spread / quantum
    rows = sides.withColumn("k", F.explode(F.sequence(F.floor(at - far), F.floor(at + far)))).withColumn("k", F.pmod("k", F.lit(TURNS)))
    c, s = F.cos(F.col("k") * quantum), F.sin(F.col("k") * quantum)
    rows = rows.withColumns({f"{v}u": F.col(f"{v}x") * c + F.col(f"{v}y") * s for v in "pq"} | {f"{v}v": F.col(f"{v}y") * c - F.col(f"{v}x") * s for v in "pq"})
    low, high = F.least("pu", "qu"), F.greatest("pu", "qu")
    number = lambda x, size: F.floor(x / size + SHIFT)
    rows = rows.withColumn("i", F.explode(F.sequence(number(low + inside - reach, long), number(high - inside + reach, long))))
    begins, ends = F.greatest(low, (F.col("i") - SHIFT) * long - reach), F.least(high, (F.col("i") + 1 - SHIFT) * long + reach)
    run = F.col("qu") - F.col("pu")
    across = lambda u, end: F.when(F.abs(run) > 1e-9, F.col("pv") + (u - F.col("pu")) * ((F.col("qv") - F.col("pv")) / run)).otherwise(F.col(end))
    v, w = across(begins, "pv"), across(ends, "qv")
    rows = rows.withColumn("j", F.explode(F.sequence(number(F.least(v, w) - reach, wide), number(F.greatest(v, w) + reach, wide))))
    return rows.select(*sides.columns, F.xxhash64("k", "i", "j").alias("cell"))


def shared_sides(polygons: DataFrame, climb: float, tolerance: float = 0.02, least: float = 0.05) -> DataFrame:
    """(part, a, b, width, portal): polygons a < b of a part whose sides lie on one line, within tolerance, for at least `least`, at heights that differ by at most climb; portal is the longest such stretch, two points (x, y, z), width its length.

    Sides meet by an equi-join on the strips of floor that they pass, twice as long as a side is on average, so a side meets those beside it and not all of its line, and rows stay in proportion to the sides. A side of a goes into
    the strips of its own direction; a side of b, whose ends may stand off by the tolerance, into those of every direction that this allows, and into all within the tolerance. What meets is tested exactly."""
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    sides = graphs.materialize(_sides(polygons).withColumn("long", F.hypot(dx, dy)).where((F.col("long") >= least) & (F.col("long") < float("inf"))).withColumns({"ux": dx / F.col("long"), "uy": dy / F.col("long")}))
    strip = max(2 * (sides.agg(F.avg("long")).first()[0] or 1.0), 64 * tolerance)
    turn = F.asin(F.least(F.lit(1.0), 2 * tolerance / F.col("long"))) + 1e-6
    a = _strips(sides, strip, 0.0, 0.4 * least, F.lit(0.0)).withColumnRenamed("polygon", "a")
    b = _strips(sides.drop("ux", "uy"), strip, tolerance, 0.0, turn).select("part", "cell", F.col("polygon").alias("b"), *[F.col(v + c).alias(f"b{v}{c}") for v in "pq" for c in "xyz"])
    met = a.join(b.hint("merge"), ["part", "cell"]).where("a < b")
    along = lambda v: (F.col(f"{v}x") - F.col("px")) * F.col("ux") + (F.col(f"{v}y") - F.col("py")) * F.col("uy")
    off = lambda v: F.abs((F.col(f"{v}y") - F.col("py")) * F.col("ux") - (F.col(f"{v}x") - F.col("px")) * F.col("uy"))
    met = met.where((off("bp") <= tolerance) & (off("bq") <= tolerance))
    met = met.select("*", F.inline(F.array(F.struct(along("bp").alias("s"), along("bq").alias("t")))))  # not a plain column, which each of its many uses below would compute anew within the join
    met = met.withColumns({"low": F.greatest(F.lit(0.0), F.least("s", "t")), "high": F.least(F.col("long"), F.greatest("s", "t"))}).withColumn("width", F.col("high") - F.col("low")).where(F.col("width") >= least)
    mine = lambda at: F.col("pz") + (F.col("qz") - F.col("pz")) * at / F.col("long")
    theirs = lambda at: F.col("bpz") + (F.col("bqz") - F.col("bpz")) * (at - F.col("s")) / (F.col("t") - F.col("s"))
    middle = (F.col("low") + F.col("high")) / 2
    met = met.where(F.abs(mine(middle) - theirs(middle)) <= climb)
    point = lambda at: F.struct((F.col("px") + F.col("ux") * at).alias("x"), (F.col("py") + F.col("uy") * at).alias("y"), mine(at).alias("z"))
    best = F.max(F.struct("width", "low", F.array(point(F.col("low")), point(F.col("high"))).alias("portal"))).alias("best")
    return met.groupBy("part", "a", "b").agg(best).select("part", "a", "b", "best.width", "best.portal")


def polygon_nodes(polygons: DataFrame) -> DataFrame:
    """(part, polygon, x, y, z, slope, level_change): the mean of the corners, and the angle in degrees between the polygon's own normal and the vertical (null without an area)."""
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda s, v: s + v[c]) / F.size("ring")
    n = F.size("ring")
    after = lambda k: F.element_at("ring", F.pmod(k + 1, n).cast("int") + 1)

    def newell(c: str, d: str) -> Column:
        terms = F.transform("ring", lambda v, k: (v[c] - after(k)[c]) * (v[d] + after(k)[d]))
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    normal = polygons.where(n > 2).select("part", "polygon", "level_change", *[mean(c).alias(c) for c in "xyz"], newell("y", "z").alias("nx"), newell("z", "x").alias("ny"), newell("x", "y").alias("nz"))
    flat = F.hypot("nx", "ny")
    slope = F.when((flat > 0) | (F.col("nz") != 0), F.degrees(F.atan2(flat, F.abs("nz"))))
    return normal.select("part", "polygon", "x", "y", "z", slope.alias("slope"), "level_change")


def routing_graph(polygons: DataFrame, *, climb: float, ramp: float, tolerance: float = 0.02, least: float = 0.05, cells: DataFrame | None = None, size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (of polygon_nodes) and edges (part, a, b, length, rise, slope, level_change, step_free, width, clearance, portal) between polygons (part, polygon, ring of (x, y, z), level_change) that share a stretch of their sides.

    length is from middle to middle; slope the steepest of both polygons and of the straight way between their middles, in degrees; an edge is step-free if it is at most `ramp` steep and no polygon of it lies over a step.
    A slope that is not known is never step-free. With cells of surface_model(), heights come from the ground under the middles, and clearance is the largest width of a cell under the portal (a body passes where it is widest); else it is the portal's width."""
    nodes = polygon_nodes(polygons)
    if cells is not None:
        under = cells.where("ground IS NOT NULL").select("part", "i", "j", "ground")
        nodes = nodes.withColumns({"i": _cell("x", size), "j": _cell("y", size)}).join(under, ["part", "i", "j"], "left").withColumn("z", F.coalesce("ground", "z")).drop("i", "j", "ground")
    nodes = graphs.materialize(nodes)
    end = lambda s: nodes.select("part", F.col("polygon").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("x", "y", "z", "slope", "level_change")])
    edges = shared_sides(polygons, climb, tolerance, least).join(end("a").hint("merge"), ["part", "a"]).join(end("b").hint("merge"), ["part", "b"])
    d = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"}
    run = F.hypot(d["x"], d["y"])
    edges = edges.withColumns({"length": F.sqrt(d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2), "rise": d["z"], "grade": F.degrees(F.atan2(F.abs(d["z"]), run)), "level_change": F.col("a_level_change") | F.col("b_level_change")}).where("length > 0")
    known = F.col("a_slope").isNotNull() & F.col("b_slope").isNotNull()
    edges = edges.withColumn("slope", F.when(known, F.greatest("a_slope", "b_slope", "grade")))
    edges = edges.withColumn("step_free", F.coalesce((F.col("slope") <= ramp) & ~F.col("level_change"), F.lit(False)))
    if cells is None:
        edges = edges.withColumn("clearance", F.col("width"))
    else:
        at = lambda k: {c: F.col("portal")[0][c] + (F.col("portal")[1][c] - F.col("portal")[0][c]) * k for c in "xy"}
        parts = F.greatest(F.lit(1), F.ceil(2 * F.col("width") / size)).cast("int")
        walk = edges.select("part", "a", "b", F.explode(F.transform(F.sequence(F.lit(0), parts), lambda k: F.struct(*[F.floor(v / size).cast("long").alias(n) for n, v in zip("ij", at(k / parts).values(), strict=True)]))).alias("c")).select("part", "a", "b", "c.*").distinct()
        widest = walk.join(cells.select("part", "i", "j", F.col("width").alias("w")), ["part", "i", "j"], "left").groupBy("part", "a", "b").agg(F.max(F.coalesce("w", F.lit(0.0))).alias("clearance"))
        edges = edges.join(widest, ["part", "a", "b"])
    return nodes, edges.select("part", "a", "b", "length", "rise", "slope", "level_change", "step_free", "width", "clearance", "portal")
