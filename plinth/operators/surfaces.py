"""Surfaces, registration and coverage: cell joins, normal equations summed in Spark, and small solves per point or per building."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_polygon, point_segment_distance
from . import graphs
from .relational import percentiles
from .spatial import AXES, indexed, k_nearest, nearest, placeable, similarity_fit

#: Heights above a floor that count as free space, the clearance of an observer's own points, and the fewest candidates that can be judged.
FREE_HEIGHT, FREE_CLEARANCE, FREE_LEAST = (0.3, 1.8), 0.15, 50


def cells_of(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return points.withColumns({"i": F.floor(F.col(x) / size), "j": F.floor(F.col(y) / size)})


def _around(cells: DataFrame) -> DataFrame:
    """Every cell and its eight neighbours, once."""
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return cells.select(F.explode(moves).alias("m"), "i", "j").select((F.col("i") + F.col("m.a")).alias("i"), (F.col("j") + F.col("m.b")).alias("j")).distinct()


#: Points that one task makes a hull of at a time.
HULL_POINTS = 50_000


def convex_hulls(points: DataFrame, most: int = HULL_POINTS) -> DataFrame:
    """points: part, x, y. part and hull (array of (x, y), counter-clockwise from the leftmost lowest, without points on its edges). A part is dealt into slices of about `most` points; the hull of a part is that of its slices' hulls."""
    own = graphs.materialize(placeable(points, ("x", "y")).select("part", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct())
    slices = own.groupBy(F.col("part").alias("of")).agg(F.ceil(F.count("*") / most).alias("slices"))
    kind = points.schema["part"].dataType.simpleString()

    def hull(xy: list[tuple[float, float]]) -> list[tuple[float, float]]:
        def chain(path):
            out: list[tuple[float, float]] = []
            for p in path:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        xy = sorted(set(xy))
        return chain(xy) + chain(xy[::-1]) if len(xy) > 2 else xy

    corners = lambda pdf: hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
    dealt = own.join(slices, F.col("part").eqNullSafe(F.col("of"))).select("part", "x", "y", F.pmod(F.xxhash64("x", "y"), F.col("slices")).alias("slice"))
    few = dealt.groupBy("part", "slice").applyInPandas(lambda key, pdf: pd.DataFrame([(key[0], *p) for p in corners(pdf)], columns=["part", "x", "y"]), f"part {kind}, x double, y double")
    return few.groupBy("part").applyInPandas(lambda key, pdf: pd.DataFrame({"part": [key[0]], "hull": [[list(p) for p in corners(pdf)]]}), f"part {kind}, hull array<array<double>>")


def splice_coverage(removed: DataFrame, added: DataFrame, size: float) -> DataFrame:
    """One row: removed and removed_cells; uncovered and uncovered_cells, those without an added point in their cell or the eight around; the uncovered fraction (0 without removed points)."""
    seen = _around(cells_of(added, size).select("i", "j").distinct()).withColumn("seen", F.lit(True))
    marked = cells_of(removed, size).join(seen, ["i", "j"], "left").withColumn("bare", F.col("seen").isNull())
    by_cell = marked.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("bare").alias("bare"))
    bare = lambda x: F.coalesce(F.sum(F.when(F.col("bare"), x)), F.lit(0))
    total = by_cell.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("removed"), F.count("*").alias("removed_cells"), bare(F.col("n")).alias("uncovered"), bare(F.lit(1)).alias("uncovered_cells"))
    return total.withColumn("fraction", F.coalesce(F.col("uncovered") / F.nullif("removed", F.lit(0)), F.lit(0.0)))


def floor_footprint(points: DataFrame, size: float, ground: Sequence[str] | None = None, band: float = 0.15) -> DataFrame:
    """Distinct cells (i, j) that hold floor: points with a ground label, or, without labels, the lowest `band` above the second percentile of z."""
    if ground is not None:
        floor = points.where(F.col("label").isin(list(ground)))
    else:
        low = percentiles(points, [], "z", {"low": 0.02})
        floor = points.crossJoin(F.broadcast(low)).where(F.col("z") <= F.col("low") + band)  # one row
    return cells_of(floor, size).select("i", "j").distinct()


def free_space_conflict(observer: DataFrame, floor: DataFrame, other: DataFrame, size: float) -> DataFrame:
    """One row: how many of `other`'s points stand above a floor cell (i, j, z) the observer saw, at a free height; how many of those have none of the observer's points within the clearance; their fraction, 0 and not measurable below the least number."""
    above = cells_of(other, size).join(floor.select("i", "j", F.col("z").alias("ground")), ["i", "j"]).withColumn("h", F.col("z") - F.col("ground"))
    candidates = graphs.materialize(above.where(F.col("h").between(*FREE_HEIGHT)).select("id", *AXES))
    alone = nearest(candidates, observer, FREE_CLEARANCE).agg(F.count("*").alias("candidates"), F.count_if(F.col("b_id").isNull()).alias("conflicting"))
    fits = F.col("candidates") >= FREE_LEAST
    return alone.select("candidates", F.when(fits, F.col("conflicting")).otherwise(0).alias("conflicting"), F.when(fits, F.col("conflicting") / F.col("candidates")).otherwise(0.0).alias("fraction"), fits.alias("measurable"))


def outside_region(cells: DataFrame, ring: Sequence[tuple[float, float]], size: float, margin: float) -> DataFrame:
    """Cells (i, j) whose middle is outside the polygon by more than margin."""
    x, y = (F.col("i") + 0.5) * size, (F.col("j") + 0.5) * size
    point = lambda a, b: F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
    p = F.struct(x.alias("x"), y.alias("y"))
    edges = [point_segment_distance(p, point(*a), point(*b)) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return cells.where(~in_polygon(x, y, F.array(*[point(*v) for v in ring])) & (F.least(*edges) > margin))


def compare_surfaces(parent: DataFrame, merged: DataFrame, ring: Sequence[tuple[float, float]], size: float, margin: float) -> DataFrame:
    """One row over the cells outside the region that either surface (i, j, ground, obstacle, level_change) observed: compared, differing, ground_differing, obstacle_lost, obstacle_added, level_differing, consistent."""
    side = lambda df, s: df.select("i", "j", F.col("ground").alias(f"{s}g"), F.coalesce("obstacle", F.lit(False)).alias(f"{s}o"), F.coalesce("level_change", F.lit(False)).alias(f"{s}l"))
    both = outside_region(side(parent, "p").join(side(merged, "m"), ["i", "j"], "full"), ring, size, margin)
    both = both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("po", "mo", "pl", "ml")}).where("pg IS NOT NULL OR mg IS NOT NULL OR po OR mo")
    ground = (F.col("pg").isNull() != F.col("mg").isNull()) | F.coalesce(F.abs(F.col("pg") - F.col("mg")) > 1e-6, F.lit(False))
    tests = {"ground_differing": ground, "obstacle_lost": F.col("po") & ~F.col("mo"), "obstacle_added": ~F.col("po") & F.col("mo"), "level_differing": F.col("pl") != F.col("ml")}
    total = both.withColumns(tests).agg(F.count("*").alias("compared"), F.count_if(F.expr(" OR ".join(tests))).alias("differing"), *[F.count_if(F.col(t)).alias(t) for t in tests])
    return total.withColumn("consistent", F.col("differing") == 0)


def distance_to_mask(cells: DataFrame, mask: DataFrame, size: float) -> DataFrame:
    """(i, j, distance) of all cells: the Euclidean distance between their middle and that of the nearest mask cell, 0 for those in it; null if the mask is empty."""
    placed = lambda df: df.select("i", "j").distinct().select(cell_id(F.col("i"), F.col("j")).alias("id"), F.col("i").alias("x"), F.col("j").alias("y"))
    near = k_nearest(placed(cells), placed(mask), 1, axes=("x", "y")).select("id", (F.col("distance") * size).alias("distance"))
    return placed(cells).join(near, "id", "left").select(F.col("x").alias("i"), F.col("y").alias("j"), "distance")


def coverage_state(observations: DataFrame, mass: float, angle: float) -> DataFrame:
    """observations: cell, weight, bearing (degrees). Per cell its observed mass, the widest angle between two bearings, and f = min(1, mass / a0) * min(1, angle / g0). The widest angle comes from all bearings: sorted around the circle, 180 less what the nearest opposite lacks."""
    bearings = observations.where("bearing IS NOT NULL").select("cell", F.pmod("bearing", F.lit(360.0)).alias("b")).distinct()
    # the farthest from b is the bearing nearest to b + 180: look at its neighbours in the order of b and of b + 180 together
    both = bearings.withColumn("at", F.col("b")).withColumn("own", F.lit(True)).unionByName(bearings.withColumn("at", F.pmod(F.col("b") + 180, F.lit(360.0))).withColumn("own", F.lit(False)))
    w = Window.partitionBy("cell").orderBy("at", "own")
    whole = Window.partitionBy("cell")
    own = F.when(F.col("own"), F.col("b"))
    near = both.withColumn("before", F.coalesce(F.last(own, True).over(w), F.max(own).over(whole))).withColumn("after", F.coalesce(F.first(own, True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.min(own).over(whole)))
    apart = lambda a, b: F.lit(180.0) - F.abs(F.pmod(a - b, F.lit(360.0)) - 180.0)
    widest = near.where("NOT own").groupBy("cell").agg(F.max(F.greatest(apart(F.col("b"), F.col("before")), apart(F.col("b"), F.col("after")))).alias("angle"))
    mass_of = observations.groupBy("cell").agg(F.sum("weight").alias("mass"))
    state = mass_of.join(widest, "cell", "left").withColumn("angle", F.coalesce("angle", F.lit(0.0)))
    turn = F.least(F.lit(1.0), F.col("angle") / angle) if angle > 0 else F.lit(1.0)
    return state.withColumn("f", F.least(F.lit(1.0), F.col("mass") / mass) * turn)


def coverage_metrics(targets: DataFrame, state: DataFrame, mass: float, angle: float, cell_area: float) -> DataFrame:
    """targets: cell, importance; state: of coverage_state. One row: target and covered area, importance-weighted f, and the share of observed mass beyond what each cell needs."""
    s = targets.join(state, "cell", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("mass", "angle", "f")})
    covered = (F.col("mass") >= mass - 1e-9) & ((F.lit(angle) <= 0) | (F.col("angle") >= angle - 1e-9))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    total, needed = F.sum("mass"), F.sum(F.least(F.col("mass"), F.lit(float(mass))))
    return s.agg((F.count("*") * cell_area).alias("target_area"), (F.count_if(covered) * cell_area).alias("covered_area"), ratio(F.sum(F.col("importance") * F.col("f")), F.sum("importance")).alias("weighted"), ratio(total - needed, total).alias("redundant"))


def cell_regions(cells: DataFrame) -> DataFrame:
    """(i, j, region, size) of 4-connected cells; region is the smallest (i, j) of it, packed."""
    named = graphs.materialize(cells.select("i", "j").distinct().withColumn("id", cell_id(F.col("i"), F.col("j"))))
    steps = F.explode(F.array(cell_id(F.col("i") + 1, F.col("j")), cell_id(F.col("i"), F.col("j") + 1)))
    edges = named.select(F.col("id").alias("a"), steps.alias("b")).join(named.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    regions = graphs.materialize(named.join(graphs.components(named.select("id"), edges), "id"))
    sizes = regions.groupBy("component").agg(F.count("*").alias("size"), F.min(F.struct("i", "j")).alias("first"))
    return regions.join(sizes, "component").select("i", "j", F.col("first.i").alias("region_i"), F.col("first.j").alias("region_j"), "size")


def triangulate(rays: DataFrame, least: int = 2) -> DataFrame:
    """rays: point, ox, oy, oz (eye), dx, dy, dz (direction, any length). Per point the place nearest to all its rays (sums of the normal equations, solved by Cramer's rule in the JVM), its rays and the root mean square distance to them; nulls if they are too few or parallel."""
    n = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    unit = placeable(rays, ("ox", "oy", "oz", "dx", "dy", "dz")).withColumn("n", n).where("n > 0")
    unit = unit.withColumns({f"d{a}": F.col(f"d{a}") / F.col("n") for a in AXES})
    m = lambda a, b: (F.lit(1.0 if a == b else 0.0) - F.col(f"d{a}") * F.col(f"d{b}"))  # noqa: E731  the part across the ray
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    right = {a: sum((m(*sorted((a, b))) * F.col(f"o{b}") for b in AXES), F.lit(0.0)) for a in AXES}
    square = sum((F.col(f"o{a}") * right[a] for a in AXES), F.lit(0.0))
    s = unit.groupBy("point").agg(F.count("*").alias("rays"), F.sum(square).alias("oo"), *[F.sum(m(a, b)).alias(a + b) for a, b in pairs], *[F.sum(right[a]).alias(f"r{a}") for a in AXES])
    c = lambda a, b: F.col("".join(sorted(a + b)))

    def det(cols):
        (a, b, d), (e, f, g), (h, i, j) = cols
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    matrix = [[c(a, b) for b in AXES] for a in AXES]
    base = det(matrix)
    solved = {a: det([[F.col(f"r{row}") if k == col else matrix[i][col] for col in range(3)] for i, row in enumerate(AXES)]) / F.col("det") for k, a in enumerate(AXES)}
    found = s.withColumn("det", base).withColumn("good", (F.col("rays") >= least) & (F.col("det") > 1e-9)).withColumns({a: F.when(F.col("good"), v) for a, v in solved.items()})
    miss = F.col("oo") - sum((F.col(a) * F.col(f"r{a}") for a in AXES), F.lit(0.0))
    return found.select("point", "rays", *AXES, F.when(F.col("good"), F.sqrt(F.greatest(miss, F.lit(0.0)) / F.col("rays"))).alias("rms"))


def scale_from_distances(pairs: DataFrame) -> DataFrame:
    """pairs: part, built (length in the reconstruction), measured. Per part the least-squares scale, how many pairs, and the largest relative deviation of a pair from it. Lengths must be positive; others are left out."""
    good = pairs.where("built > 0 AND measured > 0")
    fit = good.groupBy("part").agg((F.sum(F.col("built") * F.col("measured")) / F.sum(F.col("built") * F.col("built"))).alias("scale"), F.count("*").alias("pairs"))
    worst = good.join(fit, "part").groupBy("part").agg(F.max(F.abs(F.col("built") * F.col("scale") / F.col("measured") - 1)).alias("spread"))
    return fit.join(worst, "part")


def reproject(versions: DataFrame, scale: float, rotation: np.ndarray, move: Sequence[float], old: str, new: str) -> DataFrame:
    """versions: id, version, frame, x, y, z and columns of their own. The rows that a change of frame adds: of each id whose latest version is in the old frame, that version + 1 in the new frame, moved by the similarity."""
    latest = versions.groupBy("id").agg(F.max("version").alias("version"))
    rows = versions.join(latest, ["id", "version"]).where(F.col("frame") == old)
    moved = {a: F.lit(float(move[i])) + float(scale) * sum((float(rotation[i][k]) * F.col(b) for k, b in enumerate(AXES)), F.lit(0.0)) for i, a in enumerate(AXES)}
    return rows.withColumns(moved | {"version": F.col("version") + 1, "frame": F.lit(new)}).select(versions.columns)


def surface_normals(points: DataFrame, k: int = 12) -> DataFrame:
    """(id, nx, ny, nz, flatness): the direction in which the k nearest points (itself included) spread least, up if it is not level; flatness is the share of that spread. Moments are summed in the JVM, a 3 x 3 problem per point solved in Arrow batches."""
    at = lambda p: [F.col(a).alias(f"{p}{a}") for a in AXES]
    near = k_nearest(points, points, k).select("id", "b_id").join(points.select(F.col("id").alias("b_id"), *at("")), "b_id")
    sums = near.groupBy("id").agg(*[F.covar_pop(a, b).alias(a + b) for i, a in enumerate(AXES) for b in AXES[i:]])
    order = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]

    def run(batches):
        for pdf in batches:
            m = pdf.iloc[:, 1:].to_numpy(float)[:, order]
            values, vectors = np.linalg.eigh(m)
            n = vectors[:, :, 0]
            lead = np.where(np.abs(n[:, 2]) > 1e-12, n[:, 2], np.where(np.abs(n[:, 1]) > 1e-12, n[:, 1], n[:, 0]))
            n = n * np.where(lead < 0, -1.0, 1.0)[:, None]
            total = values.sum(axis=1)
            yield pd.DataFrame({"id": pdf["id"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "flatness": np.divide(values[:, 0], total, out=np.zeros(len(total)), where=total > 0)})

    return sums.mapInPandas(run, f"id {points.schema['id'].dataType.simpleString()}, nx double, ny double, nz double, flatness double")


def _moved(points: DataFrame, scale: float, rotation: np.ndarray, move: np.ndarray) -> DataFrame:
    return points.withColumns({a: F.lit(float(move[i])) + float(scale) * sum((float(rotation[i, k]) * F.col(b) for k, b in enumerate(AXES)), F.lit(0.0)) for i, a in enumerate(AXES)})


def align_clouds(source: DataFrame, target: DataFrame, schedule: Sequence[float], with_scale: bool = True, rounds: int = 20, tolerance: float = 1e-7) -> tuple[float, np.ndarray, np.ndarray]:
    """Iterative closest point: scale, rotation and move that bring source onto target. Each round pairs the moved source points with their nearest target points within the stage's distance and solves for the pairs' sums; schedule: distances of the stages, widest first. Fewer than three pairs raise an error."""
    scale, rotation, move = 1.0, np.eye(3), np.zeros(3)
    there = target.select(F.col("id").alias("b_id"), *[F.col(a).alias(b) for a, b in zip(AXES, ("u", "v", "w"), strict=True)])
    index = indexed(target, 1)
    for reach in schedule:
        before = np.inf
        for _ in range(rounds):
            placed = graphs.materialize(_moved(source.select("id", *AXES), scale, rotation, move))
            pairs = nearest(placed, target, reach, index=index).where("b_id IS NOT NULL")
            matched = graphs.materialize(pairs.join(source.select("id", *AXES), "id").join(there, "b_id"))
            stats = matched.agg(F.count("*").alias("n"), F.avg(F.col("distance") ** 2).alias("mse")).first()
            if stats["n"] < 3:
                raise ValueError(f"{stats['n']} pairs within {reach}")
            s, r, t = similarity_fit(matched)
            if not with_scale:
                centre = matched.agg(*[F.avg(c).alias(c) for c in (*AXES, "u", "v", "w")]).first()
                s, t = 1.0, np.array([centre[c] for c in ("u", "v", "w")]) - r @ np.array([centre[c] for c in AXES])
            scale, rotation, move = s, r, t
            if abs(before - stats["mse"]) <= tolerance * max(1e-12, stats["mse"]):
                break
            before = stats["mse"]
    return scale, rotation, move


def alignment_metrics(source: DataFrame, target: DataFrame, reach: float) -> DataFrame:
    """One row for clouds in one frame: source points, those with a target point within reach, their share, and mean, median and root mean square of their distances (null without any)."""
    near = graphs.materialize(nearest(source, target, reach))
    d = F.col("distance")
    found = near.agg(F.count("*").alias("points"), F.count("b_id").alias("inliers"), F.coalesce(F.count("b_id") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("ratio"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rms"))
    return found.crossJoin(percentiles(near, [], "distance", {"median": 0.5})).select("points", "inliers", "ratio", "mean", "median", "rms")  # one row each


def seam_step(added: DataFrame, kept: DataFrame, ring: Sequence[tuple[float, float]], band: float, k: int = 8) -> DataFrame:
    """One row: added points within band of the region's edge, kept points within twice that, matched ones, and the median distance of these to the plane of the kept surface next to them (null below three)."""
    point = lambda a, b: F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
    edge = F.least(*[point_segment_distance(F.struct("x", "y"), point(*a), point(*b)) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)])
    inside, across = graphs.materialize(added.where(edge < band)), graphs.materialize(kept.where(edge < 2 * band))
    normals = graphs.materialize(surface_normals(across, k).join(across.select("id", *[F.col(a).alias(f"k{a}") for a in AXES]), "id").withColumnRenamed("id", "b_id"))
    pairs = nearest(inside, across, 2 * band).where("b_id IS NOT NULL").join(normals, "b_id").join(inside.select("id", *AXES), "id")
    step = F.abs(sum(((F.col(a) - F.col(f"k{a}")) * F.col(f"n{a}") for a in AXES), F.lit(0.0)))
    steps = graphs.materialize(pairs.select(step.alias("off")))
    sizes = inside.agg(F.count("*").alias("band_points")).crossJoin(across.agg(F.count("*").alias("kept_points")))  # one row each
    found = steps.agg(F.count("*").alias("matched")).crossJoin(percentiles(steps, [], "off", {"step": 0.5}))
    return sizes.crossJoin(found).withColumn("step", F.when(F.col("matched") >= 3, F.col("step")))


def loop_confirmed(rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """rooms: building, room, fixed; doors: building, a, b. (building, room, confirmed) of the rooms a fixed one reaches: confirmed if they stay reachable without any one door. A room is not confirmed exactly if a bridge cuts it off: one depth-first walk per building finds the bridges."""

    def run(key, rooms: pd.DataFrame, doors: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for n, (a, b) in enumerate(zip(doors["a"], doors["b"], strict=True)):
            near.setdefault(a, []).append((b, n))
            near.setdefault(b, []).append((a, n))
        fixed = set(rooms.loc[rooms["fixed"], "room"])
        for n, r in enumerate(sorted(fixed)):  # all fixed rooms hang on one root, by doors that cannot be lost
            for copy in (0, 1):
                near.setdefault(None, []).append((r, ("root", n, copy)))
                near.setdefault(r, []).append((None, ("root", n, copy)))
        seen: dict = {None: 0}
        low, bridge_below, order = {None: 0}, {None: False}, []
        stack = [(None, None, iter(near.get(None, ())))]
        parent = {None: None}
        while stack:
            at, by, rest = stack[-1]
            for to, door in rest:
                if door == by:
                    continue
                if to in seen:
                    low[at] = min(low[at], seen[to])
                else:
                    seen[to] = low[to] = len(seen)
                    parent[to] = at
                    order.append(to)
                    stack.append((to, door, iter(near.get(to, ()))))
                    break
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[at])
        for r in order:
            bridge_below[r] = bridge_below[parent[r]] or low[r] > seen[parent[r]]
        return pd.DataFrame([(key[0], r, not bridge_below[r]) for r in order], columns=["building", "room", "confirmed"])

    kind = {c: rooms.schema[c].dataType.simpleString() for c in ("building", "room")}
    renewed = doors.select(*[F.col(c).alias(c) for c in ("building", "a", "b")])
    return rooms.select("building", "room", "fixed").groupBy("building").cogroup(renewed.groupBy("building")).applyInPandas(run, f"building {kind['building']}, room {kind['room']}, confirmed boolean")


def strongest_placement(rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """rooms: building, room, fixed, x, y; doors: building, id, a, b, weight, dx, dy (b stands at a + (dx, dy)). (building, room, x, y, door) of every room a fixed one reaches, placed through the strongest doors first; door is the one that placed it, null for fixed rooms. Ties take the smaller id. A building is one task."""

    def run(key, rooms: pd.DataFrame, doors: pd.DataFrame) -> pd.DataFrame:
        import heapq

        place = {r: (x, y, None) for r, f, x, y in rooms[["room", "fixed", "x", "y"]].itertuples(index=False) if f}
        near: dict = {}
        for i, a, b, w, dx, dy in doors[["id", "a", "b", "weight", "dx", "dy"]].itertuples(index=False):
            near.setdefault(a, []).append((-w, i, b, dx, dy))
            near.setdefault(b, []).append((-w, i, a, -dx, -dy))
        heap = [(*door, r) for r in place for door in near.get(r, ())]
        heapq.heapify(heap)
        while heap:
            _, i, to, dx, dy, at = heapq.heappop(heap)
            if to in place:
                continue
            place[to] = (place[at][0] + dx, place[at][1] + dy, i)
            for door in near.get(to, ()):
                heapq.heappush(heap, (*door, to))
        out = pd.DataFrame([(key[0], r, x, y, i) for r, (x, y, i) in place.items()], columns=["building", "room", "x", "y", "door"])
        return out.astype({"door": "Int64"})

    kind = {c: rooms.schema[c].dataType.simpleString() for c in ("building", "room")}
    renewed = doors.select(*[F.col(c).alias(c) for c in ("building", "id", "a", "b", "weight", "dx", "dy")])
    return rooms.select("building", "room", "fixed", "x", "y").groupBy("building").cogroup(renewed.groupBy("building")).applyInPandas(run, f"building {kind['building']}, room {kind['room']}, x double, y double, door long")


def grid_edges(cells: DataFrame) -> DataFrame:
    """cells: graph, i, j that can be walked. Directed edges (graph, a, b, length) between the eight neighbours; a diagonal step needs both cells beside it, so that no corner is cut. Node ids pack i and j."""
    cells = cells.select("graph", "i", "j").distinct()
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    steps = cells.select("graph", "i", "j", F.explode(moves).alias("m"))
    there = lambda di, dj: cells.select("graph", F.col("i").alias(di), F.col("j").alias(dj))
    steps = steps.withColumns({"ti": F.col("i") + F.col("m.a"), "tj": F.col("j") + F.col("m.b")}).join(there("ti", "tj"), ["graph", "ti", "tj"], "left_semi")
    straight = steps.where("m.a = 0 OR m.b = 0")
    diagonal = steps.where("m.a <> 0 AND m.b <> 0").join(there("ti", "j"), ["graph", "ti", "j"], "left_semi").join(there("i", "tj"), ["graph", "i", "tj"], "left_semi")
    both = straight.unionByName(diagonal)
    return both.select("graph", cell_id(F.col("i"), F.col("j")).alias("a"), cell_id(F.col("ti"), F.col("tj")).alias("b"), F.sqrt(F.abs("m.a") + F.abs("m.b")).alias("length"))


def cell_id(i: Column, j: Column) -> Column:
    """The node id of a cell in grid_edges."""
    return F.shiftleft((i + F.lit(1 << 30)).cast("long"), 32) + j + F.lit(1 << 30)


#: Planes that are held against all cameras at a time.
PLANES = 32


def estimate_gravity(planes: DataFrame, cameras: DataFrame, most_angle: float = 30.0, consistency: float = 0.5, above: float = 0.9) -> DataFrame:
    """planes: plane, nx, ny, nz, d, inliers (any number); cameras: x, y, z and ux, uy, uz (up). The floor: of the planes whose normal, turned to the cameras' mean up, is within most_angle of it and has at least the share `above` of the cameras on its upper side, the one with most inliers (ties: smaller plane). plane, the up direction, its angle and share; no row if the ups disagree (their mean is shorter than `consistency`) or no plane passes."""
    length = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    ups = placeable(cameras, ("x", "y", "z", "ux", "uy", "uz")).withColumn("l", length).where("l > 0")
    mean = ups.agg(*[F.avg(F.col(f"u{a}") / F.col("l")).alias(f"m{a}") for a in AXES]).withColumn("m", F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)).where(F.col("m") >= consistency)
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    turned = planes.withColumn("l", size).where("l > 0").crossJoin(F.broadcast(mean))  # one row
    dot = sum((F.col(f"n{a}") * F.col(f"m{a}") for a in AXES), F.lit(0.0)) / (F.col("l") * F.col("m"))
    turned = turned.withColumn("dot", dot).withColumn("side", F.when(F.col("dot") < 0, -1.0).otherwise(1.0))
    tilted = turned.withColumn("angle", F.degrees(F.acos(F.least(F.lit(1.0), F.abs("dot"))))).where(F.col("angle") <= most_angle)
    tilted = tilted.select("plane", "inliers", "angle", *[(F.col("side") * F.col(c) / F.col("l")).alias(c) for c in ("nx", "ny", "nz", "d")])
    tilted = graphs.materialize(tilted.where("inliers IS NOT NULL"))
    cameras = graphs.materialize(ups.select("x", "y", "z"))
    height = sum((F.col(f"n{a}") * F.col(a) for a in AXES), F.lit(0.0)) + F.col("d")
    after = None
    while True:  # the planes in order of their inliers, PLANES at a time, until one passes
        rest = tilted if after is None else tilted.where((F.col("inliers") < after[0]) | ((F.col("inliers") == after[0]) & (F.col("plane") > after[1])))
        some = graphs.materialize(rest.orderBy(F.desc("inliers"), "plane").limit(PLANES))
        last = some.orderBy("inliers", F.desc("plane")).limit(1).collect()
        seen = cameras.crossJoin(F.broadcast(some)).groupBy("plane").agg(F.avg((height > 0).cast("double")).alias("share"))  # at most PLANES rows are sent
        fit = graphs.materialize(some.join(seen, "plane").where(F.col("share") >= above).orderBy(F.desc("inliers"), "plane").limit(1).select("plane", "nx", "ny", "nz", "angle", "share"))
        if not last or not fit.isEmpty():
            return fit
        after = (last[0]["inliers"], last[0]["plane"])
