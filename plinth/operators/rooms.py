"""Rooms as sets of cells: holes, frontiers and outlines; and how the rooms of a building hang together.

Cells are (part, i, j); parts (a floor, a room) never meet. Nodes of routing graphs have ids of their own within a part.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graphs
from .walkable import clearance

SIDES = [(1, 0), (-1, 0), (0, 1), (0, -1)]
#: Edges that one task thins to a forest.
FOREST_EDGES = 200_000


def _moved(cells: DataFrame, places: Iterable[tuple[int, int]]) -> DataFrame:
    """(part, i, j, oi, oj): the cells around each cell (oi, oj)."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in places])).alias("m")
    return cells.select("part", F.col("i").alias("oi"), F.col("j").alias("oj"), moves).select("part", (F.col("oi") + F.col("m.a")).alias("i"), (F.col("oj") + F.col("m.b")).alias("j"), "oi", "oj")


def _cells(df: DataFrame) -> DataFrame:
    return df.select("part", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).where("part IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL").distinct()


def holes(cells: DataFrame) -> DataFrame:
    """(part, i, j): empty cells that the cells of their part enclose, seen by sides. What is outside floods in from beyond the box around a part: runs of empty cells of a row are contracted first, then the runs that touch."""
    own = graphs.materialize(_cells(cells))
    box = own.groupBy("part").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    grid = box.select("part", "i0", "j0", "j1", F.explode(F.sequence(F.col("i0") - 1, F.col("i1") + 1)).alias("i")).select("part", "i0", "i", F.explode(F.sequence(F.col("j0") - 1, F.col("j1") + 1)).alias("j"))
    empty = grid.join(own, ["part", "i", "j"], "left_anti")
    run = F.col("j") - F.row_number().over(Window.partitionBy("part", "i").orderBy("j"))
    empty = graphs.materialize(empty.select("part", "i", "j", F.struct("part", "i", run.alias("run")).alias("id"), (F.col("i") == F.col("i0") - 1).alias("outside")))
    below = empty.select("part", (F.col("i") + 1).alias("i"), "j", F.col("id").alias("a"))
    touching = empty.select("part", "i", "j", F.col("id").alias("b")).join(below, ["part", "i", "j"]).select("a", "b").distinct()
    label = graphs.components(empty.select("id").distinct(), touching)
    named = empty.join(label, "id")
    flooded = named.where("outside").select("component").distinct()
    return named.join(flooded, "component", "left_anti").select("part", "i", "j")


def frontier(free: DataFrame, blocked: DataFrame) -> DataFrame:
    """Free cells with a side to a cell that is neither free nor blocked: where what is known ends."""
    known = _cells(free).unionByName(_cells(blocked)).distinct()
    around = _moved(_cells(free), SIDES)
    return around.join(known, ["part", "i", "j"], "left_anti").select("part", F.col("oi").alias("i"), F.col("oj").alias("j")).distinct()


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Corners of a closed ring that keep it within tolerance: halves between two far corners, cut again at the corner that is farthest off, as long as that is more than the tolerance."""
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(1)))
    keep, open_ = {0, far}, [(0, far), (far, len(ring))]
    closed = np.vstack([ring, ring[:1]])
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        way, off = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        long = np.hypot(*way)
        apart = np.abs(way[0] * off[:, 1] - way[1] * off[:, 0]) / long if long > 0 else np.hypot(off[:, 0], off[:, 1])
        k = int(np.argmax(apart))
        if apart[k] > tolerance:
            keep.add(a + 1 + k)
            open_ += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[sorted(keep)]


def _rings(start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Closed rings of unit sides; where two rings touch at a corner, each turns to its own cell (to the left)."""
    ahead: dict[tuple, list[int]] = {}
    for k, p in enumerate(map(tuple, start.tolist())):
        ahead.setdefault(p, []).append(k)
    left, out = np.ones(len(start), bool), []
    for first in np.lexsort((start[:, 1], start[:, 0])).tolist():
        if not left[first]:
            continue
        ring, k = [], first
        while left[k]:
            left[k] = False
            way = end[k] - start[k]
            if not ring or (ring[-1][1] != way).any():
                ring.append((start[k], way))
            after = ahead[tuple(end[k].tolist())]
            k = max(after, key=lambda n: (way[0] * (end[n] - start[n])[1] - way[1] * (end[n] - start[n])[0]))
        if len(ring) > 1 and (ring[0][1] == ring[-1][1]).all():
            ring = ring[1:]
        out.append(np.array([p for p, _ in ring]))
    return out


def outlines(cells: DataFrame, size: float, tolerance: float = 0.0) -> DataFrame:
    """(part, ring, outer, area, corners): the rings around the cells of each part, outer ones counter-clockwise and holes clockwise with a negative area, in metres; area is that of the cells, corners are simplified within tolerance. Sides come from joins; a task holds the sides of one part."""
    own = _cells(cells)
    sides = {(0, -1): ((0, 0), (1, 0)), (1, 0): ((1, 0), (1, 1)), (0, 1): ((1, 1), (0, 1)), (-1, 0): ((0, 1), (0, 0))}
    open_ = _moved(own, sides).join(own, ["part", "i", "j"], "left_anti").select("part", F.col("oi").alias("i"), F.col("oj").alias("j"), (F.col("i") - F.col("oi")).alias("a"), (F.col("j") - F.col("oj")).alias("b"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["i", "j"]].to_numpy()
        ends = np.array([sides[a, b] for a, b in pdf[["a", "b"]].itertuples(index=False)])
        rows = []
        for n, ring in enumerate(_rings(at + ends[:, 0], at + ends[:, 1])):
            after = np.roll(ring, -1, axis=0)
            area = float((ring[:, 0] * after[:, 1] - after[:, 0] * ring[:, 1]).sum()) / 2 * size * size
            rows.append((key[0], n, area > 0, area, (simplified(ring.astype(float) * size, tolerance)).tolist()))
        return pd.DataFrame(rows, columns=["part", "ring", "outer", "area", "corners"])

    return open_.groupBy("part").applyInPandas(run, f"part {cells.schema['part'].dataType.simpleString()}, ring int, outer boolean, area double, corners array<array<double>>")


def room_seeds(footprints: DataFrame, size: float) -> DataFrame:
    """footprints: part, room, i, j. (part, room, x, y): the middle of the cell that lies deepest in each room, holes filled; of a plateau (cells less than half a cell shallower) the one nearest to its middle."""
    key = F.to_json(F.struct("part", "room"))
    own = footprints.select(key.alias("key"), "part", "room", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct()
    cells = own.select(F.col("key").alias("part"), "i", "j")
    deep = clearance(cells.unionByName(holes(cells))).withColumnRenamed("part", "key").join(own, ["key", "i", "j"])
    room = Window.partitionBy("key")
    flat = deep.withColumn("top", F.max("cells").over(room)).where(F.col("cells") >= F.col("top") - 0.5)
    flat = flat.withColumn("off", F.hypot(F.col("i") - F.avg("i").over(room), F.col("j") - F.avg("j").over(room)))
    best = flat.groupBy("part", "room").agg(F.min(F.struct("off", "i", "j")).alias("s"))
    return best.select("part", "room", ((F.col("s.i") + 0.5) * size).alias("x"), ((F.col("s.j") + 0.5) * size).alias("y"))


def _forest(edges: list[tuple]) -> tuple[list[tuple], dict]:
    """The edges (a, b, width), widest first, that join what was apart."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for a, b, width in sorted(edges, key=lambda e: -e[2]):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[rb] = ra
            kept.append((a, b, width))
    return kept, up


def widest_ways(edges: DataFrame, seeds: DataFrame, task_edges: int = FOREST_EDGES) -> DataFrame:
    """edges: part, a, b, width, in both directions alike; seeds: part, room, node. (part, room, other, width) for each two rooms of a part that a way joins: the width of the narrowest place on the widest way between their nodes (infinite if they share it).

    Widest ways run along a widest spanning forest, and the forest of a graph is within those of its parts: tasks thin edges first, and a part's last task gets fewer edges than its nodes for each of them. Edges without a width take no part."""
    own = edges.where("a IS NOT NULL AND b IS NOT NULL AND width IS NOT NULL AND NOT isnan(width) AND a <> b").select("part", "a", "b", F.col("width").cast("double").alias("width"))
    own = graphs.materialize(own)
    node, part, room = own.schema["a"].dataType.simpleString(), own.schema["part"].dataType.simpleString(), seeds.schema["room"].dataType.simpleString()
    columns = ["part", "a", "b", "width"]
    sizes = own.groupBy("part").agg(F.count("*").alias("n"))
    dealt = own.join(sizes, "part").withColumn("task", F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("n") / task_edges)))

    def thin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *e) for e in _forest(list(pdf[["a", "b", "width"]].itertuples(index=False, name=None)))[0]], columns=columns)

    thinned = dealt.groupBy("part", "task").applyInPandas(thin, f"part {part}, a {node}, b {node}, width double")

    def join_up(key: tuple, pdf: pd.DataFrame, rooms: pd.DataFrame) -> pd.DataFrame:
        kept, _ = _forest(list(pdf[["a", "b", "width"]].itertuples(index=False, name=None)))
        held, up, rows = {}, {}, []

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for r, n in rooms[["room", "node"]].sort_values("room").itertuples(index=False, name=None):
            rows += [(key[0], other, r, float("inf")) for other in held.get(n, [])]
            held.setdefault(n, []).append(r)
        for a, b, width in kept:
            ra, rb = root(a), root(b)
            one, two = held.pop(ra, []), held.pop(rb, [])
            rows += [(key[0], min(x, y), max(x, y), width) for x in one for y in two]
            up[rb] = ra
            held[ra] = one + two
        return pd.DataFrame(rows, columns=["part", "room", "other", "width"])

    asked = seeds.where("room IS NOT NULL AND node IS NOT NULL").select("part", "room", F.col("node").cast(node).alias("node"))
    return thinned.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(join_up, f"part {part}, room {room}, other {room}, width double")


def room_connectivity(seeds: DataFrame, footprints: DataFrame, nodes: DataFrame, edges: DataFrame, size: float, snap: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """How a part's routing graph joins its rooms. seeds: part, room, x, y; footprints: part, room, i, j; nodes: part, id, x, y (ids unique over all parts); edges: part, a, b, clearance, step_free, portal.

    First (part, room, node, reached, step_free_reached): the node nearest to the room's seed within snap, and whether it is in the component that holds most of the part's nodes, over all edges and over the step-free ones. Second, for two rooms whose floors an edge joins: (part, room, other, edges, step_free,
    clearance, portal), the last two of the edge with the most clearance. A node stands in the room that has most of the nine cells around it (ties: the smaller room)."""
    nodes = graphs.materialize(nodes.select("part", "id", "x", "y"))
    cell = lambda c, w: F.floor(F.col(c) / w).cast("long")
    nine = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    at = nodes.withColumns({"i": cell("x", size), "j": cell("y", size)})
    votes = _moved(at.select("part", "i", "j").distinct(), nine).join(footprints.select("part", "room", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct(), ["part", "i", "j"]).groupBy("part", F.col("oi").alias("i"), F.col("oj").alias("j"), "room").agg(F.count("*").alias("n"))
    first = Window.partitionBy("part", "i", "j").orderBy(F.desc("n"), "room")
    owner = votes.withColumn("k", F.row_number().over(first)).where("k = 1").select("part", "i", "j", "room")
    room_of = at.join(owner, ["part", "i", "j"]).select("part", "id", "room")

    far = _moved(seeds.select("part", cell("x", snap).alias("i"), cell("y", snap).alias("j")).distinct(), nine)
    near = seeds.select("part", "room", F.col("x").alias("sx"), F.col("y").alias("sy"), cell("x", snap).alias("oi"), cell("y", snap).alias("oj")).join(far, ["part", "oi", "oj"]).join(nodes.withColumns({"i": cell("x", snap), "j": cell("y", snap)}), ["part", "i", "j"])
    near = near.withColumn("off", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).where(F.col("off") <= snap).groupBy("part", "room").agg(F.min(F.struct("off", "id")).alias("n")).select("part", "room", F.col("n.id").alias("node"))

    def main(own: DataFrame, name: str) -> DataFrame:
        label = graphs.components(nodes.select("id"), own.select("a", "b")).join(nodes.select("part", "id"), "id")
        size_of = label.groupBy("part", "component").agg(F.count("*").alias("n"))
        largest = size_of.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "component"))).where("k = 1").select("part", "component")
        return label.join(largest, ["part", "component"]).select(F.col("id").alias("node"), F.lit(True).alias(name))

    rooms = seeds.select("part", "room").join(near, ["part", "room"], "left").join(main(edges, "reached"), "node", "left").join(main(edges.where("step_free"), "step_free_reached"), "node", "left")
    rooms = rooms.select("part", "room", "node", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("reached", "step_free_reached")])
    ends = edges.join(room_of.toDF("part", "a", "ra"), ["part", "a"]).join(room_of.toDF("part", "b", "rb"), ["part", "b"]).where("ra <> rb")
    between = ends.groupBy("part", F.least("ra", "rb").alias("room"), F.greatest("ra", "rb").alias("other")).agg(F.count("*").alias("edges"), F.max("step_free").alias("step_free"), F.max("clearance").alias("clearance"), F.max_by("portal", F.struct("clearance", "a", "b")).alias("portal"))
    return rooms, between
