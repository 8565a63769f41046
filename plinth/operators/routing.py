"""Routes through buildings: obstacles and portals as joins over edges, shortest paths per graph in one task each, assembly as joins over the paths.

Frames: nodes (graph, id, x, y, z, floor), edges (graph, a, b, cost and columns of their own), requests (request, graph, source, target). A graph is
one building; requests of a busy one are dealt over several tasks, each with its edges. Graphs beyond `most_edges` edges do not go through these tasks but
through searches.searches(), which settles them block by block."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import segment_hits_box
from . import searches
from .graphs import materialize
from .relational import in_groups

#: Seconds in an elevator, speeds on stairs and of walkers in metres a second.
ELEVATOR_SECONDS, STAIRS_SPEED, WALKING, STEP_FREE_WALKING = 45.0, 0.5, 1.3, 1.0
MOST_EDGES, PARTS = 200_000, 16


def graph_bounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: how many nodes and edges, and the box around its nodes."""
    size = nodes.groupBy("graph").agg(F.count("*").alias("nodes"), *[f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))])
    return size.join(edges.groupBy("graph").agg(F.count("*").alias("edges")), "graph", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def placed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with both ends' positions as structs pa and pb, and the 3-D length between them. Edges without a node at either end are dropped."""
    at = nodes.select("graph", "id", F.struct("x", "y", "z").alias("p"))
    both = edges.join(at.toDF("graph", "a", "pa"), ["graph", "a"]).join(at.toDF("graph", "b", "pb"), ["graph", "b"])
    apart = sum(((F.col(f"pa.{c}") - F.col(f"pb.{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return both.withColumn("length", F.sqrt(apart))


def clear_of_boxes(nodes: DataFrame, edges: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes outside every box of their graph, and edges of which neither end nor any point lies in one. boxes: graph, box (min_x, min_y, max_x, max_y)."""
    inside = (F.col("x") >= F.col("box.min_x")) & (F.col("x") <= F.col("box.max_x")) & (F.col("y") >= F.col("box.min_y")) & (F.col("y") <= F.col("box.max_y"))
    shut = nodes.join(boxes, "graph").where(inside).select("graph", "id").distinct()
    placed = placed_edges(nodes, edges)
    crossed = placed.join(boxes, "graph").where(segment_hits_box(F.col("pa"), F.col("pb"), F.col("box"))).select("graph", "a", "b").distinct()
    return nodes.join(shut, ["graph", "id"], "left_anti"), placed.join(crossed, ["graph", "a", "b"], "left_anti")


def usable_edges(edges: DataFrame, step_free: bool, least_clearance: float) -> DataFrame:
    """Step-free walkers take only edges known to be step-free and wide enough; an unknown clearance counts as too narrow."""
    return edges.where("step_free").where(F.coalesce(F.col("clearance") >= least_clearance, F.lit(False))) if step_free else edges


def portal_openings(portals: DataFrame, boxes: DataFrame, half_width: float) -> DataFrame:
    """portals: id, ax, ay, bx, by; boxes: id (of the portal), min_x, min_y, max_x, max_y. Per portal its length, the widest piece that the boxes, widened by half_width, leave open, and whether a body of twice half_width passes.

    The portal's ends are where the body's middle may be, so the opening is half_width wider on both sides. Each box covers an interval of the
    portal; the gaps between the running ends of the intervals are what is open."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    pairs = portals.withColumn("length", length).join(boxes, "id")

    def slab(a: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        still = F.abs(d) < 1e-12
        outside = still & ((a < low) | (a > high))
        enter = F.when(outside, 2.0).when(still, -1.0).otherwise(F.least((low - a) / F.when(still, 1.0).otherwise(d), (high - a) / F.when(still, 1.0).otherwise(d)))
        leave = F.when(outside, -2.0).when(still, 2.0).otherwise(F.greatest((low - a) / F.when(still, 1.0).otherwise(d), (high - a) / F.when(still, 1.0).otherwise(d)))
        return enter, leave

    (x0, x1), (y0, y1) = (slab(F.col(f"a{c}"), F.col(f"b{c}") - F.col(f"a{c}"), F.col(f"min_{c}") - half_width, F.col(f"max_{c}") + half_width) for c in "xy")
    covered = pairs.select("id", F.greatest(x0, y0, F.lit(0.0)).alias("s"), F.least(x1, y1, F.lit(1.0)).alias("e")).where("s <= e")
    marks = covered.unionByName(portals.select("id", F.lit(1.0).alias("s"), F.lit(1.0).alias("e")))  # the far end closes the last gap
    before = F.coalesce(F.max("e").over(Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    gaps = marks.select("id", F.greatest(F.lit(0.0), F.col("s") - before).alias("gap")).groupBy("id").agg(F.max("gap").alias("gap"))
    widest = portals.withColumn("length", length).join(gaps, "id").withColumn("widest", F.col("gap") * F.col("length"))
    return widest.select("id", "length", "widest", ((F.col("widest") > 0) | ((F.col("length") == 0) & (F.col("gap") > 0))).alias("passes"))


def _dijkstra(ahead: dict[int, list[tuple[float, int]]], source: int, targets: set[int]) -> dict[int, tuple[float, int]]:
    """Settled nodes with their cost and predecessor, until all targets are settled; equal costs settle the smaller node first."""
    done: dict[int, tuple[float, int]] = {}
    heap, left = [(0.0, source, source)], set(targets)
    while heap and left:
        cost, node, before = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = (cost, before)
        left.discard(node)
        for step, to in ahead.get(node, ()):
            if to not in done:
                heapq.heappush(heap, (cost + step, to, node))
    return done


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a frame can meet another that it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def routes(requests: DataFrame, edges: DataFrame, cost: str = "length", most_edges: int = MOST_EDGES, parts: int = PARTS) -> DataFrame:
    """request, graph, cost and path (node ids from source to target) of every request; both null if the target is out of reach. edges are directed (see graphs.both_ways); negative costs raise an error. Ids are whole numbers.

    A request whose graph has no edges reaches only its own source."""
    asked = requests.select("request", "graph", F.col("source").cast("long"), F.col("target").cast("long")).withColumn("part", F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int"))
    sizes = edges.groupBy("graph").agg(F.count("*").alias("n"), F.min(cost).alias("least"))
    wrong = sizes.where(F.col("least") < 0).limit(1).collect()
    if wrong:
        raise ValueError(f"graph {wrong[0]['graph']} has edges of negative cost")
    large = sizes.where(F.col("n") > most_edges).select("graph")
    if not large.isEmpty():
        beyond, rest = asked.join(large, "graph", "left_semi"), routes(requests.join(large, "graph", "left_anti"), edges.join(large, "graph", "left_anti"), cost, most_edges, parts)
        key = F.struct("graph", "source").alias("key")
        keys = materialize(beyond.select(key).distinct().withColumn("search", F.monotonically_increasing_id()))
        own = materialize(beyond.withColumn("key", key).join(keys, "key").drop("key"))
        found = searches.searches(edges.join(large, "graph", "left_semi").select("graph", F.col("a").cast("long"), F.col("b").cast("long"), F.col(cost).alias("length")), own.select("search", "graph", F.col("source").alias("id")))
        walked = searches.paths(found, own.select("search", "request", "target"))
        return rest.unionByName(own.select("request", "graph").join(walked, "request").select("request", "graph", "cost", "path"))
    dealt = edges.select("graph", F.col("a").cast("long"), F.col("b").cast("long"), F.col(cost).cast("double").alias("step")).join(asked.select("graph", "part").distinct(), "graph")
    kinds = requests.schema
    out = f"request {kinds['request'].dataType.simpleString()}, graph {kinds['graph'].dataType.simpleString()}, cost double, path array<bigint>"

    def run(key, asked: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        ahead: dict[int, list[tuple[float, int]]] = {}
        for a, b, step in zip(edges["a"].tolist(), edges["b"].tolist(), edges["step"].tolist(), strict=True):
            ahead.setdefault(a, []).append((step, b))
        rows = []
        for source, group in asked.groupby("source"):
            done = _dijkstra(ahead, int(source), set(group["target"].tolist()))
            for request, target in zip(group["request"], group["target"], strict=True):
                if target not in done:
                    rows.append((request, key[0], None, None))
                    continue
                path, at = [int(target)], int(target)
                while at != source:
                    at = done[at][1]
                    path.append(at)
                rows.append((request, key[0], done[target][0], path[::-1]))
        return pd.DataFrame(rows, columns=["request", "graph", "cost", "path"])

    return asked.groupBy("graph", "part").cogroup(_renewed(dealt).groupBy("graph", "part")).applyInPandas(run, out)


def hop_seconds(kind: Column, length: Column, speed: float) -> Column:
    return F.when(kind == "ELEVATOR", ELEVATOR_SECONDS).when(kind == "STAIRS", length / STAIRS_SPEED).otherwise(length / speed)


def building_edges(walks: DataFrame, hops: DataFrame, speed: float) -> DataFrame:
    """One graph of all floors in seconds: walks (graph, a, b, length) at the walker's speed, and hops (graph, a, b, length, kind) between landings by how long they take. A search over it is the search over legs and hops, as a leg is a shortest walk."""
    on_foot = walks.select("graph", "a", "b", "length", F.lit(None).cast("string").alias("kind"), (F.col("length") / speed).alias("seconds"))
    return on_foot.unionByName(hops.select("graph", "a", "b", "length", "kind", hop_seconds(F.col("kind"), F.col("length"), speed).alias("seconds")))


def assemble(found: DataFrame, nodes: DataFrame, edges: DataFrame, speed: float) -> tuple[DataFrame, DataFrame]:
    """(waypoints: request, at, node, x, y, z, floor, kind; summary: request, distance, seconds, transitions) of routes over building_edges.

    kind: START, DESTINATION, TRANSITION (the last point before a hop) or WAYPOINT."""
    steps = found.where("path IS NOT NULL").select("request", "graph", F.posexplode("path").alias("at", "node"))
    ordered = Window.partitionBy("request").orderBy("at")  # of one route
    steps = steps.withColumn("next", F.lead("node").over(ordered))
    best = edges.groupBy("graph", "a", "b").agg(F.min(F.struct("seconds", "length", "kind")).alias("e")).toDF("graph", "node", "next", "e")
    walked = steps.join(best, ["graph", "node", "next"], "left").join(nodes.select("graph", F.col("id").alias("node"), "x", "y", "z", "floor"), ["graph", "node"], "left")
    kind = F.when(F.col("at") == 0, "START").when(F.col("next").isNull(), "DESTINATION").when(F.col("e.kind").isNotNull(), "TRANSITION").otherwise("WAYPOINT")
    points = walked.select("request", "at", "node", "x", "y", "z", "floor", kind.alias("kind"))
    total = walked.groupBy("request").agg(F.sum("e.length").alias("distance"), F.sum("e.seconds").alias("seconds"), F.sum(F.col("e.kind").isNotNull().cast("int")).alias("transitions"))
    return points, total.select("request", F.coalesce("distance", F.lit(0.0)).alias("distance"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("transitions", F.lit(0)).alias("transitions"))


def _taut(start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """The shortest polyline from start to end that crosses all portals in order. Its corners are portal ends: from each point, the wedge that the next portals leave open shows which ends it sees, and the least way over them is taken."""
    n = len(left)
    stops = [(-1, start), *((i, p) for i in range(n) for p in (left[i], right[i])), (n, end)]
    best = [(np.inf, -1)] * len(stops)
    best[0] = (0.0, -1)
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    for k, (i, here) in enumerate(stops[:-1]):
        if not np.isfinite(best[k][0]):
            continue
        lo = hi = None  # right and left side of the wedge
        for j in range(i + 1, n + 1):
            ends = ((2 * j + 1, left[j]), (2 * j + 2, right[j])) if j < n else ((len(stops) - 1, end),)
            for m, p in ends:
                if (lo is None or cross(here, lo, p) >= -1e-12) and (hi is None or cross(here, hi, p) <= 1e-12):
                    way = best[k][0] + float(np.hypot(*(p[:2] - here[:2])))
                    if way < best[m][0] - 1e-12:
                        best[m] = (way, k)
            if j == n:
                break
            l, r = left[j], right[j]
            hi = l if hi is None or cross(here, hi, l) < 0 or np.allclose(hi[:2], here[:2]) else hi
            lo = r if lo is None or cross(here, lo, r) > 0 or np.allclose(lo[:2], here[:2]) else lo
            if cross(here, lo, hi) < -1e-12:
                break
    path, k = [], len(stops) - 1
    while k >= 0:
        path.append(stops[k][1])
        k = best[k][1]
    path = path[::-1]
    return [p for p, q in pairwise([*path, None]) if q is None or not np.allclose(p, q)]


def pull_tight(corridors: DataFrame) -> DataFrame:
    """corridors: route, at, lx, ly, rx, ry: portals in walking order with their left and right ends; the first and the last are start and end (left = right). route, length and path (array of x, y); a route is what one task folds."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        left, right = pdf[["lx", "ly"]].to_numpy(float), pdf[["rx", "ry"]].to_numpy(float)
        path = _taut(left[0], left[-1], left[1:-1], right[1:-1])
        length = float(sum(np.hypot(*(b - a)) for a, b in pairwise(path)))
        return pd.DataFrame({"route": [key[0]], "length": [length], "path": [[[float(x), float(y)] for x, y in path]]})

    kind = corridors.schema["route"].dataType.simpleString()
    return corridors.groupBy("route").applyInPandas(run, f"route {kind}, length double, path array<array<double>>")


def midpoints(corridors: DataFrame) -> DataFrame:
    """The way through the middle of every portal: never outside, seldom shortest."""
    x, y = (F.col("lx") + F.col("rx")) / 2, (F.col("ly") + F.col("ry")) / 2
    ordered = Window.partitionBy("route").orderBy("at")
    placed = corridors.select("route", "at", x.alias("x"), y.alias("y"))
    return placed.withColumn("step", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(ordered), F.col("y") - F.lag("y").over(ordered)), F.lit(0.0))).groupBy("route").agg(F.sum("step").alias("length"))


def visit_in_order(stops: DataFrame, costs: DataFrame) -> DataFrame:
    """stops: tour, at (0 is the start), stop; costs: tour, a, b, seconds, failure. Per stop, in order: reached or skipped with its failure, and the seconds from the last point that was reached. A tour (a dozen stops) is folded by one task; a pair without a row is NO_ROUTE."""

    def run(key, stops: pd.DataFrame, costs: pd.DataFrame) -> pd.DataFrame:
        known = {(a, b): (s, f) for a, b, s, f in zip(costs["a"], costs["b"], costs["seconds"], costs["failure"], strict=True)}
        stops, rows = stops.sort_values("at"), []
        here = stops["stop"].iloc[0] if len(stops) else None
        for at, stop in zip(stops["at"].tolist()[1:], stops["stop"].tolist()[1:], strict=True):
            seconds, failure = known.get((here, stop), (None, "NO_ROUTE"))
            reached = failure is None and seconds is not None
            rows.append((key[0], at, stop, reached, float(seconds) if reached else None, None if reached else failure or "NO_ROUTE"))
            here = stop if reached else here
        return pd.DataFrame(rows, columns=["tour", "at", "stop", "reached", "seconds", "failure"])

    kind = {c: stops.schema[c].dataType.simpleString() for c in ("tour", "at", "stop")}
    return stops.select("tour", "at", "stop").groupBy("tour").cogroup(_renewed(costs.select("tour", "a", "b", "seconds", "failure")).groupBy("tour")).applyInPandas(run, f"tour {kind['tour']}, at {kind['at']}, stop {kind['stop']}, reached boolean, seconds double, failure string")


def _held_karp(cost: np.ndarray) -> tuple[float, list[int]]:
    """The least way from stop 0 over all others; of equal ways the first in stop order."""
    n = len(cost)
    best: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {(1, 0): (0.0, (0,))}
    for _ in range(n - 1):
        step: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}
        for (seen, at), (c, path) in best.items():
            for to in range(1, n):
                if not seen >> to & 1 and np.isfinite(cost[at, to]):
                    value = (c + float(cost[at, to]), (*path, to))
                    if value < step.get((seen | 1 << to, to), (np.inf, ())):
                        step[seen | 1 << to, to] = value
        best = step
    total, path = min(best.values(), default=(np.inf, ()))
    return total, list(path)


def cheapest_orders(costs: DataFrame, starts: DataFrame, most: int = 12) -> DataFrame:
    """costs: tour, a, b, seconds; starts: tour, start. Per tour the stop order with the least total, exactly (dynamic programming over subsets); null if none visits all. More than `most` stops raise an error. One tour is one task's work."""
    kind = costs.schema["a"].dataType.simpleString()

    def run(key, costs: pd.DataFrame, starts: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(starts):
            return pd.DataFrame({"tour": [], "seconds": [], "stops": []})
        start = starts["start"].iloc[0]
        names = [start, *sorted({*costs["a"], *costs["b"]} - {start})]
        if len(names) > most + 1:
            raise ValueError(f"tour {key[0]}: {len(names) - 1} stops, at most {most}")
        place, cost = {x: i for i, x in enumerate(names)}, np.full((len(names), len(names)), np.inf)
        for a, b, s in zip(costs["a"], costs["b"], costs["seconds"], strict=True):
            cost[place[a], place[b]] = np.inf if s is None or np.isnan(s) else s
        total, path = _held_karp(cost)
        whole = np.isfinite(total)
        return pd.DataFrame({"tour": [key[0]], "seconds": [total if whole else None], "stops": [[names[i] for i in path] if whole else None]})

    tour = costs.schema["tour"].dataType.simpleString()
    return costs.select("tour", "a", "b", "seconds").groupBy("tour").cogroup(_renewed(starts.select("tour", "start")).groupBy("tour")).applyInPandas(run, f"tour {tour}, seconds double, stops array<{kind}>")


def nearest_by_route(ranked: DataFrame, distances: DataFrame, k: int) -> DataFrame:
    """The first k results by walking distance: those with a route first, then by straight line, then by rank. ranked: id, rank, straight; distances: id, walked."""
    both = ranked.join(distances, "id", "left").withColumn("by", F.when(F.col("walked").isNotNull(), "ROUTE").when(F.col("straight").isNotNull(), "STRAIGHT_LINE").otherwise("NOT_EVALUATED"))
    order = [F.when(F.col("by") == "ROUTE", 0).when(F.col("by") == "STRAIGHT_LINE", 1).otherwise(2), F.coalesce("walked", "straight").asc_nulls_last(), "rank", "id"]
    top = both.orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over k rows




def two_opt(stops: DataFrame, most: int = 500) -> DataFrame:
    """stops: tour, at (0 is the fixed start), stop, x, y. (tour, at, stop, length): the walk after turning round stretches of it as long as that shortens it, and its length; the end is free. A tour is one task's work; more than `most` stops raise an error."""

    def turned(xy: np.ndarray) -> tuple[np.ndarray, float]:
        d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
        order, n, better = np.arange(len(xy)), len(xy), True
        while better:
            better = False
            for i in range(1, n - 1):
                j = np.arange(i + 1, n)  # the stretch order[i..j] turned round
                old = d[order[i - 1], order[i]] + np.where(j + 1 < n, d[order[j], order[np.minimum(j + 1, n - 1)]], 0.0)
                new = d[order[i - 1], order[j]] + np.where(j + 1 < n, d[order[i], order[np.minimum(j + 1, n - 1)]], 0.0)
                gain = old - new
                if gain.max() > 1e-9:
                    k = int(j[gain.argmax()])
                    order[i : k + 1] = order[i : k + 1][::-1]
                    better = True
        return order, float(d[order[:-1], order[1:]].sum())

    def run(pdf: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        xy, way, at, length = pdf[["x", "y"]].to_numpy(float), np.arange(len(pdf)), np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
        for a, z in zip(begins, np.r_[begins[1:], len(pdf)], strict=True):
            if z - a > most:
                raise ValueError(f"tour {pdf['tour'].iloc[a]}: {z - a} stops, at most {most}")
            order, length[a:z] = turned(xy[a:z])
            way[a:z], at[a:z] = a + order, np.arange(z - a)
        return pd.DataFrame({"tour": pdf["tour"], "at": at, "stop": pdf["stop"].to_numpy()[way], "length": length})

    kind = {c: stops.schema[c].dataType.simpleString() for c in ("tour", "stop")}
    return in_groups(stops.select("tour", "at", "stop", "x", "y"), ["tour"], [F.asc_nulls_last("at"), F.asc_nulls_last("stop")], run, f"tour {kind['tour']}, at int, stop {kind['stop']}, length double")
