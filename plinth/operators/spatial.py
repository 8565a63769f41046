"""Spatial joins and point-cloud operators: cell equi-joins with an exact test behind them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product
from math import sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_polygon
from . import graphs
from .relational import in_groups

AXES = ("x", "y", "z")


def _cells(axes: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("long").alias(f"c_{a}") for a in axes]


def _spread(df: DataFrame, axes: Sequence[str], size: float, reach: int = 1) -> DataFrame:
    """Every point once for each cell within `reach` of its own."""
    moves = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, move, strict=True)]) for move in product(range(-reach, reach + 1), repeat=len(axes))])
    return df.withColumn("__m", F.explode(moves)).select(df["*"], *[(F.floor(F.col(a) / size) + F.col(f"__m.{a}")).cast("long").alias(f"c_{a}") for a in axes])


def radius_pairs(a: DataFrame, b: DataFrame, radius: float, axes: Sequence[str] = AXES, keep: Sequence[str] = ()) -> DataFrame:
    """(a_id, b_id, distance, kept columns of both) within radius. The smaller side should be `a`: its points are what is spread over neighbouring cells. Cells a third of the points fall into are split by AQE."""
    left = _spread(a.select(F.col("id").alias("a_id"), *axes, *[F.col(k).alias(f"a_{k}") for k in keep]), axes, radius)
    right = b.select(F.col("id").alias("b_id"), *[F.col(x).alias(f"b_{x}") for x in axes], *[F.col(k).alias(f"b_{k}") for k in keep], *_cells(axes, radius))
    square = sum(((F.col(x) - F.col(f"b_{x}")) * (F.col(x) - F.col(f"b_{x}")) for x in axes), F.lit(0.0))
    joined = left.join(right, [f"c_{x}" for x in axes]).withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius)
    return joined.select("a_id", "b_id", "distance", *[f"{s}_{k}" for s in "ab" for k in keep])


def neighbour_counts(points: DataFrame, radius: float, axes: Sequence[str] = AXES) -> DataFrame:
    """(id, n): points within radius, itself included."""
    return radius_pairs(points, points, radius, axes).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"))


def nearest(a: DataFrame, b: DataFrame, bound: float, axes: Sequence[str] = AXES, index: Index | None = None) -> DataFrame:
    """(id, b_id, distance) for every a: its nearest b within bound, nulls where there is none; ties take the smaller id. The search begins with the radius of the density, so its work does not grow with the pairs within bound. index: that of b, if it is asked often."""
    found = _search(a, index or indexed(b, 1, axes), 1, axes, 40, False, bound)
    best = found.groupBy("id").agg(F.min(F.struct("distance", "b_id")).alias("n"))
    return a.select("id").join(best, "id", "left").select("id", F.col("n.b_id").alias("b_id"), F.col("n.distance").alias("distance"))


def placeable(points: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Points with finite coordinates only."""
    for x in axes:
        points = points.where(F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.col(x).cast("double")))
    return points


def first_radius(points: DataFrame, k: int, axes: Sequence[str] = AXES) -> float:
    """A radius within which most points have k others: from the box around the points and from how many cells of it they occupy, which tells surfaces and clusters from a filled volume."""
    m = points.agg(F.count("*").alias("n"), *[(F.max(x) - F.min(x)).cast("double").alias(x) for x in axes]).first()
    sides = [m[x] for x in axes if m["n"] and m[x] > 0]
    if not sides:
        return 1.0
    size = float(np.prod(sides) * k / m["n"]) ** (1 / len(sides))
    held = m["n"] / points.select(*_cells(axes, size)).distinct().count()
    return size * min(4.0, max(0.5, sqrt(2 * k / held)))


#: Distances that one step of a search holds, rows that a task takes at once (a block is never cut), and how many points a block should have at most, as most points see it.
STEP_PAIRS, STEP_ROWS, BLOCK_POINTS = 500_000, 60_000, 20_000
#: Candidates per neighbour from which a smaller radius is tried first, and how much smaller.
CROWD, FINER = 12, sqrt(2)
#: What cells and rims are wider than the radius, so that rounded coordinates do not matter.
SLACK = 1 + 1e-6
#: Blocks begin off the origin by this part of their edge: floors and walls often lie on the axes.
SHIFT = 0.37
#: Radii that a block is wide in the first round.
WIDE = 16.0


class _Blocks:
    """The points a (here) and b (there, in the order of their ids) of some blocks of a width, looked up by cells. Each point has its coordinates, its block's number and its place in the block, from the block's lower corner."""

    def __init__(self, here: tuple[np.ndarray, np.ndarray, np.ndarray], there: tuple[np.ndarray, np.ndarray, np.ndarray], width: float, most: int):
        self.here, self.here_block, self.here_place = here
        self.there, self.there_block, self.there_place = there
        self.width, self.most = width, most
        self.answers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _keys(self, place: np.ndarray, block: np.ndarray, edge: float, shift: tuple[int, ...] = ()) -> np.ndarray:
        side = int(np.ceil(self.width / edge)) + 4
        key = block
        for axis in range(place.shape[1]):
            step = np.floor(place[:, axis] / edge).astype(np.int64) + 2  # two cells of margin for the shifts
            key = key * side + step + (shift[axis] if shift else 0)
        return key

    def search(self, rows: np.ndarray, radius: float, levels: int) -> np.ndarray:
        """Answers the rows whose `most` nearest lie within radius and returns the others. Crowded rows try a smaller radius first."""
        if not len(rows):
            return rows
        edge = radius * SLACK
        keys = self._keys(self.there_place, self.there_block, edge)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        place, block, axes = self.here_place[rows], self.here_block[rows], self.here.shape[1]
        low, high = [], []
        for shift in product((-1, 0, 1), repeat=axes - 1):  # the three cells along the last axis follow each other
            key = self._keys(place, block, edge, (*shift, 0))
            low.append(np.searchsorted(keys, key - 1, "left"))
            high.append(np.searchsorted(keys, key + 1, "right"))
        low, size, sorted_there = np.stack(low, 1), np.stack(high, 1) - np.stack(low, 1), self.there[order].T.copy()
        count = size.sum(1)
        crowded = (count > CROWD * self.most) & (levels > 0)
        missed = self.search(rows[crowded], radius / FINER, levels - 1)
        again = np.isin(rows, missed, assume_unique=True) if len(missed) else np.zeros(len(rows), bool)
        todo = np.flatnonzero((count >= self.most) & (~crowded | again))
        todo = todo[np.argsort(count[todo], kind="stable")]
        open_rows, start = [rows[count < self.most]], 0
        while start < len(todo):
            ahead = count[todo[start : start + STEP_PAIRS // self.most]]  # ascending, and the table is as wide as the last
            end = start + max(1, int(np.searchsorted(ahead * np.arange(1, len(ahead) + 1), STEP_PAIRS, "right")))
            part, start = todo[start:end], end
            open_rows.append(rows[part[~self._take(rows[part], low[part], size[part], order, sorted_there, radius)]])
        return np.concatenate(open_rows)

    def _take(self, rows: np.ndarray, low: np.ndarray, size: np.ndarray, order: np.ndarray, sorted_there: np.ndarray, radius: float) -> np.ndarray:
        """Keeps the answers among the candidates low : low + size of each row, places in cell order, and tells which rows have one."""
        flat, count = size.ravel(), size.sum(1)
        before = np.cumsum(flat) - flat
        found = np.arange(flat.sum()) + np.repeat(low.ravel() - before, flat)
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(rows)), count)
        square = np.zeros(len(found))
        for axis in range(self.here.shape[1]):
            gap = self.here[rows, axis][owner] - sorted_there[axis][found]
            square += gap * gap
        distance, column = np.sqrt(square), np.arange(len(found)) - first[owner]
        table = np.full((len(rows), int(count.max())), np.inf)
        table[owner, column] = distance
        last = np.partition(table, self.most - 1, axis=1)[:, self.most - 1]
        good = last <= radius
        kept = np.flatnonzero((distance <= last[owner]) & good[owner])
        found = order[found[kept]]
        turn = np.lexsort((found, distance[kept], owner[kept]))
        kept, found = kept[turn], found[turn]
        mine = owner[kept]
        begins = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, int)
        place = np.arange(len(mine)) - np.repeat(begins, np.diff(np.r_[begins, len(mine)]))
        nearest = place < self.most
        self.answers.append((rows[good], found[nearest].reshape(-1, self.most), distance[kept[nearest]].reshape(-1, self.most)))
        return good


def _answer(rows: pa.Table, axes: Sequence[str], edge: float, radius: float, most: int, summary: bool) -> Iterator[pa.Table]:
    """The answers of whole blocks, given as rows of a (side 0, id) and b (side 1, b_id) in the order of their cells."""
    cells = np.stack([rows.column(f"c_{x}").to_numpy() for x in axes], 1)
    block = np.cumsum(np.r_[False, (cells[1:] != cells[:-1]).any(axis=1)]).astype(np.int64)
    at = np.stack([rows.column(x).to_numpy() for x in axes], 1)
    place, is_b = at - ((cells - SHIFT) * edge - radius * SLACK), rows.column("side").to_numpy() == 1
    here, there = np.flatnonzero(~is_b), np.flatnonzero(is_b)
    there = there[pc.sort_indices(rows.column("b_id").take(pa.array(there))).to_numpy()]
    row, ids, b_ids = rows.column("row").take(pa.array(here)), rows.column("id").take(pa.array(here)), rows.column("b_id").take(pa.array(there))
    work = _Blocks(*[(at[x], block[x], place[x]) for x in (here, there)], edge + 2 * radius * SLACK, most)
    # smaller radii that keep cells above the rounding of coordinates, and keys within 62 bits
    rounding, sides = 1e-8 * float(np.abs(at).max()), (2.0**62 / (block[-1] + 1)) ** (1 / len(axes)) - 5
    work.search(np.arange(len(here)), radius, int(max(0, min(24, *[np.log(x) / np.log(FINER) for x in (sides * radius / work.width, *([radius / rounding] if rounding else []))]))))
    for own, found, distance in work.answers:
        if summary:
            yield pa.table({"row": row.take(pa.array(own)), "id": ids.take(pa.array(own)), "mean_distance": distance.mean(axis=1)})
        else:
            rank = np.tile(np.arange(1, most + 1, dtype=np.int32), len(own))
            own = pa.array(np.repeat(own, most))
            yield pa.table({"row": row.take(own), "id": ids.take(own), "b_id": b_ids.take(pa.array(found.ravel())), "distance": distance.ravel(), "rank": rank})


class Index(NamedTuple):
    """What a search needs of b: its points, how many (at most k), and the radius to begin with."""

    points: DataFrame
    most: int
    radius: float


def indexed(b: DataFrame, k: int, axes: Sequence[str] = AXES, start: float | None = None) -> Index:
    there = graphs.materialize(placeable(b, axes).select(F.col("id").alias("b_id"), *[F.col(x).cast("double").alias(x) for x in axes]))
    most = min(k, there.count())
    if not most:
        return Index(there, 0, 1.0)
    radius = start or first_radius(there.withColumnRenamed("b_id", "id"), k, axes)
    for _ in range(40):  # a smaller radius where most points, or those of one place, share large blocks
        full = there.groupBy(*[F.floor(F.col(x) / (WIDE * radius)) for x in axes]).agg(F.count("*").cast("double").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("usual"), F.max("n").alias("most")).first()
        if full["usual"] <= BLOCK_POINTS and full["most"] <= 10 * BLOCK_POINTS:
            break
        radius /= 2
    return Index(there, most, radius)


def _search(a: DataFrame, index: Index, k: int, axes: Sequence[str], rounds: int, summary: bool, bound: float | None = None) -> DataFrame:
    """With a bound, the radius ends there, and points that have fewer than k neighbours within it have no rows."""
    there, most, radius = index
    kind, b_kind = a.schema["id"].dataType.simpleString(), there.schema["b_id"].dataType.simpleString()
    todo, found = graphs.materialize(placeable(a, axes).select(F.monotonically_increasing_id().alias("row"), "id", *[F.col(x).cast("double").alias(x) for x in axes])), []
    schema = f"row long, id {kind}, mean_distance double" if summary else f"row long, id {kind}, b_id {b_kind}, distance double, rank int"
    if not most:
        return todo.sparkSession.createDataFrame([], schema).drop("row")
    wide, left, cells = WIDE, todo.count(), [f"c_{x}" for x in axes]
    radius = radius if bound is None else min(radius, bound)

    def search(edge: float, radius: float):
        def run(batches: Iterator[pa.RecordBatch]):
            held = None
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                held = rows if held is None else pa.concat_tables([held, rows])
                if held.num_rows < STEP_ROWS:
                    continue
                at = np.stack([held.column(c).to_numpy() for c in cells], 1)
                other = np.flatnonzero((at != at[-1]).any(axis=1))
                cut = int(other[-1]) + 1 if len(other) else 0  # the last block may go on in the next batch
                if cut:
                    for made in _answer(held.slice(0, cut), axes, edge, radius, most, summary):
                        yield from made.to_batches(100_000)
                    held = held.slice(cut)
            if held is not None and held.num_rows:
                for made in _answer(held, axes, edge, radius, most, summary):
                    yield from made.to_batches(100_000)

        return run

    for n in range(rounds):
        edge, rim = wide * radius, radius * SLACK
        asked = todo.select("row", "id", F.lit(None).cast(b_kind).alias("b_id"), F.lit(0).alias("side"), *axes, *[F.floor(F.col(x) / edge + SHIFT).alias(c) for x, c in zip(axes, cells, strict=True)])
        spread = there.select(F.lit(None).cast("long").alias("row"), F.lit(None).cast(kind).alias("id"), "b_id", F.lit(1).alias("side"), *axes)
        for x, c in zip(axes, cells, strict=True):
            spread = spread.withColumn(c, F.explode(F.sequence(F.floor((F.col(x) - rim) / edge + SHIFT), F.floor((F.col(x) + rim) / edge + SHIFT))))
        if n:
            spread = spread.join(asked.select(*cells).distinct(), cells, "left_semi").select(*asked.columns)
        parts = min(20_000, 8 + left // 10_000)  # by number, as few bytes take much time here
        rows = asked.unionByName(spread).repartition(parts, *cells).sortWithinPartitions(*cells)
        found.append(graphs.materialize(rows.mapInArrow(search(edge, radius), schema)))
        todo = graphs.materialize(todo.join((found[-1] if summary else found[-1].where("rank = 1")).select("row"), "row", "left_anti"))
        left = todo.count()
        if not left or radius == bound:
            return reduce(DataFrame.unionByName, found).drop("row")
        wide, radius = max(2.0, wide / 2), radius * (2 if n < 2 else 4)
        radius = radius if bound is None else min(radius, bound)
    raise RuntimeError(f"no {k} neighbours within {radius}")


def k_nearest(a: DataFrame, b: DataFrame, k: int, start: float | None = None, axes: Sequence[str] = AXES, rounds: int = 40) -> DataFrame:
    """(id, b_id, distance, rank) of the k nearest b of every a, a itself included if it is in b; ties take the smaller id. start: the first radius, by default from the density. Points without finite coordinates have no neighbours and are none. Null and repeated ids are points like others; among b, null ids come last in ties.

    Space is cut into blocks up to sixteen radii wide. A task has the a of its blocks and the b of each block and of a rim one radius wide around it, and looks neighbours up in cells, smaller ones where it is crowded; it answers the points that have k b within the radius, which no b beyond the rim can change. The radius grows for the rest, and only blocks with such points go on, so the answer is exact. A place where many b share a few coordinates is one block."""
    return _search(a, indexed(b, k, axes, start), k, axes, rounds, False)


def mean_distances(a: DataFrame, b: DataFrame, k: int, start: float | None = None, axes: Sequence[str] = AXES, rounds: int = 40) -> DataFrame:
    """(id, mean_distance): the mean of the k distances of k_nearest, taken where they are found."""
    return _search(a, indexed(b, k, axes, start), k, axes, rounds, True)


def median_spacing(points: DataFrame, start: float | None = None, axes: Sequence[str] = AXES, sample: int = 20_000) -> DataFrame:
    """Median distance to the nearest other point, over a hash-ordered sample of points against all."""
    probe = points.orderBy(F.xxhash64("id"), "id").limit(sample)
    near = k_nearest(probe, points, 2, start, axes).where("rank = 2")
    return near.agg(F.percentile("distance", 0.5).alias("spacing"))


def statistical_outliers(points: DataFrame, k: int, sigmas: float, start: float | None = None, axes: Sequence[str] = AXES) -> DataFrame:
    """(id, mean_distance, keep): mean distance of the k nearest, itself included, at most mean + sigmas * population deviation."""
    means = graphs.materialize(mean_distances(points, points, k, start, axes))
    limit = means.agg((F.avg("mean_distance") + sigmas * F.stddev_pop("mean_distance")).alias("limit"))
    return means.crossJoin(F.broadcast(limit)).select("id", "mean_distance", (F.col("mean_distance") <= F.col("limit")).alias("keep"))


def radius_outliers(points: DataFrame, radius: float, least: int, axes: Sequence[str] = AXES) -> DataFrame:
    return neighbour_counts(points, radius, axes).select("id", "n", (F.col("n") >= least).alias("keep"))


def adaptive_threshold(counts: DataFrame, share: float, cap: int) -> DataFrame:
    """min(cap, max(3, ceil(share * median count)))."""
    return counts.agg(F.least(F.lit(cap), F.greatest(F.lit(3), F.ceil(share * F.percentile("n", 0.5)))).cast("int").alias("threshold"))


def floaters(points: DataFrame, radius: float, least: int, axes: Sequence[str] = AXES) -> DataFrame:
    """(id, component, size, keep): components of the radius graph with fewer than `least` points float."""
    edges = radius_pairs(points, points, radius, axes).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    label = graphs.components(points.select("id"), edges)
    size = label.groupBy("component").agg(F.count("*").alias("size"))
    return label.join(size, "component").select("id", "component", "size", (F.col("size") >= least).alias("keep"))


def clutter_mask(points: DataFrame, radius: float, least: int, label: str = "label", axes: Sequence[str] = AXES) -> DataFrame:
    """keep is false for clutter with fewer than `least` clutter neighbours (itself not counted)."""
    own = points.where(F.col(label) == "clutter")
    counts = neighbour_counts(own, radius, axes).select("id", (F.col("n") - 1).alias("near"))
    return points.select("id", label).join(counts, "id", "left").select("id", (F.coalesce(F.col(label) != "clutter", F.lit(True)) | (F.col("near") >= least)).alias("keep"))


def voxel_downsample(points: DataFrame, size: float, axes: Sequence[str] = AXES) -> DataFrame:
    """Centroid of each voxel."""
    return points.groupBy(*_cells(axes, size)).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in axes])


def lowest_dense_band(points: DataFrame, cell: float, k: int, height: float) -> DataFrame:
    """(c_x, c_y, z): per column of cells, the lowest z from which k points lie within height; a stray point below does not count."""
    w = Window.partitionBy("c_x", "c_y").orderBy("z", "id")
    banded = points.select("id", "z", *_cells(("x", "y"), cell)).withColumn("top", F.lead("z", k - 1).over(w))
    return banded.where(F.col("top") - F.col("z") <= height).groupBy("c_x", "c_y").agg(F.min("z").alias("z"))


def changes(before: DataFrame, after: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """One row: points added and removed beyond tolerance, change ratio, changed area (distinct ground cells), largest bounded deviation."""
    added = nearest(after, before, tolerance).where("b_id IS NULL").select("id").join(after, "id").select("x", "y", F.lit("added").alias("kind"))
    removed = nearest(before, after, tolerance).where("b_id IS NULL").select("id").join(before, "id").select("x", "y", F.lit("removed").alias("kind"))
    moved = graphs.materialize(added.unionByName(removed))
    totals = before.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after")))
    counts = moved.agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"), (F.count_distinct(F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)) * cell * cell).alias("area"))
    return counts.crossJoin(totals).select("added", "removed", "area", F.coalesce((F.col("added") + F.col("removed")) / F.nullif(F.col("n_before") + F.col("n_after"), F.lit(0)), F.lit(0.0)).alias("ratio"), (F.col("n_before") == 0).alias("empty_before"), (F.col("n_after") == 0).alias("empty_after"))


def points_in_regions(points: DataFrame, regions: DataFrame, cell: float) -> DataFrame:
    """(id, region): regions (region, ring) cover the cells of their bounding box, then the exact test; no pair outside a shared cell is made."""
    low = lambda a: F.floor(F.array_min(F.transform("ring", lambda v: v[a])) / cell).cast("long")
    high = lambda a: F.floor(F.array_max(F.transform("ring", lambda v: v[a])) / cell).cast("long")
    covered = regions.withColumn("c_x", F.explode(F.sequence(low("x"), high("x")))).withColumn("c_y", F.explode(F.sequence(low("y"), high("y"))))
    joined = points.select("id", "x", "y", *_cells(("x", "y"), cell)).join(covered, ["c_x", "c_y"])
    return joined.where(in_polygon(F.col("x"), F.col("y"), F.col("ring"))).select("id", "region")


def front_surface(points: DataFrame, band: float) -> DataFrame:
    """points: id, u, v (pixel cell), depth. Those within band of their pixel's nearest depth."""
    near = points.groupBy("u", "v").agg(F.min("depth").alias("front"))
    return points.join(near, ["u", "v"]).where(F.col("depth") <= F.col("front") + band).drop("front")


def voxel_owner(points: DataFrame, size: float) -> DataFrame:
    """points: id, capture, depth, x, y, z. Each voxel belongs to the capture with the deepest footprint there, the smallest capture on ties."""
    cells = [f"c_{a}" for a in AXES]
    placed = points.withColumns({f"c_{a}": F.floor(F.col(a) / size).cast("long") for a in AXES})
    owner = placed.groupBy(*cells).agg(F.max(F.struct("depth", (-F.col("capture")).alias("k"))).alias("o")).select(*cells, (-F.col("o.k")).alias("capture"))
    return placed.join(owner, [*cells, "capture"], "left_semi").select("id", "capture")


def cluster_by_label(detections: DataFrame, reach: float) -> DataFrame:
    """(id, label, cluster): greedy clustering per label in the order (confidence descending, id): a detection joins the nearest cluster whose running centroid is within reach, or opens one. cluster is the id of the detection that opened it.

    A centroid always has a member within reach, so a detection can only meet clusters that have a member within 2 * reach of it. Such members lie in the same or a touching cell of that width, so detections whose occupied cells no chain
    of touching cells connects are folded apart, each connected set in one task, which holds its centroids. Work before the folds goes with the detections and the cells they occupy, not with pairs of detections. Without a label each detection is a cluster."""
    rows = placeable(detections).select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "confidence", *[F.col(a).cast("double").alias(a) for a in AXES])
    width, at = 2 * reach * SLACK, ["label", *[f"c_{a}" for a in AXES]]
    rows = graphs.materialize(rows.where("id IS NOT NULL").withColumns({f"c_{a}": F.floor(F.col(a) / width).cast("long") for a in AXES}))
    cells = graphs.materialize(rows.where("label IS NOT NULL").groupBy(*at).agg(F.min("id").alias("cell")))
    around = _spread(cells.select("label", F.col("cell").alias("a"), *[((F.col(f"c_{a}") + 0.5) * width).alias(a) for a in AXES]), AXES, width)
    touching = around.join(cells.select(*at, F.col("cell").alias("b")), at).where("a < b").select("a", "b")
    sets = cells.join(graphs.components(cells.select(F.col("cell").alias("id")), touching).withColumnRenamed("id", "cell"), "cell").select(*at, "component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "id"], ascending=[False, True], kind="stable")
        centres, counts, names, out = np.zeros((len(pdf), 3)), np.zeros(len(pdf)), [], []
        for name, p in zip(pdf["id"].tolist(), pdf[list(AXES)].to_numpy(float), strict=True):
            n = len(names)
            distance = np.sqrt(((centres[:n] - p) ** 2).sum(axis=1))
            c = int(distance.argmin()) if n and distance.min() <= reach else n
            if c == n:
                names.append(name)
            centres[c] = (centres[c] * counts[c] + p) / (counts[c] + 1)
            counts[c] += 1
            out.append(names[c])
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "label": pdf["label"].to_numpy(), "cluster": out})

    whole = rows.join(sets, at, "left").select("id", "label", "confidence", *AXES, F.coalesce("component", "id").alias("component"))
    return whole.groupBy("label", "component").applyInPandas(lambda pdf: run(pdf), "id long, label string, cluster long")


def merge_boxes(boxes: DataFrame, overlap: float = 0.3) -> DataFrame:
    """Per frame, largest first: a box that overlaps a merged one by more than `overlap` (IoU) widens it to their union."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(area=pdf["w"] * pdf["h"]).sort_values(["area", "id"], ascending=[False, True], kind="stable")
        merged: list[list[float]] = []
        for x, y, w, h in pdf[["x", "y", "w", "h"]].to_numpy(float):
            for m in merged:
                ix, iy = min(m[2], x + w) - max(m[0], x), min(m[3], y + h) - max(m[1], y)
                shared = max(ix, 0) * max(iy, 0)
                if shared / ((m[2] - m[0]) * (m[3] - m[1]) + w * h - shared) > overlap:
                    m[:] = [min(m[0], x), min(m[1], y), max(m[2], x + w), max(m[3], y + h)]
                    break
            else:
                merged.append([x, y, x + w, y + h])
        return pd.DataFrame([(pdf["frame"].iloc[0], i, m[0], m[1], m[2] - m[0], m[3] - m[1]) for i, m in enumerate(merged)], columns=["frame", "box", "x", "y", "w", "h"])

    return boxes.select("id", F.col("frame").cast("long").alias("frame"), "x", "y", "w", "h").groupBy("frame").applyInPandas(run, "frame long, box int, x double, y double, w double, h double")


def match_detections(found: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy one-to-one matching per (image, class), best score first: hit if a free truth box overlaps by at least `least`."""
    score = F.col("score").cast("double")
    f = found.select("image", "class", F.lit(1).alias("side"), "id", F.when(~F.isnan(score), score).alias("score"), "x", "y", "w", "h")
    t = truth.select("image", "class", F.lit(0).alias("side"), "id", F.lit(0.0).alias("score"), "x", "y", "w", "h")

    def hits(truth: np.ndarray, found: np.ndarray) -> list[bool]:
        free, out = np.ones(len(truth), bool), []
        for x, y, w, h in found:
            best = -1
            if free.any():
                ix = np.clip(np.minimum(truth[:, 0] + truth[:, 2], x + w) - np.maximum(truth[:, 0], x), 0, None)
                iy = np.clip(np.minimum(truth[:, 1] + truth[:, 3], y + h) - np.maximum(truth[:, 1], y), 0, None)
                iou = np.where(free, ix * iy / (truth[:, 2] * truth[:, 3] + w * h - ix * iy), -1)
                best = int(iou.argmax()) if iou.max() >= least else -1
            if best >= 0:
                free[best] = False
            out.append(best >= 0)
        return out

    def run(pdf: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        boxes, of_found, hit = pdf[["x", "y", "w", "h"]].to_numpy(float), pdf["side"].to_numpy() == 1, np.zeros(len(pdf), bool)
        for a, z in zip(begins, np.r_[begins[1:], len(pdf)], strict=True):
            middle = a + int((~of_found[a:z]).sum())  # the truth comes first
            hit[middle:z] = hits(boxes[a:middle], boxes[middle:z])
        return pdf[["image", "class", "id"]].assign(hit=hit)[of_found].astype({c: "int64" for c in ("image", "class", "id")})

    both = f.unionByName(t).select(*[F.col(c).cast("long").alias(c) for c in ("image", "class", "id")], "side", "score", "x", "y", "w", "h")
    return in_groups(both, ["image", "class"], [F.col("side"), F.desc_nulls_last("score"), F.col("id")], run, "image long, class long, id long, hit boolean")


def _score_planes(points: DataFrame, planes: np.ndarray, tolerance: float, rows: int = 2000) -> dict[int, int]:
    """Points within tolerance of each plane (a, b, c, d), counted in slices of `rows` points against all planes; a row per plane and task comes together."""

    def run(batches):
        counts = np.zeros(len(planes), np.int64)
        for pdf in batches:
            xyz = pdf.to_numpy(float)
            for at in range(0, len(xyz), rows):
                x, y, z = (xyz[at : at + rows, [i]] for i in range(3))
                counts += (np.abs(x * planes[:, 0] + y * planes[:, 1] + z * planes[:, 2] + planes[:, 3]) <= tolerance).sum(axis=0)
        yield pd.DataFrame({"plane": np.arange(len(planes)), "n": counts})

    scored = points.select(*AXES).mapInPandas(run, "plane long, n long").groupBy("plane").agg(F.sum("n").alias("n"))
    return {r["plane"]: r["n"] for r in scored.collect()}


def _refit(inliers: DataFrame) -> np.ndarray:
    """The least-squares plane (a, b, c, d) of points: moments from one pass, the least axis on the driver."""
    m = inliers.agg(*[F.avg(a).alias(a) for a in AXES], *[F.covar_pop(a, b).alias(a + b) for a in AXES for b in AXES]).first()
    n = np.linalg.eigh(np.array([[m[a + b] for b in AXES] for a in AXES]))[1][:, 0]
    n = n * (1 if n[np.abs(n).argmax()] > 0 else -1)
    return np.array([*n, -float(n @ np.array([m[a] for a in AXES]))])


def fit_planes(points: DataFrame, tolerance: float, max_planes: int, min_inliers: int, hypotheses: int = 1000, seed: int = 7) -> DataFrame:
    """RANSAC of several planes: (plane, a, b, c, d, id), a row per inlier. Seeded triples of a bounded hash-ordered sample make the hypotheses; the one with most inliers is taken, its inliers leave the cloud, and new hypotheses are drawn from the rest, until max_planes are found or the next has fewer than min_inliers. The plane returned is the least-squares one of its inliers. Points without finite coordinates belong to none."""
    left = graphs.materialize(points.select("id", *[F.col(a).cast("double").alias(a) for a in AXES]).where(" AND ".join(f"abs({a}) < double('Infinity')" for a in AXES)))
    found = left.limit(0).select(F.lit(0).alias("plane"), *[F.lit(0.0).alias(c) for c in "abcd"], "id")
    for k in range(max_planes):
        sample = np.array([[r[a] for a in AXES] for r in left.orderBy(F.xxhash64("id", F.lit(seed + k)), "id").limit(3 * hypotheses).collect()])
        if len(sample) < max(3, min(min_inliers, 3 * hypotheses)):
            break
        rng = np.random.default_rng(seed + k)
        p, q, r = (sample[i] for i in np.array([rng.choice(len(sample), 3, replace=False) for _ in range(hypotheses)]).T)
        normals = np.cross(q - p, r - p)
        length = np.linalg.norm(normals, axis=1)
        normals, p = normals[length > 1e-12] / length[length > 1e-12, None], p[length > 1e-12]
        if not len(normals):
            break
        planes = np.column_stack([normals, -(normals * p).sum(axis=1)])
        counts = _score_planes(left, planes, tolerance)
        best = max(counts, key=lambda h: (counts[h], -h))
        if counts[best] < min_inliers:
            break
        a, b, c, d = map(float, planes[best])
        near = F.abs(F.col("x") * a + F.col("y") * b + F.col("z") * c + d) <= tolerance
        inliers = left.where(near)
        fitted = [F.lit(float(v)).alias(name) for v, name in zip(_refit(inliers), "abcd", strict=True)]
        found = found.unionByName(inliers.select(F.lit(k).alias("plane"), *fitted, "id"))
        left = graphs.materialize(left.where(~near))
    return found


def similarity_fit(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and move that take (x, y, z) to (u, v, w) with the least squares: sixteen moments from one pass, then a 3 x 3 SVD on the driver."""
    names, targets = ("x", "y", "z"), ("u", "v", "w")
    moments = [F.avg(c).alias(c) for c in names + targets] + [F.avg(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in names for b in targets] + [F.avg(sum((F.col(a) * F.col(a) for a in names), F.lit(0.0))).alias("square")]
    m = pairs.agg(*moments).first()
    p, q = np.array([m[c] for c in names]), np.array([m[c] for c in targets])
    cross = np.array([[m[f"{a}{b}"] for a in names] for b in targets]) - np.outer(q, p)
    u, s, vt = np.linalg.svd(cross)
    sign = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    rotation = u @ sign @ vt
    scale = float((s * np.diag(sign)).sum() / (m["square"] - p @ p))
    return scale, rotation, q - scale * rotation @ p
