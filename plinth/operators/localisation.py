"""From boxes in an image to places in space: depth layers inside a box, and which of them the box shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graphs
from .spatial import placeable

#: Pixels of a z-buffer cell, the depth tolerance (metres, and share of the depth), the fewest points of a layer, and the share of the box's occupied cells that the shown layer has at least.
CELL_PX, BAND, BAND_SHARE, SUPPORT, COVERAGE = 16, 0.15, 0.05, 12, 0.25


def _band(depth: Column, band: float, share: float) -> Column:
    return F.lit(band) + F.lit(share) * depth


def localise(points: DataFrame, boxes: DataFrame, cell: int = CELL_PX, band: float = BAND, share: float = BAND_SHARE, support: int = SUPPORT, coverage: float = COVERAGE) -> DataFrame:
    """Where each box is: (frame, box, reason, x, y, z, points, depth, spread, coverage, layers, hidden).

    points: frame, id, px, py, depth, visible, x, y, z; boxes: frame, box, x0, y0, x1, y1 in pixels (upper ends not included). A visible point counts if it is not deeper than the nearest one of its pixel cell by more than the band. The points of a
    box that count, by depth, fall apart into layers where the next one is deeper by more than the band; a layer needs `support` points. The box shows its nearest layer that lies in `coverage` of the cells that its points are in: the medians of its
    points are the place, spread is 1.4826 times the median deviation of their depths. reason is null, or NO_DEPTH (no visible point in the box), INSUFFICIENT_DEPTH (no layer has enough points) or AMBIGUOUS_DEPTH (none covers enough); then there is no place.

    Boxes meet points by (frame, pixel cell), never all of a frame's. Points without finite numbers take no part; a box without an area has no depth."""
    seen = placeable(points, ("px", "py", "depth", "x", "y", "z")).where("visible").withColumns({"cu": F.floor(F.col("px") / cell), "cv": F.floor(F.col("py") / cell)})
    nearest = F.min("depth").over(Window.partitionBy("frame", "cu", "cv"))
    seen = seen.withColumn("front", F.col("depth") <= nearest + _band(nearest, band, share))
    upto = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    tiles = boxes.where("x1 > x0 AND y1 > y0").select("frame", "box", "x0", "y0", "x1", "y1", F.explode(upto("x0", "x1")).alias("cu")).withColumn("cv", F.explode(upto("y0", "y1")))
    inside = (F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y1"))
    held = graphs.materialize(tiles.join(seen, ["frame", "cu", "cv"]).where(inside).select("frame", "box", "id", "cu", "cv", "depth", "front", "x", "y", "z"))

    box = ["frame", "box"]
    totals = held.groupBy(*box).agg(F.count_if(~F.col("front")).alias("hidden"), F.countDistinct(F.when(F.col("front"), F.struct("cu", "cv"))).alias("occupied"))
    by_depth = Window.partitionBy(*box).orderBy("depth", "id")
    before = F.lag("depth").over(by_depth)
    apart = F.coalesce((F.col("depth") - before > _band(before, band, share)).cast("int"), F.lit(0))
    layered = held.where("front").withColumn("apart", apart).withColumn("layer", F.sum("apart").over(by_depth.rowsBetween(Window.unboundedPreceding, 0)))
    middle = lambda c: F.percentile(c, 0.5).alias(c)
    layers = layered.groupBy(*box, "layer").agg(F.count("*").alias("points"), F.countDistinct("cu", "cv").alias("cells"), middle("depth"), middle("x"), middle("y"), middle("z")).where(F.col("points") >= support)
    layers = layers.join(totals, box).withColumn("coverage", F.col("cells") / F.col("occupied"))
    row = F.struct("layer", "points", "depth", "x", "y", "z", "coverage")
    chosen = layers.groupBy(*box).agg(F.count("*").alias("layers"), F.min(F.when(F.col("coverage") >= coverage, row)).alias("shown"))
    chosen = graphs.materialize(chosen)
    shown = layered.join(chosen.where("shown IS NOT NULL").select(*box, F.col("shown.layer").alias("layer"), F.col("shown.depth").alias("middle")), [*box, "layer"])
    spread = shown.groupBy(*box).agg((1.4826 * F.percentile(F.abs(F.col("depth") - F.col("middle")), 0.5)).alias("spread"))
    out = boxes.select(*box).join(totals, box, "left").join(chosen, box, "left").join(spread, box, "left")
    reason = F.when(F.col("hidden").isNull(), "NO_DEPTH").when(F.col("layers").isNull(), "INSUFFICIENT_DEPTH").when(F.col("shown").isNull(), "AMBIGUOUS_DEPTH")
    return out.select(*box, reason.alias("reason"), *[F.col(f"shown.{c}").alias(c) for c in ("x", "y", "z", "points", "depth")], "spread", F.col("shown.coverage").alias("coverage"), F.coalesce("layers", F.lit(0)).alias("layers"), F.coalesce("hidden", F.lit(0)).alias("hidden"))
