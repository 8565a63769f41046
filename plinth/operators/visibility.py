"""What a camera sees from a place, and which places to choose: rays exploded into the cells they cross, and lazy greedy selection.

Cells are (scene, i, j) with two flags: target (worth seeing) and blocked. Cells that are not in the table neither block nor count.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs

#: Fixed value: the share of a view's quality that is lost at the edge of the field of view.
EDGE_LOSS = 0.5
#: Candidates whose gains are computed at a time.
HEAD = 16


def _crossed(di: Column, dj: Column) -> Column:
    """The steps of a straight line from (0, 0) to (di, dj), of one cell each along the longer side; the shorter side is rounded, halves toward the start.
    Structs (k, i, j, weight): the cell before the end has weight 2; where a step is diagonal, the two cells that touch its corner have 1 each."""
    n, m = F.greatest(F.abs(di), F.abs(dj)), F.least(F.abs(di), F.abs(dj))
    wide = F.abs(di) >= F.abs(dj)
    aside = lambda k: F.floor((2 * k * m + n - 1) / (2 * n))

    def place(k: Column, a: Column, b: Column, weight: int) -> Column:
        along, across = F.signum(F.when(wide, di).otherwise(dj)).cast("long") * a, F.signum(F.when(wide, dj).otherwise(di)).cast("long") * b
        return F.struct(k.alias("k"), F.when(wide, along).otherwise(across).alias("i"), F.when(wide, across).otherwise(along).alias("j"), F.lit(weight).alias("weight"))

    def of_step(k: Column) -> Column:
        turns = aside(k) > aside(k - 1)
        return F.array_compact(F.array(F.when(k < n, place(k, k, aside(k), 2)), F.when(turns, place(k, k, aside(k - 1), 1)), F.when(turns, place(k, k - 1, aside(k), 1))))

    return F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), n), of_step))


def observations(views: DataFrame, cells: DataFrame, size: float, near: float, far: float, ideal: float) -> DataFrame:
    """views: scene, view, x, y. For each view the target cells (scene, view, i, j) whose middle is between near and far, with distance, weight (1 at the ideal distance, less by how far off it is), bearing
    and back (radians, from the view and toward it), and clear: no blocked cell stands on the line between the two cells, and none of its diagonal steps slips between two blocked cells.

    Views meet cells by tiles of the far distance; a view's own cell is left out. Rays meet blocked cells by cell, so only hits become rows."""
    tile = max(1, ceil(far / size))
    at = lambda c: F.floor(c / size).cast("long")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("m")
    own = views.select("scene", "view", "x", "y", at(F.col("x")).alias("vi"), at(F.col("y")).alias("vj"), around)
    own = own.select("scene", "view", "x", "y", "vi", "vj", (F.floor(F.col("vi") / tile) + F.col("m.a")).alias("ti"), (F.floor(F.col("vj") / tile) + F.col("m.b")).alias("tj"))
    target = cells.where("target").select("scene", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).withColumns({"ti": F.floor(F.col("i") / tile), "tj": F.floor(F.col("j") / tile)})
    dx, dy = (F.col("i") + 0.5) * size - F.col("x"), (F.col("j") + 0.5) * size - F.col("y")
    rays = own.join(target, ["scene", "ti", "tj"]).withColumns({"distance": F.hypot(dx, dy), "bearing": F.atan2(dy, dx)})
    rays = rays.where(F.col("distance").between(near, far) & ((F.col("i") != F.col("vi")) | (F.col("j") != F.col("vj")))).drop("ti", "tj")
    rays = graphs.materialize(rays)
    steps = rays.select("scene", "view", F.col("i").alias("to_i"), F.col("j").alias("to_j"), "vi", "vj", F.explode(_crossed(F.col("i") - F.col("vi"), F.col("j") - F.col("vj"))).alias("s"))
    steps = steps.select("scene", "view", "to_i", "to_j", "s.k", "s.weight", (F.col("vi") + F.col("s.i")).alias("i"), (F.col("vj") + F.col("s.j")).alias("j"))
    hits = steps.join(cells.where("blocked").select("scene", "i", "j").distinct(), ["scene", "i", "j"])
    stopped = hits.groupBy("scene", "view", "to_i", "to_j", "k").agg(F.sum("weight").alias("w")).where("w >= 2").select("scene", "view", F.col("to_i").alias("i"), F.col("to_j").alias("j")).distinct()
    back = F.pmod(F.col("bearing") + F.lit(2 * F.pi()), 2 * F.pi()) - F.pi()
    seen = rays.join(stopped.withColumn("clear", F.lit(False)), ["scene", "view", "i", "j"], "left")
    return seen.select("scene", "view", "i", "j", "distance", (1 - F.abs(F.col("distance") - ideal) / ideal).alias("weight"), "bearing", back.alias("back"), F.coalesce("clear", F.lit(True)).alias("clear"))


def facing(seen: DataFrame, headings: DataFrame, field: float, least: float) -> DataFrame:
    """seen (of observations) from views that look one way (headings: scene, view, heading in radians): cells within the field of view, whose weight falls with the square of how far they are from its middle; those below least go."""
    off = F.abs(F.pmod(F.col("bearing") - F.col("heading") + F.pi(), 2 * F.pi()) - F.pi())
    looked = seen.join(headings, ["scene", "view"]).withColumn("off", off).where(F.col("off") <= field / 2)
    return looked.withColumn("weight", F.col("weight") * (1 - EDGE_LOSS * (F.col("off") / (field / 2)) ** 2)).where(F.col("weight") >= least).drop("off")


def _apart(a: Column, b: Column) -> Column:
    """Degrees between two bearings in degrees."""
    return F.lit(180.0) - F.abs(F.pmod(a - b, F.lit(360.0)) - 180.0)


def _covered(mass: Column, angle: Column, enough: float, wide: float) -> Column:
    return F.least(F.lit(1.0), mass / enough) * (F.least(F.lit(1.0), angle / wide) if wide > 0 else F.lit(1.0))


def gains(seen: DataFrame, state: DataFrame, targets: DataFrame, mass: float, angle: float) -> DataFrame:
    """Per view of seen (view, cell, weight, bearing in degrees): gain, the rise of the importance-weighted coverage that it would bring on top of state (cell, mass, angle, bearings);
    redundancy, the share of its weight that falls on cells that are full already; bound, what its cells lack, which no gain can exceed now or later."""
    s = seen.join(targets, "cell").join(state, "cell", "left").withColumns({"mass": F.coalesce("mass", F.lit(0.0)), "angle": F.coalesce("angle", F.lit(0.0))})
    turned = F.greatest(F.col("angle"), F.coalesce(F.array_max(F.transform("bearings", lambda b: _apart(b, F.col("bearing")))), F.lit(0.0)))
    before, after = _covered(F.col("mass"), F.col("angle"), mass, angle), _covered(F.col("mass") + F.col("weight"), turned, mass, angle)
    s = s.withColumns({"before": before, "after": after})
    share = F.coalesce(F.sum(F.when(F.col("before") >= 1 - 1e-9, F.col("weight"))), F.lit(0.0)) / F.nullif(F.sum("weight"), F.lit(0.0))
    rise, lack = F.sum((F.col("after") - F.col("before")) * F.col("importance")), F.sum((1 - F.col("before")) * F.col("importance"))
    return s.groupBy("view").agg(F.round(rise, 9).alias("gain"), F.round(F.coalesce(share, F.lit(0.0)), 9).alias("redundancy"), (lack + 1e-9).alias("bound"))


def choose_views(seen: DataFrame, places: DataFrame, targets: DataFrame, most: int, mass: float, angle: float, start: tuple[float, float], travel: float, penalty: float = 0.0, apart: float = 0.0, least: float = 1e-9, stop: float = 1.0, known: DataFrame | None = None, head: int = HEAD) -> tuple[list[tuple], dict]:
    """Greedy choice of up to `most` views. seen: view, cell, weight, bearing (degrees); places: view, x, y; targets: cell, importance; known: cell, weight, bearing of what has been seen before.
    With an angle, a cell that nobody has seen counts for nothing until it is seen twice, so a choice then starts from what is known.

    A view scores gain * (1 - penalty * redundancy) / (travel + distance from the last place). Picked is the largest score; ties: larger gain, shorter way, smaller view. It ends when `stop` of the importance is covered,
    `most` views are picked or none gains `least`; views nearer than `apart` to a picked one are passed over.

    Lazy: every view has a bound on its gain from when it was last looked at. Coverage only rises, so old bounds still hold, and views are looked at
    in the order of bound / (travel + distance) until the best score found is above the next bound. Gains are computed in Spark, `head` views at a time; the driver holds the picks and one head.
    Returns [(view, x, y, gain, score, covered share after it)] and {"evaluated": views looked at over all rounds}."""
    seen, targets = graphs.materialize(seen), graphs.materialize(targets)
    total = targets.agg(F.sum("importance")).first()[0] or 0.0
    own = seen.select("cell", "weight", "bearing")
    known = graphs.materialize(own.where("false") if known is None else known.select("cell", "weight", "bearing"))

    # the bearing farthest from another lies opposite it. Of the bearings within some degrees the smallest and the largest do: only if one between them is farther do they matter, and then all of them are farther than the angle asked, beyond which nothing is gained.
    grain = min(10.0, 180.0 - angle)
    slot = F.floor(F.col("bearing") / grain) if grain > 0 else F.col("bearing")

    def state_after(chosen: DataFrame) -> tuple[DataFrame, float]:
        slots = known.unionByName(chosen).groupBy("cell", slot.alias("slot")).agg(F.sum("weight").alias("mass"), F.min("bearing").alias("low"), F.max("bearing").alias("high"))
        sums = slots.groupBy("cell").agg(F.sum("mass").alias("mass"), F.array_distinct(F.flatten(F.collect_list(F.array("low", "high")))).alias("bearings"))
        widest = F.coalesce(F.array_max(F.transform("bearings", lambda a: F.array_max(F.transform("bearings", lambda b: _apart(a, b))))), F.lit(0.0))
        state = graphs.materialize(sums.select("cell", "mass", widest.alias("angle"), "bearings"))
        return state, state.join(targets, "cell").agg(F.sum(F.col("importance") * _covered(F.col("mass"), F.col("angle"), mass, angle))).first()[0] or 0.0

    state, covered = state_after(own.where("false"))
    queue = graphs.materialize(places.join(gains(seen, state, targets, mass, angle).select("view", "bound"), "view").select("view", "x", "y", "bound"))
    picks, evaluated, here = [], 0, start
    while len(picks) < most and total and covered / total < stop:
        way = F.hypot(F.col("x") - here[0], F.col("y") - here[1])
        open_views = queue.where(F.col("bound") > 0)
        for p in picks:
            open_views = open_views.where((F.col("view") != p[0]) & (F.hypot(F.col("x") - p[1], F.col("y") - p[2]) >= apart))
        open_views = open_views.select("view", "x", "y", F.round(way, 9).alias("way"), (F.col("bound") / F.greatest(F.lit(1e-6), travel + way)).alias("most"))
        best, looked, after = None, [], None
        while True:
            ahead = open_views if after is None else open_views.where((F.col("most") < after[0]) | ((F.col("most") == after[0]) & (F.col("view") > after[1])))
            rows = ahead.orderBy(F.desc("most"), "view").limit(head).collect()  # one head of the queue
            rows = [r for r in rows if best is None or r["most"] >= best[0] - 1e-9]
            if not rows:
                break
            found = {g["view"]: g for g in gains(seen.where(F.col("view").isin([r["view"] for r in rows])), state, targets, mass, angle).collect()}
            evaluated += len(rows)
            for r in rows:
                g = found.get(r["view"])
                if g is None:
                    continue
                looked.append((r["view"], g["bound"]))
                score = round(g["gain"] * (1 - penalty * g["redundancy"]) / max(1e-6, travel + r["way"]), 9)
                key = (score, g["gain"], -r["way"])
                if g["gain"] > 0 and (best is None or key > best[:3] or (key == best[:3] and r["view"] < best[3])):
                    best = (*key, r["view"], r["x"], r["y"])
            after = (rows[-1]["most"], rows[-1]["view"])
        if best is None or best[1] < least:
            break
        here = (best[4], best[5])
        state, covered = state_after(seen.where(F.col("view").isin([*[p[0] for p in picks], best[3]])).select("cell", "weight", "bearing"))
        picks.append((best[3], best[4], best[5], best[1], best[0], round(covered / total, 9)))
        if looked:
            newer = queue.sparkSession.createDataFrame(looked, f"view {queue.schema['view'].dataType.simpleString()}, newer double")
            queue = graphs.materialize(queue.join(F.broadcast(newer), "view", "left").select("view", "x", "y", F.coalesce("newer", "bound").alias("bound")))  # at most the views looked at in this round
    return picks, {"evaluated": evaluated}
