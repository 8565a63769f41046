"""Ordered sequences. What depends on the previous kept row is a fold over one session in a declared order; the rest are windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """step: distance from the row before; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))


def _fold(rows: DataFrame, columns: Sequence[str], keep: Callable[[tuple, tuple], bool], kind: str) -> DataFrame:
    """The rows, with session and id, of which keep(last kept, row) holds, and the first of each session; both get tuples of the columns. Sessions are sorted streams: a task carries the last kept row from batch to batch, never a session."""

    def run(batches):
        session, last = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, kept = whole.slice(at, 1000), []
                for own, *row in zip(*[batch.column(c).to_pylist() for c in ("session", *columns)], strict=True):
                    if session != (own,):
                        session, last = (own,), None
                    kept.append(last is None or bool(keep(last, row)))
                    if kept[-1]:
                        last = row
                yield batch.filter(pa.array(kept, pa.bool_())).select(names)

    names = [x.split()[0] for x in kind.split(", ")]
    ordered = rows.repartition("session").sortWithinPartitions("session", F.col("id").asc_nulls_last(), *columns)
    return ordered.mapInArrow(run, kind)


def clean_trajectory(samples: DataFrame, max_speed: float, jitter: float) -> DataFrame:
    """samples: session, id, t, x, y in arrival order (id). Relative to the last kept sample: earlier ones, impossible jumps and stillness go. A session is one fold."""

    def keep(last, row) -> bool:
        dt, step = row[0] - last[0], float(np.hypot(row[1] - last[1], row[2] - last[2]))
        return dt > 0 and step <= max_speed * dt and step >= jitter

    rows = samples.select(*[F.col(c).cast("long").alias(c) for c in ("session", "id")], *[F.col(c).cast("double").alias(c) for c in ("t", "x", "y")])
    return _fold(rows.where("t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), ["t", "x", "y"], keep, "session long, id long, t double, x double, y double")


def resample(samples: DataFrame, step: float) -> DataFrame:
    """Points every `step` along each session's path, linearly between samples; yaw (degrees) turns the short way."""
    w = Window.partitionBy("session").orderBy("t", "id")
    run = step_lengths(samples, ["session"], ["t", "id"]).withColumn("along", F.sum(F.coalesce("step", F.lit(0.0))).over(w))
    pair = run.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("x", "y", "yaw", "along")}).where("p_along IS NOT NULL AND along > p_along")
    first, last = F.floor(F.col("p_along") / step) + 1, F.floor(F.col("along") / step)
    every = pair.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    share = (F.col("k") * step - F.col("p_along")) / (F.col("along") - F.col("p_along"))
    turn = F.pmod(F.col("yaw") - F.col("p_yaw") + 180, F.lit(360.0)) - 180
    between = lambda c: F.col(f"p_{c}") + share * (F.col(c) - F.col(f"p_{c}"))
    return every.select("session", F.col("k").cast("long").alias("k"), between("x").alias("x"), between("y").alias("y"), F.pmod(F.col("p_yaw") + share * turn, F.lit(360.0)).alias("yaw"))


def suppress_repeats(frames: DataFrame, session: str, order: str, vector: str, least: float) -> DataFrame:
    """Keeps a frame whose mean L1 distance (times 100) to the last kept one is at least `least`; the session's first is kept."""

    def keep(last, row) -> bool:
        return 100 * float(np.abs(np.asarray(row[0], float) - np.asarray(last[0], float)).mean()) >= least

    rows = frames.select(F.col(session).cast("long").alias("session"), F.col(order).cast("long").alias("id"), F.col(vector).alias("v"))
    return _fold(rows, ["v"], keep, "session long, id long")


def grid_level_changes(grid: DataFrame, low: float, high: float) -> DataFrame:
    """Neighbouring cells (i, j) right or above whose z differs by (low, high]: two equi-joins, no theta join."""
    out = None
    for di, dj in ((1, 0), (0, 1)):
        other = grid.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("z").alias("z2"))
        part = grid.join(other, ["i", "j"])
        out = part if out is None else out.unionByName(part)
    dz = F.abs(F.col("z") - F.col("z2"))
    return out.where((dz > low) & (dz <= high)).select("i", "j", "i2", "j2", dz.alias("dz"))
