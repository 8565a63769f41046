"""Capture telemetry as Structured Streaming: validation, late data, deduplication, windows and per-session state.

The same column expressions serve batch and stream. A stream runs over a table with the availableNow trigger into a
keyed upsert log: each micro-batch overwrites the folder of its own number, so a batch that is repeated after a failure
leaves no second copy, and reading keeps the newest row of each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import first_per_key

#: How late a sample may be and still count. Batch sources without a bound on lateness need a larger value.
LATENESS = "10 minutes"
POSES = "session long, id long, t double, x double, y double, yaw double"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder: a stream takes a single file only through a pattern."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source has and returns what it wrote, with the number of the micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(f"{_ddl(stream)}, batch int").parquet(f"{path}/rows")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def newest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state that an update-mode log stands for: the row of each key from its last micro-batch."""
    return first_per_key(log, keys, [F.desc("batch")]).drop("batch")


def verdict(value: Column, props: Column, low: float, high: float) -> Column:
    """Why a sample is refused, or null: not finite, out of range, or attributes that are no JSON object."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(~finite, "not_finite").when(~value.between(low, high), "out_of_range").when(F.json_object_keys(props).isNull(), "bad_props")


def whole_batches(df: DataFrame, keys: Sequence[str], reason: str, most: int) -> DataFrame:
    """All-or-nothing ingest: batches (keys) with their size, whether all of it is taken, and the first reason why not."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(reason).alias("reason"))
    why = F.when(F.col("n") > most, "too_large").otherwise(F.col("reason"))
    return counted.select(*keys, "n", why.isNull().alias("taken"), why.alias("why"))


def window_counts(df: DataFrame, ts: str, keys: Sequence[str], width: str, slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Rows per event-time window and key. On a stream, run it in update mode; state is dropped behind the watermark."""
    marked = df.withWatermark(ts, lateness) if df.isStreaming else df
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return marked.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_counts(df: DataFrame, ts: str, key: str, gap: str, lateness: str = LATENESS) -> DataFrame:
    """Rows per session: a run of rows of a key with no silence of gap or longer."""
    marked = df.withWatermark(ts, lateness) if df.isStreaming else df
    return marked.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def over_rate(df: DataFrame, ts: str, key: str, width: str, most: int) -> DataFrame:
    """Fixed windows in which a key was seen more often than allowed."""
    return window_counts(df, ts, [key], width).where(F.col("n") > most)


def presence(df: DataFrame, key: str, ts: str, as_of: Column, live: str, keep: str) -> DataFrame:
    """Last heartbeat of each key, whether it is within `live` of as_of; keys silent for `keep` are pruned."""
    seen = df.groupBy(key).agg(F.max(ts).alias("seen"))
    return seen.where(F.col("seen") >= as_of - F.expr(f"INTERVAL {keep}")).withColumn("live", F.col("seen") >= as_of - F.expr(f"INTERVAL {live}"))


def tracking_state(last_state: Column, last_seen: Column, same_frame: Column, as_of: Column, stale: str, lost: str) -> Column:
    """State of a session at as_of. A mismatch of frames outweighs age, and age outweighs what the device said."""
    older = lambda age: last_seen < as_of - F.expr(f"INTERVAL {age}")
    return F.when(last_seen.isNull(), "UNKNOWN").when(~same_frame, "FRAME_MISMATCH").when(older(lost), "LOST").when(older(stale), "STALE").otherwise(last_state)


def bad_transitions(df: DataFrame, key: str, order: Sequence[str], status: str, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose status may not follow the one before; allowed is the state machine, a bounded table."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    pairs = df.sparkSession.createDataFrame(list(allowed), f"before string, {status} string")
    return df.withColumn("before", before).where("before IS NOT NULL").join(pairs, ["before", status], "left_anti")


def dwelling(df: DataFrame, key: str, order: Sequence[str], t: str, inside: Column, least: float) -> DataFrame:
    """Stays inside a region of at least `least` seconds: key, first and last time. Any sample outside ends a stay."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("__in", F.coalesce(inside, F.lit(False))).withColumn("__run", F.sum(F.when(F.col("__in"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stays = marked.where("__in").groupBy(key, "__run").agg(F.min(t).alias("since"), F.max(t).alias("until"))
    return stays.where(F.col("until") - F.col("since") >= least).drop("__run")


def keeps(last: tuple[float, float, float, float], now: tuple[float, float, float, float], least: float, most: float, moved: float, turned: float) -> bool:
    """Whether a pose (t, x, y, yaw) is sent on: never sooner than least seconds after the last, always after most, between them if it moved or turned."""
    age = now[0] - last[0]
    if age >= most or age < least:
        return age >= most
    turn = abs((now[3] - last[3] + 180) % 360 - 180)
    return (now[1] - last[1]) ** 2 + (now[2] - last[2]) ** 2 >= moved**2 or turn >= turned


def throttle_poses(poses: DataFrame, least: float = 0.2, most: float = 1.0, moved: float = 0.1, turned: float = 10.0) -> DataFrame:
    """poses (session, id, t, x, y, yaw), all but id not null, thinned per session; state is the last pose that was sent.

    Samples of one micro-batch are ordered by (t, id); one that is older than the state is dropped as late. A task holds one
    session's samples of one micro-batch, which the source's maxFilesPerTrigger bounds on a stream. Null coordinates take no part.
    """

    def thin(last, pdf: pd.DataFrame):
        out = []
        for row in pdf.sort_values(["t", "id"], kind="stable").itertuples(index=False):
            now = (row.t, row.x, row.y, row.yaw)
            if last is None or keeps(last, now, least, most, moved, turned):
                out.append(row)
                last = now
        return last, pd.DataFrame(out, columns=pdf.columns)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = thin(tuple(state.get) if state.exists else None, pd.concat(parts, ignore_index=True))
        if last is not None:
            state.update(last)
        yield out

    whole = poses.select(*[x.split()[0] for x in POSES.split(", ")]).dropna(subset=["session", "t", "x", "y", "yaw"])
    if whole.isStreaming:
        return whole.groupBy("session").applyInPandasWithState(step, POSES, "t double, x double, y double, yaw double", "append", GroupStateTimeout.NoTimeout)
    return whole.groupBy("session").applyInPandas(lambda pdf: thin(None, pdf)[1], POSES)


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], shape: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Last write wins by key over a whole stream: an update-mode log, read back as its newest rows."""
    return newest(run_available(shape(stream), path, "update"), keys)


def in_event_order(df: DataFrame, key: str, t: Column, arrival: str) -> DataFrame:
    """A place per key in the order of event time, ties in the order of arrival: late rows move what came before them."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(t, arrival)))
