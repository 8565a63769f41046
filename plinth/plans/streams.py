"""Telemetry streams and state (X). Streams run over the events table to its end; results are then those of the batch oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..sources.shared import shared_dir
from ..sources.tables import table
from ..streaming import leases as L
from ..streaming import telemetry as X
from ..streaming import tracks as T
from .registry import query

_AS_OF = "2024-01-20 00:00:00"
#: Files of a table come in any order of event time, so the whole span may be late.
_ANY_LATENESS = "400 days"
_JOBS = [("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("view", "view")]


def _events(spark, d, stream=False):
    raw = X.table_stream(spark, d, "events") if stream else table(spark, d, "events")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


_VERDICT = "CASE WHEN value IS NULL OR NOT isfinite(value) THEN 'not_finite' WHEN NOT value BETWEEN 1 AND 250 THEN 'out_of_range' WHEN json_type(props) IS DISTINCT FROM 'OBJECT' THEN 'bad_props' END"


@query("x01_whole_batches", f"""WITH v AS (SELECT user_id, ts::DATE AS day, {_VERDICT} AS reason FROM events), c AS (SELECT user_id, day, count(*) AS n, min(reason) AS reason FROM v GROUP BY 1, 2),
w AS (SELECT user_id, day, n, CASE WHEN n > 12 THEN 'too_large' ELSE reason END AS why FROM c) SELECT user_id, day, n, why IS NULL AS taken, why FROM w""")
def x01(spark, d):
    judged = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), X.verdict(F.col("value"), F.col("props"), 1.0, 250.0).alias("reason"))
    return X.whole_batches(judged, ["user_id", "day"], "reason", 12)


@query("x03_windows_on_stream", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x03(spark, d):
    counts = X.window_counts(_events(spark, d, stream=True), "ts", ["event_type"], "1 hour", lateness=_ANY_LATENESS)
    return X.upsert_stream(counts, shared_dir(spark), ["start", "event_type"]).withColumn("start", F.unix_micros("start"))


@query("x05_tracking_state", f"""WITH l AS (SELECT user_id, max(ts) AS seen, arg_max(event_type, (ts, event_id)) AS said FROM events WHERE ts <= TIMESTAMP '{_AS_OF}' GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'FRAME_MISMATCH' WHEN seen < TIMESTAMP '{_AS_OF}' - INTERVAL 12 HOUR THEN 'LOST' WHEN seen < TIMESTAMP '{_AS_OF}' - INTERVAL 2 HOUR THEN 'STALE' ELSE said END AS state FROM l""")
def x05(spark, d):
    as_of = F.lit(_AS_OF).cast("timestamp_ntz")
    last = table(spark, d, "events").where(F.col("ts") <= as_of).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    return last.select("user_id", X.tracking_state(F.col("last.event_type"), F.col("last.ts"), F.col("user_id") % 7 != 0, as_of, "2 HOURS", "12 HOURS").alias("state"))


@query("x09_presence", f"SELECT user_id, epoch_us(max(ts)) AS seen, max(ts) >= TIMESTAMP '{_AS_OF}' - INTERVAL 12 HOUR AS live FROM events WHERE ts <= TIMESTAMP '{_AS_OF}' GROUP BY 1 HAVING max(ts) >= TIMESTAMP '{_AS_OF}' - INTERVAL 7 DAY")
def x09(spark, d):
    as_of = F.lit(_AS_OF).cast("timestamp")
    return X.presence(_events(spark, d).where(F.col("ts") <= as_of), "user_id", "ts", as_of, "12 HOURS", "7 DAYS").withColumn("seen", F.unix_micros("seen"))


@query("x10_bad_transitions", f"""WITH e AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before, event_type FROM e WHERE before IS NOT NULL AND (before, event_type) NOT IN ({', '.join(map(repr, _JOBS))})""")
def x10(spark, d):
    return X.bad_transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", _JOBS).select("event_id", "before", "event_type")


@query("x11_deduplicated_stream", "SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events")
def x11(spark, d):
    keyed = _events(spark, d, stream=True).withColumn("day", F.to_date("ts")).withWatermark("ts", _ANY_LATENESS)
    once = keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")
    return X.run_available(once, shared_dir(spark)).drop("batch")


@query("x12_silences", """WITH b AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, run""")
def x12(spark, d):
    return X.session_counts(_events(spark, d), "ts", "user_id", "6 hours").withColumn("start", F.unix_micros("start"))


@query("x13_throttled_poses")
def x13(spark, d):
    """Stateful, so without SQL; a test compares with a plain loop."""
    seconds = F.unix_micros("ts") / 1e6
    poses = _events(spark, d, stream=True).select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), seconds.alias("t"), (F.col("value") / 10).alias("x"), (F.col("event_id") % 17).cast("double").alias("y"), (F.col("event_id") % 360).cast("double").alias("yaw"))
    return X.run_available(X.throttle_poses(poses, least=3600.0, most=36000.0, moved=9.0, turned=120.0), shared_dir(spark)).drop("batch")


@query("x14_arrivals", """WITH m AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value < 120 AS near, sum(CASE WHEN value < 120 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT user_id, min(t) AS since, max(t) AS until FROM m WHERE near GROUP BY user_id, run HAVING max(t) - min(t) >= 7200""")
def x14(spark, d):
    e = _events(spark, d).withColumn("t", F.unix_micros("ts") / 1e6)
    return X.dwelling(e, "user_id", ["ts", "event_id"], "t", F.col("value") < 120, 7200.0)


@query("x17_rate_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 3")
def x17(spark, d):
    return X.over_rate(_events(spark, d), "ts", "user_id", "1 day", 3).withColumn("start", F.unix_micros("start"))


@query("x02_event_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS place FROM events")
def x02(spark, d):
    return X.in_event_order(_events(spark, d), "user_id", times.epoch_millis(F.col("ts")), "event_id").select("event_id", "place")


def _sightings(events):
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "PERSON").when(F.col("event_type") != "error", "UNCLASSIFIED")
    return events.select((F.col("user_id") % 5).alias("floor"), (F.floor(i / 4) * 0.5).alias("t"), i.alias("id"), kind.alias("category"), (i % 17 * 0.7).alias("x"), (i % 5 * 0.7).alias("y"), ((i * 7 % 10) / 10).alias("confidence"), F.lit(0.2).alias("uncertainty"))


@query("x06_obstacle_tracks")
def x06(spark, d):
    """Tracked on a stream whose files hold the sightings in order; the newest state of each floor."""
    path = shared_dir(spark)
    whole = _sightings(_events(spark, d))
    whole.repartitionByRange(4, "t").sortWithinPartitions("t", "id").write.parquet(path)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 64).parquet(path)
    log = X.run_available(T.track_obstacles(stream), shared_dir(spark), "append")
    newest = log.groupBy("floor").agg(F.max("batch").alias("batch"))
    return log.join(newest, ["floor", "batch"], "left_semi").select("floor", "track", "category", "hits", "status")


@query("x07_track_expiry", "WITH l AS (SELECT user_id AS track, CASE WHEN user_id % 2 = 0 THEN 'PERSON' ELSE 'UNCLASSIFIED' END AS category, max(event_id) * 0.1 AS last_t FROM events GROUP BY 1) SELECT track, category FROM l WHERE (SELECT max(event_id) * 0.1 FROM events) + 9 - last_t <= CASE category WHEN 'PERSON' THEN 10 ELSE 30 END")
def x07(spark, d):
    e = table(spark, d, "events")
    tracks = e.groupBy(F.col("user_id").alias("track")).agg((F.max("event_id") * 0.1).alias("last_t")).withColumn("category", F.when(F.col("track") % 2 == 0, "PERSON").otherwise("UNCLASSIFIED"))
    now = e.agg((F.max("event_id") * 0.1 + 9).alias("now"))
    return T.living(tracks.crossJoin(F.broadcast(now)), F.col("now")).select("track", "category")  # one row


_LEASE = 8 * 3_600_000


@query("x08_lease_expiry", f"""WITH m AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS since, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events), e AS (SELECT max(epoch_us(ts)) // 1000 - 3600000 AS mark FROM events)
SELECT key, since, since + {_LEASE} AS expired FROM m, e WHERE coalesce(after >= since + {_LEASE}, since + {_LEASE} <= mark)""")
def x08(spark, d):
    """A lease of eight hours per user, that every event renews, on a stream with timers."""
    before = spark.conf.get(L._STORE, None)
    try:
        signs = _events(spark, d, stream=True).select(F.col("user_id").alias("key"), "ts")
        return X.run_available(L.expired_leases(signs, _LEASE, "1 hour"), shared_dir(spark)).drop("batch")
    finally:
        spark.conf.set(L._STORE, before) if before else spark.conf.unset(L._STORE)
