"""Streams: state across micro-batches, rewritten batches and the throttle against a plain loop."""

import pytest
from pyspark.sql import functions as F

from plinth.plans import streams
from plinth.streaming import telemetry as X


def plain_throttle(rows, least, most, moved, turned):
    kept, last = [], {}
    for session, key, t, x, y, yaw in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        before = last.get(session)
        if before is not None:
            age, turn = t - before[0], abs((yaw - before[3] + 180) % 360 - 180)
            far = (x - before[1]) ** 2 + (y - before[2]) ** 2 >= moved**2
            if age < least or (age < most and not far and turn < turned):
                continue
        last[session] = (t, x, y, yaw)
        kept.append((session, key))
    return sorted(kept)


def test_throttle_is_the_same_as_a_loop(spark):
    data = "/root/testdata/sf0.001"
    rows = streams._events(spark, data).select("user_id", "event_id", F.unix_micros("ts") / 1e6, F.col("value") / 10, (F.col("event_id") % 17).cast("double"), (F.col("event_id") % 360).cast("double"))
    wanted = plain_throttle([tuple(r) for r in rows.collect()], 3600.0, 36000.0, 9.0, 120.0)
    got = sorted((r["session"], r["id"]) for r in streams.x13(spark, data).collect())
    assert got == wanted and len(got) < rows.count()


def test_state_is_carried_over_micro_batches(spark, tmp_path):
    rows = [(1, i, i * 0.1, i * 0.03, 0.0, 0.0) for i in range(60)] + [(2, 100 + i, i * 0.3, 0.0, 0.0, 0.0) for i in range(20)]
    for n in range(4):  # one file a micro-batch, in the order of time
        part = [r for r in rows if int(r[2] // 1.5) == n]
        spark.createDataFrame(part, X.POSES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "poses.parquet"))
    poses = X.table_stream(spark, str(tmp_path / "in"), "poses", files_per_batch=1)
    log = X.run_available(X.throttle_poses(poses), str(tmp_path / "out"))
    assert log.select("batch").distinct().count() == 4
    assert sorted((r["session"], r["id"]) for r in log.collect()) == plain_throttle(rows, 0.2, 1.0, 0.1, 10.0)


@pytest.mark.parametrize("turn,kept", [(359.0, False), (351.0, False), (350.0, True), (10.0, True)])
def test_a_turn_goes_the_short_way_round(turn, kept):
    assert X.keeps((0.0, 0.0, 0.0, 0.0), (0.5, 0.0, 0.0, turn), 0.2, 1.0, 0.1, 10.0) is kept


def test_throttle_takes_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], X.POSES + ", batch string")
    assert X.throttle_poses(empty).count() == 0
    holed = spark.createDataFrame([(1, 1, None, 0.0, 0.0, 0.0), (None, 2, 1.0, 0.0, 0.0, 0.0), (1, None, 1.0, 0.0, 0.0, 0.0)], X.POSES)
    assert [tuple(r)[:2] for r in X.throttle_poses(holed).collect()] == [(1, None)]


def test_update_log_keeps_the_newest_row(spark):
    log = spark.createDataFrame([("a", 1, 0), ("a", 3, 1), ("b", 2, 0)], "k string, n int, batch int")
    assert sorted(tuple(r) for r in X.newest(log, ["k"]).collect()) == [("a", 3), ("b", 2)]
