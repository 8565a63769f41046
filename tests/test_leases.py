"""Leases on a stream of several micro-batches equal those of a batch; late rows are dropped."""

import random

from pyspark.sql import functions as F

from plinth.streaming import leases as L
from plinth.streaming import telemetry as X

HOUR = 3_600_000


def plain(rows, lease, lateness):
    """rows: (key, milliseconds)."""
    mark, out = max(t for _, t in rows) - lateness, []
    for key in {k for k, _ in rows if k is not None}:
        own = sorted(t for k, t in rows if k == key)
        for at, after in zip(own, [*own[1:], None], strict=True):
            if at + lease <= (after if after is not None else mark):
                out.append((key, at, at + lease))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, at long").select("key", F.timestamp_millis("at").alias("ts"))


def test_stream_and_batch_agree(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(12), rng.randrange(48 * 60) * 60_000) for _ in range(150)] + [(None, 5)]
    rows = sorted(rows, key=lambda r: r[1] + rng.randrange(30 * 60_000))  # out of order, but less than the lateness
    for n in range(5):
        frame(spark, rows[n * 31 : (n + 1) * 31]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "signs.parquet"))
    want = plain(rows, 4 * HOUR, HOUR)
    assert sorted(map(tuple, L.expired_leases(frame(spark, rows), 4 * HOUR, "1 hour").collect())) == want
    log = X.run_available(L.expired_leases(X.table_stream(spark, str(tmp_path / "in"), "signs", files_per_batch=1), 4 * HOUR, "1 hour"), str(tmp_path / "out"))
    assert sorted((r["key"], r["since"], r["expired"]) for r in log.collect()) == want and log.select("batch").distinct().count() > 2


def test_late_signs_renew_nothing(spark, tmp_path):
    for rows in ([(1, 100 * HOUR)], [(2, 110 * HOUR)], [(2, 111 * HOUR)], [(1, 101 * HOUR)], [(3, 130 * HOUR)]):  # the fourth comes when the first lease is over
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "signs.parquet"))
    log = X.run_available(L.expired_leases(X.table_stream(spark, str(tmp_path / "in"), "signs", files_per_batch=1), 4 * HOUR, "1 hour"), str(tmp_path / "out"))
    assert sorted((r["key"], r["since"]) for r in log.collect()) == [(1, 100 * HOUR), (2, 111 * HOUR)]


def test_no_signs(spark):
    assert L.expired_leases(frame(spark, []), HOUR, "1 hour").count() == 0
