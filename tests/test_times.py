"""Milliseconds since 1970 hold to the SQL of the oracles."""

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from plinth.functions import times
from plinth.plans import catalog


def test_epoch_millis_round_as_in_sql(spark):
    micros = [0, 499, 500, 999, 1499, 1500, 1704067199999499, 1704067199999500, -1, -499, -500, -501, -1500, -1704067199999500]
    got = spark.createDataFrame([(m,) for m in micros], "m long").select("m", times.epoch_millis(F.timestamp_micros("m")).alias("ms"), times.whole(F.col("m"), 7).alias("w")).collect()
    con = duckdb.connect()
    assert [(r["ms"], r["w"]) for r in got] == [con.execute(f"SELECT epoch_ms(make_timestamp({m}::BIGINT)), {m}::BIGINT // 7").fetchall()[0] for m in micros]


def test_rate_window_at_the_end_of_a_minute(spark, tmp_path):
    at = datetime(2024, 1, 1, 0, 0, 59)
    rows = [(i, at + timedelta(microseconds=m), 1, "view", 1.0, "{}") for i, m in enumerate((0, 400_000, 999_499, 999_500, 1_000_000, -500_499, -500_500))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("f20_rate_window", "x02_event_order"):
        found = catalog.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES[name]})").fetchall())
