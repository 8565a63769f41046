"""Windows, sequences, sorting and paging (W, K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import relational as R
from ..operators import sequences as S
from ..sources.tables import table
from .registry import query


@query("w01_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def w01(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("number"))


@query("w02_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def w02(spark, d):
    return R.first_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("w03_latest_version", "SELECT l_orderkey, max(l_linenumber) AS version, arg_max(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def w03(spark, d):
    best = F.max(F.struct("l_linenumber", "l_partkey"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(best["l_linenumber"].alias("version"), best["l_partkey"].alias("l_partkey"))


@query("w04_first_position", "SELECT p_partkey, w AS word, min(i) - 1 AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) GROUP BY 1, 2")
def w04(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word")).groupBy("p_partkey", "word").agg(F.min("i").cast("long").alias("place"))


@query("w05_newest_ascending", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 40)")
def w05(spark, d):
    newest = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(40)
    return newest.select("event_id", F.row_number().over(Window.orderBy("ts", "event_id")).cast("long").alias("place"))


@query("w06_segments", """WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 OR lag(event_type) OVER w = 'error' THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM e) SELECT user_id, segment::BIGINT AS segment, count(*) AS n, min(event_id) AS first FROM s GROUP BY 1, 2""")
def w06(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    broken = lambda before: (us(F.col("ts")) - us(before("ts")) > 7_200_000_000) | (before("event_type") == "error")
    return R.segments(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], broken).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def _track(spark, d):
    """A walk per user: time in seconds, place from the event's values."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("value") / 10).alias("x"), (F.col("event_id") % 17).cast("double").alias("y"), F.col("event_type").alias("kind"))


_TRACK = "SELECT user_id AS session, event_id AS id, epoch_us(ts) / 1e6 AS t, value / 10 AS x, (event_id % 17)::DOUBLE AS y, event_type AS kind FROM events"


@query("w07_trajectory_cleaning")
def w07(spark, d):
    return S.clean_trajectory(_track(spark, d), max_speed=0.002, jitter=0.5)


@query("w08_resampling")
def w08(spark, d):
    return S.resample(_track(spark, d).withColumn("yaw", F.col("y") * 20), step=5.0)


@query("w09_path_by_kind", f"""WITH t AS ({_TRACK}), s AS (SELECT session, kind, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS len FROM t WINDOW w AS (PARTITION BY session ORDER BY t, id))
SELECT session, kind, round(coalesce(sum(len), 0), 5) AS length FROM s GROUP BY 1, 2""")
def w09(spark, d):
    steps = S.step_lengths(_track(spark, d), ["session"], ["t", "id"])
    return steps.groupBy("session", "kind").agg(F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 5).alias("length"))


@query("w10_cumulative_distance", f"""WITH t AS ({_TRACK}), s AS (SELECT session, t, id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS len FROM t WINDOW w AS (PARTITION BY session ORDER BY t, id))
SELECT id, round(coalesce(sum(len) OVER (PARTITION BY session ORDER BY t, id), 0), 5) AS along FROM s""")
def w10(spark, d):
    steps = S.step_lengths(_track(spark, d), ["session"], ["t", "id"])
    return steps.select("id", F.round(F.coalesce(F.sum("step").over(Window.partitionBy("session").orderBy("t", "id")), F.lit(0.0)), 5).alias("along"))


@query("w11_turn_angle", f"""WITH t AS ({_TRACK}), s AS (SELECT id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM t WINDOW w AS (PARTITION BY session ORDER BY t, id)),
a AS (SELECT id, degrees(atan2(ny - y, nx - x)) - degrees(atan2(y - py, x - px)) AS d FROM s WHERE px IS NOT NULL AND nx IS NOT NULL), m AS (SELECT id, d - 360 * floor(d / 360) AS d FROM a)
SELECT id, round(CASE WHEN d > 180 THEN d - 360 ELSE d END, 4) AS turn FROM m""")
def w11(spark, d):
    w = Window.partitionBy("session").orderBy("t", "id")
    near = _track(spark, d).withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).where("px IS NOT NULL AND nx IS NOT NULL")
    return near.select("id", G.round_away(G.turn_degrees(*map(F.col, ("px", "py", "x", "y", "nx", "ny"))), 4).alias("turn"))


@query("w12_depth_layers", """WITH l AS (SELECT p_brand AS frame, p_partkey AS id, p_retailprice AS depth, CASE WHEN p_retailprice - lag(p_retailprice) OVER w > 5 THEN 1 ELSE 0 END AS b FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)),
s AS (SELECT frame, depth, sum(b) OVER (PARTITION BY frame ORDER BY depth, id) + 1 AS layer FROM l) SELECT frame, layer::BIGINT AS layer, count(*) AS n, min(depth) AS near FROM s GROUP BY 1, 2""")
def w12(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("frame"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("depth"))
    return R.segments(p, ["frame"], ["depth", "id"], lambda before: F.col("depth") - before("depth") > 5, "layer").groupBy("frame", "layer").agg(F.count("*").alias("n"), F.min("depth").alias("near"))


@query("w13_suppress_near_repeats")
def w13(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("id"), F.col("embedding").alias("thumb"))
    return S.suppress_repeats(e, "session", "id", "thumb", least=7.0)


@query("w14_motion", f"""WITH t AS ({_TRACK}) SELECT id, round(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / nullif(t - lag(t) OVER w, 0), 8) AS speed FROM t WINDOW w AS (PARTITION BY session ORDER BY t, id)""")
def w14(spark, d):
    w = Window.partitionBy("session").orderBy("t", "id")
    steps = S.step_lengths(_track(spark, d), ["session"], ["t", "id"]).withColumn("dt", F.col("t") - F.lag("t").over(w))
    return steps.select("id", F.round(F.col("step") / F.nullif("dt", F.lit(0.0)), 8).alias("speed"))


_HITS = "SELECT l_linenumber AS class, row_number() OVER w AS k, sum((l_returnflag = 'R')::INT) OVER w AS tp FROM lineitem WINDOW w AS (PARTITION BY l_linenumber ORDER BY l_extendedprice DESC, l_orderkey, l_partkey ROWS UNBOUNDED PRECEDING)"


def _running(rows):
    w = Window.partitionBy("l_linenumber").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey")
    return rows.select(F.col("l_linenumber").alias("class"), F.row_number().over(w).cast("long").alias("k"), F.sum((F.col("l_returnflag") == "R").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"))


def _precision(rows):
    return _running(rows).select("class", "k", F.round(F.col("tp") / F.col("k"), 9).alias("precision"))


def _envelope(rows):
    # a suffix maximum, taken as a running one in the other direction: Spark computes frames up to the last row in quadratic time
    after = Window.partitionBy("class").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return _running(rows).select("class", "k", F.round(F.max(F.col("tp") / F.col("k")).over(after), 9).alias("envelope"))


@query("w15_running_precision", f"SELECT class, k, round(tp / k, 9) AS precision FROM ({_HITS})")
def w15(spark, d):
    return _precision(table(spark, d, "lineitem"))


@query("w16_precision_envelope", f"SELECT class, k, round(max(tp / k) OVER (PARTITION BY class ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS envelope FROM ({_HITS})")
def w16(spark, d):
    return _envelope(table(spark, d, "lineitem"))


@query("w17_grid_level_change", """WITH g AS (SELECT (p_partkey % 40)::BIGINT AS i, (p_partkey // 40)::BIGINT AS j, p_size::DOUBLE AS z FROM part), n AS (SELECT a.i, a.j, b.i AS i2, b.j AS j2, abs(a.z - b.z) AS dz FROM g a JOIN g b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1))
SELECT * FROM n WHERE dz > 3 AND dz <= 9""")
def w17(spark, d):
    k = F.col("p_partkey")
    grid = table(spark, d, "part").select((k % 40).alias("i"), F.floor(k / 40).alias("j"), F.col("p_size").cast("double").alias("z"))
    return S.grid_level_changes(grid, 3.0, 9.0)


@query("k01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def k01(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("k02_ranking_order", """SELECT p_partkey, row_number() OVER (ORDER BY (p_size > 10) DESC, nullif(p_size, 20) DESC NULLS LAST, p_brand, p_type DESC, p_retailprice DESC NULLS LAST, p_name, p_partkey) AS place FROM part""")
def k02(spark, d):
    return R.placed(table(spark, d, "part"), _ranking_order()).select("p_partkey", "place")


def _ranking_order():
    return [(F.col("p_size") > 10).desc(), F.nullif("p_size", F.lit(20)).desc_nulls_last(), F.col("p_brand"), F.desc("p_type"), F.col("p_retailprice").desc_nulls_last(), F.col("p_name"), F.col("p_partkey")]


@query("k03_clamped_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 200")
def k03(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(R.clamp_limit(5000, 50, 200))


@query("k04_merged_tops", "SELECT name, price FROM (SELECT p_name AS name, p_retailprice AS price FROM part UNION ALL SELECT c_name, c_acctbal FROM customer) ORDER BY price DESC, name LIMIT 15")
def k04(spark, d):
    parts = [table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")), table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("price"))]
    return R.merge_top(parts, [F.desc("price"), F.col("name")], 15)


@query("k06_tier_order", """WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS tier, o_totalprice AS distance FROM orders)
SELECT o_orderkey, tier, row_number() OVER (ORDER BY tier, distance NULLS LAST, o_orderkey) AS place FROM t""")
def k06(spark, d):
    return R.placed(_tiers(spark, d), _tier_order()).select("o_orderkey", "tier", "place")


def _tier_order():
    return [F.col("tier"), F.col("distance").asc_nulls_last(), F.col("o_orderkey")]


def _tiers(spark, d):
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    return table(spark, d, "orders").select("o_orderkey", tier.alias("tier"), F.col("o_totalprice").alias("distance"))


@query("k07_max_by_score", "SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_size, -p_partkey)) AS best FROM part GROUP BY 1")
def k07(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_size"), -F.col("p_partkey"))).alias("best"))


@query("k08_lowest_supported_plane", "WITH s AS (SELECT p_size AS level, count(*) AS support FROM part GROUP BY 1) SELECT level, support FROM s WHERE support >= 0.7 * (SELECT max(support) FROM s) ORDER BY level LIMIT 1")
def k08(spark, d):
    levels = table(spark, d, "part").groupBy(F.col("p_size").alias("level")).agg(F.count("*").alias("support"))
    top = levels.agg(F.max("support").alias("top"))
    return levels.crossJoin(F.broadcast(top)).where(F.col("support") >= 0.7 * F.col("top")).orderBy("level").limit(1).select("level", "support")


@query("k09_most_inliers", "SELECT p_size AS plane, count(*) AS inliers FROM part WHERE p_retailprice > 950 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def k09(spark, d):
    return table(spark, d, "part").where("p_retailprice > 950").groupBy(F.col("p_size").alias("plane")).agg(F.count("*").alias("inliers")).orderBy(F.desc("inliers"), "plane").limit(1)
