"""Scans, projections, predicates and expressions (S, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import optional, point_lookup, scoped, table
from .registry import query

AS_OF = "1998-12-01"


@query("s01_scoped_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def s01(spark, d):
    return scoped(table(spark, d, "orders"), o_orderstatus="F").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("s02_point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 33")
def s02(spark, d):
    return point_lookup(table(spark, d, "orders"), "o_orderkey", 33).select("o_orderkey", "o_totalprice")


@query("s16_upsert_last_write", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def s16(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return R.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("s17_insert_ignore", """
WITH e AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL),
old AS (SELECT * FROM e WHERE user_id % 2 = 0)
SELECT * FROM old UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = e.user_id AND old.event_type = e.event_type)""")
def s17(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return R.insert_ignore(e.where("user_id % 2 = 0"), e, ["user_id", "event_type"])


@query("s18_update_from", """
WITH last AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(top, c_acctbal) AS c_acctbal FROM customer LEFT JOIN last ON c_custkey = o_custkey""")
def s18(spark, d):
    top = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return R.update_from(table(spark, d, "customer").select("c_custkey", "c_acctbal"), top, ["c_custkey"], ["c_acctbal"])


@query("s19_version_bump", "SELECT l_orderkey, max(l_linenumber) + 1 AS l_linenumber, arg_max(l_quantity, l_linenumber) AS l_quantity FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY 1")
def s19(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return R.next_version(rows, ["l_orderkey"], "l_linenumber")


@query("s20_temp_view", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def s20(spark, d):
    table(spark, d, "orders").where("o_totalprice > 100000").createOrReplaceTempView("large_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM large_orders GROUP BY 1")


@query("s21_json_array_to_rows", "SELECT event_id, w, i FROM (SELECT event_id, unnest([event_type, 'seen', user_id::VARCHAR]) AS w, unnest([0, 1, 2]) AS i FROM events)")
def s21(spark, d):
    as_json = table(spark, d, "events").select("event_id", F.to_json(F.array("event_type", F.lit("seen"), F.col("user_id").cast("string"))).alias("j"))
    return as_json.select("event_id", F.posexplode(F.from_json("j", "array<string>")).alias("i", "w"))


@query("s22_metrics", """
SELECT 'orders_total' AS metric, o_orderstatus AS label, count(*)::DOUBLE AS value FROM orders GROUP BY 2
UNION ALL SELECT 'order_price_p95', o_orderpriority, round(quantile_cont(o_totalprice, 0.95), 4) FROM orders GROUP BY 2""")
def s22(spark, d):
    o = table(spark, d, "orders")
    totals = o.groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("orders_total"))
    p95 = R.percentiles(o, ["o_orderpriority"], "o_totalprice", {"value": 0.95}).select(F.col("o_orderpriority").alias("label"), F.round("value", 4).alias("value")).withColumn("metric", F.lit("order_price_p95"))
    return totals.unionByName(p95).select("metric", "label", "value")


@query("p01_projection", "SELECT c_custkey AS venue, c_name AS name FROM customer")
def p01(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("venue"), F.col("c_name").alias("name"))


@query("p02_optional_parameter", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'")
def p02(spark, d):
    status = None
    return table(spark, d, "orders").where(optional(None if status is None else F.col("o_orderstatus") == status) & F.col("o_orderpriority").startswith("1")).select("o_orderkey")


@query("p03_case_classification", """SELECT c_custkey, CASE WHEN c_nationkey IS NULL THEN 'UNBOUND' WHEN c_acctbal < 0 THEN 'STALE' WHEN c_acctbal < 1000 THEN 'UNVERIFIED' ELSE 'VALID' END AS state FROM customer""")
def p03(spark, d):
    state = F.when(F.col("c_nationkey").isNull(), "UNBOUND").when(F.col("c_acctbal") < 0, "STALE").when(F.col("c_acctbal") < 1000, "UNVERIFIED").otherwise("VALID")
    return table(spark, d, "customer").select("c_custkey", state.alias("state"))


@query("p04_case_dispatch", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_returnflag = 'N' THEN l_linestatus = 'O' ELSE l_quantity > 40 END")
def p04(spark, d):
    return table(spark, d, "lineitem").where(F.when(F.col("l_returnflag") == "N", F.col("l_linestatus") == "O").otherwise(F.col("l_quantity") > 40)).select("l_orderkey", "l_linenumber")


@query("p05_evidence_score", "SELECT l_orderkey, l_linenumber, round(l_discount * CASE WHEN l_quantity >= 30 THEN 1.0 WHEN l_quantity >= 10 THEN 0.75 ELSE 0.5 END, 6) AS evidence FROM lineitem")
def p05(spark, d):
    support = F.when(F.col("l_quantity") >= 30, 1.0).when(F.col("l_quantity") >= 10, 0.75).otherwise(0.5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.coalesce("l_discount", F.lit(1.0)) * support, 6).alias("evidence"))


@query("p06_coalesce", "SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN ts END, ts + INTERVAL 1 DAY)::VARCHAR AS at FROM events")
def p06(spark, d):
    at = F.coalesce(F.when(F.col("event_type") == "error", F.col("ts")), F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return table(spark, d, "events").select("event_id", at.cast("string").alias("at"))


@query("p07_is_distinct_from", """WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS a, nullif(o_orderstatus, 'F') AS b FROM orders)
SELECT o_orderkey, a IS DISTINCT FROM b AS differs FROM o""")
def p07(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("a"), F.nullif("o_orderstatus", F.lit("F")).alias("b"))
    return o.select("o_orderkey", (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))


@query("p08_boolean_sort_key", "SELECT p_partkey, row_number() OVER (ORDER BY (p_size > 25) DESC, p_partkey) AS place FROM part")
def p08(spark, d):
    return R.placed(table(spark, d, "part"), [(F.col("p_size") > 25).desc(), F.col("p_partkey")]).select("p_partkey", "place")


@query("p09_in_list", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND user_id IN (1, 2, 3)")
def p09(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "error") & F.array_contains(F.array(*map(F.lit, (1, 2, 3))), F.col("user_id").cast("int"))).select("event_id")


@query("p10_ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%'")
def p10(spark, d):
    return table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lower(F.lit("RED")))).select("p_partkey")


@query("p11_json_typed_extract", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN NULL ELSE false END AS accessible FROM events")
def p11(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, '{"accessible": true}').when(F.col("event_id") % 3 == 1, '{"accessible": "true"}').otherwise('{"accessible": false}')
    return table(spark, d, "events").select("event_id", R.json_boolean(F.parse_json(text), "$.accessible").alias("accessible"))


@query("p12_json_text_extract", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def p12(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("p13_json_build_merge", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}' AS merged FROM events")
def p13(spark, d):
    old = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(old["k"].alias("k"), F.col("event_type").alias("type"))).alias("merged"))


@query("p14_row_diff", """WITH v AS (SELECT *, lag(l_quantity) OVER w AS q, lag(l_tax) OVER w AS t, lag(l_orderkey) OVER w AS k
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, (q IS DISTINCT FROM l_quantity OR t IS DISTINCT FROM l_tax) AS changed FROM v WHERE k IS NOT NULL""")
def p14(spark, d):
    from pyspark.sql import Window

    columns = ["l_quantity", "l_tax", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").withColumn("new", F.struct(*columns)).withColumn("old", F.lag("new").over(w)).where("old IS NOT NULL")
    return rows.select("l_orderkey", "l_linenumber", R.changed_besides("old", "new", columns, ["l_shipdate"]).alias("changed"))


@query("p15_lease_expired", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 900 DAY <= TIMESTAMP '{AS_OF}'")
def p15(spark, d):
    lease = F.col("o_orderdate") + F.expr("INTERVAL 900 DAYS")
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "O") & (lease <= F.lit(AS_OF).cast("timestamp_ntz"))).select("o_orderkey")


@query("p16_relative_window", f"SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY")
def p16(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 400 DAYS")).select("o_orderkey")


@query("p17_frame_compatible", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL OR o_orderstatus = 'F'")
def p17(spark, d):
    frame = F.nullif("o_orderstatus", F.lit("P"))
    return table(spark, d, "orders").where(frame.isNull() | (frame == "F")).select("o_orderkey")


@query("p18_clamp_finite", "SELECT event_id, least(greatest(value, 10.0), 60.0) AS value FROM events WHERE value IS NOT NULL AND isfinite(value)")
def p18(spark, d):
    v = F.col("value")
    return table(spark, d, "events").where(~F.isnan(v) & (F.abs(v) < float("inf"))).select("event_id", F.least(F.greatest(v, F.lit(10.0)), F.lit(60.0)).alias("value"))


@query("p19_label_validity", "SELECT p_partkey, length(trim(regexp_replace(p_brand, '^#+|#+$', '', 'g'))) > 0 AS valid FROM part")
def p19(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.length(F.trim(F.expr("trim(BOTH '#' FROM p_brand)"))) > 0).alias("valid"))


@query("p20_reason_cascade", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.02 THEN 'UNDER_EXPOSED' WHEN l_discount > 0.08 THEN 'OVER_EXPOSED' WHEN l_quantity < 5 THEN 'BLURRED' WHEN l_tax > 0.07 THEN 'MOTION' END AS reason FROM lineitem")
def p20(spark, d):
    reason = F.when(F.col("l_discount") < 0.02, "UNDER_EXPOSED").when(F.col("l_discount") > 0.08, "OVER_EXPOSED").when(F.col("l_quantity") < 5, "BLURRED").when(F.col("l_tax") > 0.07, "MOTION")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query("p21_edge_filter_reasons", "SELECT CASE WHEN l_discount = 0 THEN 'UNKNOWN_CLEARANCE' WHEN l_quantity < 10 THEN 'TOO_NARROW' WHEN l_tax > 0.06 THEN 'TOO_STEEP' ELSE 'USABLE' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def p21(spark, d):
    reason = F.when(F.col("l_discount") == 0, "UNKNOWN_CLEARANCE").when(F.col("l_quantity") < 10, "TOO_NARROW").when(F.col("l_tax") > 0.06, "TOO_STEEP").otherwise("USABLE")
    return table(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("p22_retention_due", """SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'P') OR o_totalprice < 1000)
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def p22(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P") | (F.col("o_totalprice") < 1000))
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    paying = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(returned, "o_orderkey", "left_anti").join(paying, "o_custkey", "left_semi").select("o_orderkey")


@query("p23_staging_sweep", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def p23(spark, d):
    busy = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").where(F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz")).join(busy, "o_orderkey", "left_anti").select("o_orderkey")
