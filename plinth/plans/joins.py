"""Joins, set operations and recursion (J, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs
from ..operators import relational as R
from ..sources.tables import table
from .registry import query


@query("j01_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j01(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j02_inner_chain", """SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def j02(spark, d):
    t = lambda n: table(spark, d, n)
    # the fact table is summed by order before it meets anything: a fifth of the rows reach the joins
    by_order = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    chain = by_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    chain = chain.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chain.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("j03_left_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def j03(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j04_left_outer_chain", """SELECT n_nationkey, count(c_custkey) AS customers, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def j04(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    chain = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return chain.groupBy("n_nationkey").agg(F.count("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


@query("j05_lateral_top1", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN r ON o_custkey = c_custkey AND k = 1""")
def j05(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return R.lateral_first(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).drop("o_orderdate")


@query("j06_lateral_aggregate", "SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j06(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.lateral_aggregate(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], [F.count("*").alias("n"), F.max("o_totalprice").alias("top")], zero=["n"])


@query("j07_lateral_best_match", """SELECT p_partkey, term, score FROM (SELECT p_partkey, term, length(term) - abs(length(p_name) - length(term)) AS score,
row_number() OVER (PARTITION BY p_partkey ORDER BY length(term) - abs(length(p_name) - length(term)) DESC, ord) AS k
FROM part, (VALUES ('small red part', 0), ('big part', 1), ('a', 2)) t(term, ord)) WHERE k = 1""")
def j07(spark, d):
    # three literal terms: an array in each row instead of a join
    terms = F.array(*[F.struct(F.lit(x).alias("term"), F.lit(-i).alias("ord")) for i, x in enumerate(("small red part", "big part", "a"))])
    scored = F.transform(terms, lambda t: F.struct((F.length(t.term) - F.abs(F.length("p_name") - F.length(t.term))).alias("score"), t.ord.alias("ord"), t.term.alias("term")))
    best = table(spark, d, "part").select("p_partkey", F.array_max(scored).alias("b"))
    return best.select("p_partkey", "b.term", F.col("b.score").cast("long").alias("score"))


@query("j08_lateral_unnest", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def j08(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode_outer(F.split("p_name", " ")).alias("word"))


@query("j09_scalar_scope", "SELECT p_partkey, round(p_retailprice - (SELECT avg(p_retailprice) FROM part), 6) AS above FROM part")
def j09(spark, d):
    p = table(spark, d, "part")
    mean = p.agg(F.avg("p_retailprice").alias("mean"))  # one row
    return p.crossJoin(F.broadcast(mean)).select("p_partkey", F.round(F.col("p_retailprice") - F.col("mean"), 6).alias("above"))


@query("j10_scalar_ctes", "SELECT c_custkey, c_acctbal >= (SELECT avg(c_acctbal) FROM customer) AND (SELECT count(*) FROM nation) > 2 AS relevant FROM customer")
def j10(spark, d):
    c = table(spark, d, "customer")
    stats, labels = c.agg(F.avg("c_acctbal").alias("mean")), table(spark, d, "nation").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(labels)).select("c_custkey", ((F.col("c_acctbal") >= F.col("mean")) & (F.col("n") > 2)).alias("relevant"))


@query("j11_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j11(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("j12_anti_composite", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = 'R')")
def j12(spark, d):
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return pairs.select("l_partkey", "l_suppkey").distinct().join(pairs.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"], "left_anti")


@query("j13_anti_theta", "SELECT a.o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate AND (b.o_orderstatus = a.o_orderstatus OR b.o_totalprice > a.o_totalprice))")
def j13(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    b = a.select(*[F.col(c).alias(f"b_{c}") for c in a.columns])
    later = (F.col("b_o_custkey") == F.col("o_custkey")) & (F.col("b_o_orderdate") > F.col("o_orderdate")) & ((F.col("b_o_orderstatus") == F.col("o_orderstatus")) | (F.col("b_o_totalprice") > F.col("o_totalprice")))
    return a.join(b, later, "left_anti").select("o_orderkey")


@query("j14_exists_column", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS large FROM customer")
def j14(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey")
    return R.exists_flag(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "large")


@query("j15_correlated_count", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS n FROM supplier")
def j15(spark, d):
    items = table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_suppkey", "s_suppkey")
    return R.lateral_aggregate(table(spark, d, "supplier").select("s_suppkey"), items, ["s_suppkey"], [F.count("*").alias("n")], zero=["n"])


@query("j16_max_version_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem a WHERE l_linenumber = (SELECT max(l_linenumber) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey)")
def j16(spark, d):
    from pyspark.sql import Window

    top = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return table(spark, d, "lineitem").withColumn("top", top).where("l_linenumber = top").select("l_orderkey", "l_linenumber", "l_partkey")


@query("j17_latest_of_stage", """SELECT event_id, event_id = arg_max(event_id, (ts, event_id)) OVER (PARTITION BY user_id, event_type) AS latest FROM events""")
def j17(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, d, "events").select("event_id", (F.row_number().over(w) == 1).alias("latest"))


@query("j18_correlated_distinct", "SELECT o_orderkey, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS suppliers FROM orders")
def j18(spark, d):
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.lateral_aggregate(table(spark, d, "orders").select("o_orderkey"), items, ["o_orderkey"], [F.count_distinct("l_suppkey").alias("suppliers")], zero=["suppliers"])


@query("j19_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def j19(spark, d):
    items = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    parts = table(spark, d, "part").select("p_partkey")
    return parts.join(items.where("l_quantity > 45"), "p_partkey", "left_semi").join(items.where("l_returnflag = 'R'"), "p_partkey", "left_anti")


@query("j25_interval_join", """SELECT a.event_id, count(b.event_id) AS near FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'error'
AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 WHERE a.event_type = 'click' GROUP BY 1""")
def j25(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    visits, errors = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'error'").select("user_id", F.col("at").alias("error_at"))
    found = R.interval_join(visits, errors, "user_id", "at", "error_at", 3600.0).groupBy("event_id").agg(F.count("*").alias("near"))
    return visits.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("near", F.lit(0)).alias("near"))


@query("j26_previous_sample", """SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 6) AS gap_s, round(value - lag(value) OVER w, 6) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def j26(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.round((us - F.lag(us).over(w)) / 1e6, 6).alias("gap_s"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"))


@query("j31_box_iou", """WITH b AS (SELECT p_partkey AS id, p_size % 10 AS x, p_size % 7 AS y, 5 + p_partkey % 3 AS w, 4.0 AS h FROM part),
p AS (SELECT a.id, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM b a JOIN b ON b.id = a.id + 1)
SELECT id, round(i / (s - i), 6) AS iou FROM p""")
def j31(spark, d):
    from ..functions import geometry as G

    k = F.col("p_partkey")
    b = table(spark, d, "part").select(k.alias("id"), F.struct((F.col("p_size") % 10).cast("double").alias("x"), (F.col("p_size") % 7).cast("double").alias("y"), (5 + k % 3).cast("double").alias("w"), F.lit(4.0).alias("h")).alias("box"))
    other = b.select((F.col("id") - 1).alias("id"), F.col("box").alias("other"))
    return b.join(other, "id").select("id", F.round(G.box_iou(F.col("box"), F.col("other")), 6).alias("iou"))


@query("j32_queue_pop", "SELECT event_type, min(event_id) AS event_id FROM events a WHERE ts = (SELECT min(ts) FROM events b WHERE b.event_type = a.event_type) GROUP BY 1")
def j32(spark, d):
    # the read side of a queue: the oldest entry of each stage; Spark has no row lock, so one writer consumes it
    return R.first_per_key(table(spark, d, "events"), ["event_type"], [F.col("ts"), F.col("event_id")]).select("event_type", "event_id")


@query("u01_union_then_group", "SELECT name, count(*) AS n FROM (SELECT c_mktsegment AS name FROM customer UNION ALL SELECT o_orderpriority FROM orders) GROUP BY 1")
def u01(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")), table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"))
    return a.unionByName(b).groupBy("name").agg(F.count("*").alias("n"))


@query("u02_union_of_tops", "(SELECT o_orderkey AS k, o_totalprice AS v FROM orders ORDER BY 2 DESC, 1 LIMIT 7) UNION ALL (SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC, 1 LIMIT 5)")
def u02(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")).orderBy(F.desc("v"), "k").limit(7)
    return a.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")).orderBy(F.desc("v"), "k").limit(5))


@query("u03_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u03(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u04_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def u04(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("u05_set_difference", "SELECT user_id, list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(list(DISTINCT event_type), x)))::VARCHAR AS unserved FROM events GROUP BY 1")
def u05(spark, d):
    return _unserved(table(spark, d, "events"))


def _unserved(events):
    every = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    found = events.groupBy("user_id").agg(F.collect_set("event_type").alias("served"))
    return found.select("user_id", F.concat(F.lit("["), F.array_join(F.array_sort(F.array_except(every, "served")), ", "), F.lit("]")).alias("unserved"))


_TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, p_size AS version FROM part"


def _versions(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.when(k > 1, F.floor(k / 2)).alias("parent"), F.col("p_size").alias("version"))


@query("u06_recursive_ancestors", f"""WITH RECURSIVE t AS ({_TREE}), l AS (SELECT id AS start, id, parent, 0 AS depth FROM t
UNION ALL SELECT l.start, t.id, t.parent, depth + 1 FROM l JOIN t ON t.id = l.parent) SELECT start, id, depth FROM l""")
def u06(spark, d):
    return graphs.ancestors(_versions(spark, d), "id", "parent", F.lit(True))


@query("u07_best_in_lineage", f"""WITH RECURSIVE t AS ({_TREE}), l AS (SELECT id AS start, id, parent, version FROM t
UNION ALL SELECT l.start, t.id, t.parent, t.version FROM l JOIN t ON t.id = l.parent), r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY (version % 2 = 0) DESC, version DESC, id) AS k FROM l)
SELECT start, id, version FROM r WHERE k = 1""")
def u07(spark, d):
    return _best_in_lineage(_versions(spark, d), F.lit(True))


def _best_in_lineage(t, is_start):
    line = graphs.ancestors(t, "id", "parent", is_start).join(t.select("id", "version").hint("merge"), "id")  # no broadcast through the driver
    return R.first_per_key(line, ["start"], [(F.col("version") % 2 == 0).desc(), F.col("version").desc(), F.col("id")]).select("start", "id", "version")


@query("u08_is_current", f"""WITH RECURSIVE t AS ({_TREE}), l AS (SELECT id, parent FROM t WHERE id = (SELECT max(id) FROM t)
UNION ALL SELECT t.id, t.parent FROM l JOIN t ON t.id = l.parent) SELECT id, id IN (SELECT id FROM l) AS current FROM t""")
def u08(spark, d):
    t = _versions(spark, d)
    top = t.agg(F.max("id").alias("top"))
    line = graphs.ancestors(t.join(F.broadcast(top)), "id", "parent", F.col("id") == F.col("top"))
    return R.exists_flag(t.select("id"), line, ["id"], "current")


@query("u09_closure", """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, (user_id * 3 + 1) % 60 AS b FROM events), c AS (SELECT 1::BIGINT AS id UNION SELECT b FROM c JOIN e ON a = id) SELECT id FROM c""")
def u09(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("a"), ((F.col("user_id") * 3 + 1) % 60).alias("b")).distinct()
    return graphs.closure(spark.createDataFrame([(1,)], "id long"), [lambda known: known.join(e, known["id"] == e["a"]).select(F.col("b").alias("id"))])


@query("u10_one_pass_derivation", """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone) UNION ALL SELECT 'customer', c_custkey FROM gone""")
def u10(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    o = table(spark, d, "orders").join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return o.unionByName(gone.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")))


@query("u11_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT user_id FROM events) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def u11(spark, d):
    left = table(spark, d, "customer").select("c_custkey")
    for name, column in (("orders", "o_custkey"), ("events", "user_id"), ("supplier", "s_suppkey")):
        left = left.join(table(spark, d, name).select(F.col(column).alias("c_custkey")), "c_custkey", "left_anti")
    return left
