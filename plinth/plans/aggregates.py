"""Aggregations (G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation as E
from ..operators import relational as R
from ..sources.tables import table
from .registry import query

MONEY = "decimal(18,6)"


@query("g01_global_count", "SELECT count(*) AS n FROM orders")
def g01(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"))


@query("g02_group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def g02(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("g03_zero_filled_counts", "SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def g03(spark, d):
    return R.zero_filled_counts(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("g04_multi_key", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2")
def g04(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("g05_group_by_expression", "SELECT (p_size // 10)::BIGINT AS band, count(*) AS n FROM part GROUP BY 1")
def g05(spark, d):
    return table(spark, d, "part").groupBy(F.floor(F.col("p_size") / 10).alias("band")).agg(F.count("*").alias("n"))


@query("g06_usage_report", """SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS attempts, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag <> 'R') AS succeeded,
round(sum(l_quantity) FILTER (l_returnflag = 'R'), 4) AS failed_seconds, round(coalesce(sum(l_quantity), 0), 4) AS wall_seconds FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1""")
def g06(spark, d):
    failed = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("attempts"), F.count_if(failed).alias("failed"), F.count_if(~failed).alias("succeeded"),
        F.round(F.sum(F.when(failed, F.col("l_quantity"))), 4).alias("failed_seconds"), F.round(F.coalesce(F.sum("l_quantity"), F.lit(0.0)), 4).alias("wall_seconds"))


@query("g07_nullable_sums", "SELECT l_linenumber, coalesce(sum(CASE WHEN l_linenumber < 4 THEN l_quantity END), 0) AS wall, sum(CASE WHEN l_linenumber < 4 THEN l_quantity END) AS gpu FROM lineitem GROUP BY 1")
def g07(spark, d):
    measured = F.when(F.col("l_linenumber") < 4, F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.coalesce(F.sum(measured), F.lit(0.0)).alias("wall"), F.sum(measured).alias("gpu"))


@query("g08_min_max_avg", "SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def g08(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query("g09_coverage_count", "SELECT o_orderpriority, count(*) AS n, count(nullif(o_orderstatus, 'P')) AS measured FROM orders GROUP BY 1")
def g09(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count(F.nullif("o_orderstatus", F.lit("P"))).alias("measured"))


@query("g10_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def g10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query("g11_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def g11(spark, d):
    found = R.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})
    return found.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query("g12_array_agg_distinct", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type) FILTER (value > 40)), ',') AS kinds FROM events GROUP BY 1")
def g12(spark, d):
    found = F.collect_set(F.when(F.col("value") > 40, F.col("event_type")))  # empty where nothing matched: null, as array_agg has it
    return table(spark, d, "events").groupBy("user_id").agg(F.when(F.size(found) > 0, F.array_join(F.array_sort(found), ",")).alias("kinds"))


@query("g13_string_agg_distinct", "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def g13(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("kinds"))


@query("g14_having", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 30")
def g14(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).where("n > 30")


@query("g15_durations", "SELECT o_orderstatus, round(sum((epoch_us(TIMESTAMP '1998-12-01') - epoch_us(o_orderdate)) / 1e6), 2) AS age_s FROM orders GROUP BY 1")
def g15(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.sum((us(F.lit("1998-12-01")) - us(F.col("o_orderdate"))) / 1e6), 2).alias("age_s"))


@query("g16_daily_trend", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def g16(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("g17_money_by_currency", """WITH m AS (SELECT c_mktsegment AS key, CASE WHEN c_nationkey % 3 = 0 THEN 'EUR' WHEN c_nationkey % 3 = 1 THEN 'USD' ELSE 'INR' END AS currency, sum(o_totalprice::DECIMAL(18,6)) AS amount
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) SELECT key, string_agg(currency || '=' || round(amount, 2)::DECIMAL(38,2), ';' ORDER BY currency) AS amounts FROM m GROUP BY 1""")
def g17(spark, d):
    currency = F.when(F.col("c_nationkey") % 3 == 0, "EUR").when(F.col("c_nationkey") % 3 == 1, "USD").otherwise("INR")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = o.groupBy(F.col("c_mktsegment").alias("key"), currency.alias("currency")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("amount"))
    told = F.concat("currency", F.lit("="), F.round("amount", 2).cast("decimal(38,2)").cast("string"))
    return sums.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(told)), ";").alias("amounts"))


@query("g18_fully_priced_average", """WITH g AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,6)) AS cost, count(*) FILTER (l_discount = 0) AS unpriced, l_orderkey % 5 AS lot FROM lineitem GROUP BY 1)
SELECT lot, count(*) AS groups, round(sum(cost)::DOUBLE / count(*), 4) AS mean_cost FROM g WHERE unpriced = 0 GROUP BY 1""")
def g18(spark, d):
    groups = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("cost"), F.count_if(F.col("l_discount") == 0).alias("unpriced"))
    return groups.where("unpriced = 0").groupBy((F.col("l_orderkey") % 5).alias("lot")).agg(F.count("*").alias("groups"), F.round(F.sum("cost").cast("double") / F.count("*"), 4).alias("mean_cost"))


@query("g19_reason_by_prefix", "SELECT split_part(o_orderpriority, '-', 1) AS reason, count(*) AS n FROM orders GROUP BY 1")
def g19(spark, d):
    return table(spark, d, "orders").groupBy(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


@query("g20_mean_over_distinct", "SELECT label, count(*) AS peers, round(avg(first), 5) AS mean FROM (SELECT DISTINCT label, embedding, embedding[1]::DOUBLE AS first FROM embeddings) GROUP BY 1")
def g20(spark, d):
    e = table(spark, d, "embeddings").select("label", "embedding").dropDuplicates()
    return e.groupBy("label").agg(F.count("*").alias("peers"), F.round(F.avg(F.col("embedding")[0].cast("double")), 5).alias("mean"))


@query("g21_best_label_similarity", """WITH l AS (SELECT label AS l, embedding AS v FROM embeddings WHERE vec_id < 8)
SELECT vec_id, round(max(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(v::DOUBLE[], v::DOUBLE[]))), 6) AS best FROM embeddings, l GROUP BY 1""")
def g21(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    labels = e.where("vec_id < 8").agg(F.collect_list("embedding").alias("labels"))  # eight label vectors: one row, held against every vector without multiplying rows
    return e.crossJoin(F.broadcast(labels)).select("vec_id", F.round(F.array_max(F.transform("labels", lambda v: V.cosine_similarity(F.col("embedding"), v))), 6).alias("best"))


_LABELLED = "SELECT (l_linenumber % 4)::INT AS truth, ((l_linenumber + (CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END)) % 4)::INT AS said FROM lineitem"


def _labelled(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select((n % 4).alias("truth"), ((n + F.when(F.col("l_quantity") > 40, 1).otherwise(0)) % 4).alias("said"))


@query("g22_confusion_matrix", f"SELECT truth, said, count(*) AS n FROM ({_LABELLED}) GROUP BY 1, 2")
def g22(spark, d):
    return E.confusion(_labelled(spark, d), "truth", "said")


@query("g23_class_iou", f"""WITH c AS (SELECT truth, said, count(*) AS n FROM ({_LABELLED}) GROUP BY 1, 2), k AS (SELECT truth AS class FROM c UNION SELECT said FROM c)
SELECT class, round(coalesce(sum(n) FILTER (truth = class AND said = class), 0) / sum(n) FILTER (truth = class OR said = class), 6) AS iou FROM c, k GROUP BY 1""")
def g23(spark, d):
    return E.class_iou(E.confusion(_labelled(spark, d), "truth", "said")).select("class", F.round("iou", 6).alias("iou"))


@query("g24_pixel_accuracy", f"SELECT round(count(*) FILTER (truth = said) / count(*), 6) AS accuracy FROM ({_LABELLED})")
def g24(spark, d):
    return E.pixel_accuracy(E.confusion(_labelled(spark, d), "truth", "said")).select(F.round("accuracy", 6).alias("accuracy"))


@query("g25_bootstrap_interval")
def g25(spark, d):
    return E.bootstrap_interval(table(spark, d, "events").select(F.col("event_type").alias("key"), "value"), "key", "value", 1000)


@query("g26_paired_bootstrap")
def g26(spark, d):
    return E.paired_bootstrap(table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").alias("a"), (F.col("value") * 0.9 + 3).alias("b")), "key", "a", "b", 1000)


_SCORED = "SELECT l_linenumber AS class, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS score, l_returnflag = 'R' AS hit FROM lineitem"


def _scored(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("class"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("hit"))


@query("g27_average_precision", f"""WITH s AS ({_SCORED}), r AS (SELECT class, hit, row_number() OVER w AS k, sum(hit::INT) OVER w AS tp, sum(hit::INT) OVER (PARTITION BY class) AS total FROM s WINDOW w AS (PARTITION BY class ORDER BY score DESC, id)),
p AS (SELECT class, hit, k, total, max(tp / k) OVER (PARTITION BY class ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM r)
SELECT class, round(sum(CASE WHEN hit THEN envelope ELSE 0 END) / max(total), 6) AS ap FROM p GROUP BY 1""")
def g27(spark, d):
    return E.average_precision(_scored(spark, d), ["class"], [F.col("score").desc(), F.col("id")], "hit").select("class", F.round("ap", 6).alias("ap"))


@query("g28_precision_recall", f"SELECT class, round(count(*) FILTER (hit AND score > 30000) / nullif(count(*) FILTER (score > 30000), 0), 6) AS precision, round(count(*) FILTER (hit AND score > 30000) / nullif(count(*) FILTER (hit), 0), 6) AS recall FROM ({_SCORED}) GROUP BY 1")
def g28(spark, d):
    return E.precision_recall(_scored(spark, d), ["class"], F.col("score") > 30000, F.col("hit")).select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("g29_retrieval_metrics", f"""WITH s AS ({_SCORED}), r AS (SELECT class, hit, row_number() OVER w AS k, sum(hit::INT) OVER w AS tp, sum(hit::INT) OVER (PARTITION BY class) AS total FROM s WINDOW w AS (PARTITION BY class ORDER BY score DESC, id))
SELECT class, round(sum(hit::INT) FILTER (k <= 10) / max(total), 6) AS recall_at_10, round(sum(hit::INT) FILTER (k <= 10) / 10, 6) AS precision_at_10, round(sum(CASE WHEN hit THEN tp / k ELSE 0 END) / max(total), 6) AS ap FROM r WHERE total > 0 GROUP BY 1""")
def g29(spark, d):
    m = E.retrieval_metrics(_scored(spark, d), ["class"], [F.col("score").desc(), F.col("id")], "hit", 10)
    return m.select("class", *[F.round(c, 6).alias(c) for c in ("recall_at_10", "precision_at_10", "ap")])


@query("g30_zero_shot_top1", """WITH l AS (SELECT label AS said, embedding AS v FROM embeddings WHERE vec_id < 10), s AS (SELECT vec_id, label, arg_max(said, (round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 9), -said)) AS best FROM embeddings, l GROUP BY 1, 2)
SELECT round(count(*) FILTER (best = label) / count(*), 6) AS top1 FROM s""")
def g30(spark, d):
    e = table(spark, d, "embeddings")
    labels = e.where("vec_id < 10").agg(F.collect_list(F.struct(F.col("label").alias("said"), F.col("embedding").alias("v"))).alias("labels"))  # ten class vectors
    best = F.array_max(F.transform("labels", lambda x: F.struct(F.round(V.dot(F.col("embedding"), x.v), 9).alias("s"), (-x.said).alias("k"))))
    return e.crossJoin(F.broadcast(labels)).agg(F.round(F.count_if(-best["k"] == F.col("label")) / F.count("*"), 6).alias("top1"))


@query("g31_weighted_vote", """WITH v AS (SELECT l_partkey AS point, l_linenumber AS class, sum(round(l_discount * 100)::BIGINT) AS w FROM lineitem GROUP BY 1, 2),
b AS (SELECT point, arg_max(class, (w, -class)) AS class, max(w) AS w, sum(w) AS total FROM v GROUP BY 1) SELECT point, CASE WHEN w >= 10 AND w / nullif(total, 0) >= 0.3 THEN class ELSE -1 END AS class FROM b""")
def g31(spark, d):
    votes = table(spark, d, "lineitem").select(F.col("l_partkey").alias("point"), F.col("l_linenumber").alias("class"), F.round(F.col("l_discount") * 100).cast("long").alias("w"))
    return E.weighted_vote(votes, "point", "class", "w", least=10, share=0.3, unknown=-1)


@query("g32_share_bands", "SELECT CASE WHEN l_discount < 0.02 THEN 'low' WHEN l_discount < 0.05 THEN 'middle' WHEN l_discount < 0.09 THEN 'high' ELSE 'top' END AS band, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1")
def g32(spark, d):
    band = F.when(F.col("l_discount") < 0.02, "low").when(F.col("l_discount") < 0.05, "middle").when(F.col("l_discount") < 0.09, "high").otherwise("top")
    counts = table(spark, d, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return counts.select("band", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("g40_detection_clusters", """SELECT label, round(avg(embedding[1]::DOUBLE), 5) AS x, round(avg(embedding[2]::DOUBLE), 5) AS y, max(round(embedding[3]::DOUBLE, 6)) AS confidence, arg_max(vec_id, (embedding[3], -vec_id)) AS strongest,
count(DISTINCT vec_id % 16) AS frames, round(median(embedding[4]::DOUBLE), 6) AS depth_spread, round(sqrt(var_pop(embedding[1]::DOUBLE) + var_pop(embedding[2]::DOUBLE)), 5) AS rms FROM embeddings GROUP BY 1""")
def g40(spark, d):
    x = lambda i: F.col("embedding")[i].cast("double")
    spread = R.percentiles(table(spark, d, "embeddings").select(F.col("label").alias("of"), x(3).alias("depth")), ["of"], "depth", {"middle": 0.5})
    found = table(spark, d, "embeddings").groupBy("label").agg(
        F.round(F.avg(x(0)), 5).alias("x"), F.round(F.avg(x(1)), 5).alias("y"), F.max(F.round(x(2), 6)).alias("confidence"), (-F.max(F.struct(x(2), -F.col("vec_id")))["col2"]).alias("strongest"),
        F.count_distinct(F.col("vec_id") % 16).alias("frames"), F.round(F.sqrt(F.var_pop(x(0)) + F.var_pop(x(1))), 5).alias("rms"))
    return found.join(spread, F.col("label").eqNullSafe(F.col("of"))).select("label", "x", "y", "confidence", "strongest", "frames", F.round("middle", 6).alias("depth_spread"), "rms")


@query("g41_split_statistics", "SELECT lang, count(*) AS n, round(count(*) / (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)), 6) AS imbalance FROM documents GROUP BY 1")
def g41(spark, d):
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select("lang", "n", F.round(F.col("n") / F.min("n").over(Window.partitionBy()), 6).alias("imbalance"))


@query("g42_recent_summary", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(avg((event_type = 'view')::INT), 6) AS duplicate_rate, round(avg(CASE WHEN event_type = 'error' THEN value END), 6) AS spacing FROM r WHERE k <= 60 GROUP BY 1""")
def g42(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = table(spark, d, "events").withColumn("k", k).where("k <= 60")
    return recent.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("event_type") == "view").cast("int")), 6).alias("duplicate_rate"), F.round(F.avg(F.when(F.col("event_type") == "error", F.col("value"))), 6).alias("spacing"))


@query("g43_warning_streaks", """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_type AS code, count(*) AS n FROM r WHERE k <= 5 GROUP BY 1, 2 HAVING count(*) >= 3""")
def g43(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    codes = table(spark, d, "events").withColumn("k", k).where("k <= 5").select("user_id", F.explode(F.array("event_type")).alias("code"))
    return codes.groupBy("user_id", "code").agg(F.count("*").alias("n")).where("n >= 3")


@query("g44_evidence_counts", "SELECT 'priority' AS kind, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2")
def g44(spark, d):
    o = table(spark, d, "orders")
    return E.counts_by(o, {"priority": "o_orderpriority", "status": "o_orderstatus"})


@query("g45_defect_summary", """SELECT code, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 4) AS rate FROM (SELECT unnest(list_filter([CASE WHEN l_discount < 0.02 THEN 'DARK' END, CASE WHEN l_quantity < 5 THEN 'BLUR' END, CASE WHEN l_tax > 0.06 THEN 'MOTION' END], lambda x: x IS NOT NULL)) AS code FROM lineitem) GROUP BY 1""")
def g45(spark, d):
    codes = F.array_compact(F.array(F.when(F.col("l_discount") < 0.02, "DARK"), F.when(F.col("l_quantity") < 5, "BLUR"), F.when(F.col("l_tax") > 0.06, "MOTION")))
    rows = table(spark, d, "lineitem").select(codes.alias("codes"))
    counts = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).select("code", "n", F.round(F.col("n") / F.col("total"), 4).alias("rate"))


@query("g46_latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def g46(spark, d):
    found = R.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p99": 0.99})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query("g47_search_scoring", f"""WITH s AS ({_SCORED}), r AS (SELECT class, hit, row_number() OVER (PARTITION BY class, id // 1000 ORDER BY score DESC, id) AS k, id // 1000 AS q FROM s), a AS (SELECT class, q, bool_or(hit AND k = 1) AS t1, bool_or(hit AND k <= 5) AS t5 FROM r GROUP BY 1, 2)
SELECT class, count(*) AS queries, round(count(*) FILTER (t1) / count(*), 6) AS top1, round(count(*) FILTER (t5) / count(*), 6) AS top5 FROM a GROUP BY 1""")
def g47(spark, d):
    s = _scored(spark, d).withColumn("q", F.floor(F.col("id") / 1000))
    return E.search_scores(s, "class", "q", [F.col("score").desc(), F.col("id")], "hit").select("class", "queries", F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"))


@query("g48_threshold_calibration", """WITH s AS (SELECT round(value, 1) AS v, event_type IN ('purchase', 'signup') AS good FROM events), t AS (SELECT v, count(*) FILTER (good) AS p, count(*) FILTER (NOT good) AS n FROM s GROUP BY 1),
c AS (SELECT v, sum(p) OVER (ORDER BY v DESC) AS tp, sum(n) OVER (ORDER BY v DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM t), b AS (SELECT v, round((tp / pp + 1 - fp / nn) / 2, 9) AS balanced FROM c)
SELECT v AS threshold, balanced FROM b ORDER BY balanced DESC, v LIMIT 1""")
def g48(spark, d):
    s = table(spark, d, "events").select(F.round("value", 1).alias("score"), F.col("event_type").isin("purchase", "signup").alias("good"))
    return E.calibrate_threshold(s, "score", "good").select("threshold", "balanced")


@query("g49_kept_jaccard", "SELECT round(count(*) FILTER (l_quantity > 10 AND l_discount > 0.02) / count(*) FILTER (l_quantity > 10 OR l_discount > 0.02), 6) AS jaccard FROM lineitem")
def g49(spark, d):
    return table(spark, d, "lineitem").agg(F.round(E.jaccard(F.col("l_quantity") > 10, F.col("l_discount") > 0.02), 6).alias("jaccard"))


@query("g50_random_ranking_reference", "SELECT event_type, round(least(1.0, 5.0 / count(*)), 9) AS expected_top5, round(1.0 / count(*), 9) AS expected_top1 FROM events GROUP BY 1")
def g50(spark, d):
    n = F.count("*")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.least(F.lit(1.0), 5.0 / n), 9).alias("expected_top5"), F.round(1.0 / n, 9).alias("expected_top1"))
