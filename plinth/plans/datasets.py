"""Data-set quality and stage plans (D, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets as D
from ..operators import relational as R
from ..sources.tables import table
from .registry import query

_SPLIT = "CASE WHEN {0} % 10 < 7 THEN 'train' WHEN {0} % 10 < 9 THEN 'val' ELSE 'test' END"
LANGS = ("en", "de", "fr", "es")
STAGES = ("view", "click", "purchase")


def _split(key):
    return F.expr(_SPLIT.format(key))


@query("d01_duplicate_ids", "SELECT conv_id, count(*) - 1 AS repeats FROM conversations GROUP BY 1 HAVING count(*) > 1")
def d01(spark, d):
    return D.repeated_ids(table(spark, d, "conversations"), "conv_id")


@query("d02_duplicate_content", "WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL) SELECT doc_id, first FROM m WHERE doc_id > first")
def d02(spark, d):
    return D.repeated_content(table(spark, d, "documents"), "doc_id", "text")


@query("d03_group_leakage", f"SELECT o_custkey AS \"group\", list_sort(list(DISTINCT {_SPLIT.format('o_orderkey')})) AS splits FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_SPLIT.format('o_orderkey')}) > 1")
def d03(spark, d):
    return D.leaking_groups(table(spark, d, "orders"), F.col("o_custkey"), _split("o_orderkey"))


@query("d04_content_leakage", f"SELECT sha256(text) AS \"group\", list_sort(list(DISTINCT {_SPLIT.format('doc_id')})) AS splits FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_SPLIT.format('doc_id')}) > 1")
def d04(spark, d):
    return D.leaking_groups(table(spark, d, "documents"), F.sha2("text", 256), _split("doc_id"))


@query("d05_missing_references", "SELECT doc_id, quality FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents AS p WHERE p.doc_id = labels.doc_id AND lang = 'en')")
def d05(spark, d):
    english = table(spark, d, "documents").where("lang = 'en'")
    return D.missing_references(table(spark, d, "labels").select("doc_id", "quality"), english, "doc_id")


@query("d06_domain_violations", "SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr')")
def d06(spark, d):
    return table(spark, d, "documents").where(~F.coalesce(F.col("lang").isin("en", "de", "fr"), F.lit(False))).select("doc_id", "lang")


@query("d07_boxes_outside", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity >= -1 AND l_discount * 100 >= -1 AND l_tax * 100 > 0 AND l_quantity + l_tax * 100 <= 48 + 1 AND l_discount * 100 + 1 <= 9 + 1)")
def d07(spark, d):
    inside = D.box_inside(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.lit(1), F.lit(48), F.lit(9))
    return table(spark, d, "lineitem").where(~inside).select("l_orderkey", "l_linenumber")


@query("d08_review_admission", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' WHEN quality = 0 THEN 'needs_review' ELSE 'unreviewed' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def d08(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "needs_review").otherwise("unreviewed")
    return joined.select("doc_id", status.alias("status"))


@query("d09_unlabelled", "SELECT doc_id FROM documents WHERE source IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def d09(spark, d):
    return D.missing_references(table(spark, d, "documents").where("source IS NOT NULL").select("doc_id"), table(spark, d, "labels").where("toxic = 0"), "doc_id")


@query("d10_class_balance", f"""WITH c AS (SELECT {_SPLIT.format('doc_id')} AS split, {', '.join(f"count(*) FILTER (lang = '{c}') AS n_{c}" for c in LANGS)} FROM documents GROUP BY 1)
SELECT *, ({' + '.join(f'(n_{c} = 0)::BIGINT' for c in LANGS)}) AS absent, greatest({', '.join(f'nullif(n_{c}, 0)' for c in LANGS)}) / least({', '.join(f'nullif(n_{c}, 0)' for c in LANGS)}) AS ratio FROM c""")
def d10(spark, d):
    return D.class_balance(table(spark, d, "documents"), _split("doc_id"), "lang", LANGS)


@query("d11_fingerprint", f"""WITH r AS (SELECT sha256(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || coalesce(text, chr(0))) AS h FROM documents),
s AS (SELECT count(*) AS n, {', '.join(f"coalesce(sum(('0x' || substr(h, {1 + i * D.LANE_DIGITS}, {D.LANE_DIGITS}))::BIGINT), 0)::VARCHAR AS l{i}" for i in range(D.LANES))} FROM r)
SELECT n, sha256(concat_ws(':', n::VARCHAR, l0, l1, l2, l3)) AS fingerprint FROM s""")
def d11(spark, d):
    return D.fingerprint(table(spark, d, "documents"), F.col("doc_id"), F.col("text"))


@query("d12_selection_by_share", """WITH g AS (SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0) AS share, bool_or(coalesce(l_returnflag = 'R', true)) AS banned FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(share, 9) AS share FROM g WHERE NOT banned AND share BETWEEN 0.2 AND 0.9""")
def d12(spark, d):
    chosen = D.selected_by_share(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", F.col("l_linestatus") == "O", F.col("l_returnflag") == "R", 0.2, 0.9)
    return chosen.withColumn("share", F.round("share", 9))


@query("d13_privacy_admission", f"SELECT conv_id, count(*) AS n, bool_and(coalesce(NOT regexp_matches(text, '{D.EMAIL}'), false)) AS admitted FROM conversations GROUP BY 1")
def d13(spark, d):
    return D.admitted_groups(table(spark, d, "conversations"), "conv_id", ~F.col("text").rlike(D.EMAIL))


@query("d14_group_split", "WITH h AS (SELECT o_orderkey, ('0x' || left(sha256('fold:' || o_custkey), 12))::BIGINT / 281474976710656.0 AS s FROM orders) SELECT o_orderkey, CASE WHEN s < 0.7 THEN 'train' WHEN s < 0.85 THEN 'val' ELSE 'test' END AS split FROM h")
def d14(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.split_of("fold", F.col("o_custkey").cast("string")).alias("split"))


@query("d15_pii_gate", f"SELECT doc_id, n_chars FROM documents WHERE NOT coalesce(regexp_matches(text, '{D.EMAIL}'), false)")
def d15(spark, d):
    return D.without_pii(table(spark, d, "documents"), "text").select("doc_id", "n_chars")


@query("n02_missing_outputs", "WITH m AS (SELECT user_id, list(DISTINCT event_type) AS made FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1) SELECT user_id, list_filter(['view', 'click', 'purchase'], lambda x: NOT list_contains(made, x)) AS missing FROM m")
def n02(spark, d):
    return D.missing_outputs(table(spark, d, "events").where("ts < TIMESTAMP_NTZ '2024-01-02'"), "user_id", "event_type", STAGES)


@query("n03_readable_inputs", "SELECT event_id, stage FROM events JOIN (VALUES ('train', 'view'), ('train', 'click'), ('export', 'purchase')) AS c(stage, kind) ON kind = event_type")
def n03(spark, d):
    contract = spark.createDataFrame([("train", "view"), ("train", "click"), ("export", "purchase")], "stage string, event_type string")
    return table(spark, d, "events").select("event_id", "event_type").join(contract, "event_type").select("event_id", "stage")


@query("n04_next_stage", "SELECT event_id, CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'purchase' END AS stage FROM events")
def n04(spark, d):
    return table(spark, d, "events").select("event_id", D.next_stage(F.array(*map(F.lit, STAGES)), F.col("event_type")).alias("stage"))


@query("n05_resumable_checkpoint", "SELECT user_id, max(event_id) AS checkpoint FROM events AS e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events AS x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND (x.props = e.props)) GROUP BY 1")
def n05(spark, d):
    e = table(spark, d, "events")
    failed = e.where("event_type = 'error'").select("user_id", "props")
    return e.where("event_type = 'view'").join(failed, ["user_id", "props"], "left_anti").groupBy("user_id").agg(F.max("event_id").alias("checkpoint"))


@query("n06_latest_artifact_of_kind", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def n06(spark, d):
    return R.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("n01_stage_plans", """WITH k AS (SELECT c_custkey AS run, c_nationkey % 4 AS kind, c_custkey % 2 = 0 AS privacy, c_custkey % 3 = 0 AS navigation FROM customer)
SELECT run, CASE kind WHEN 0 THEN 12 - (NOT privacy)::INT WHEN 1 THEN 14 - (NOT privacy)::INT - (NOT navigation)::INT WHEN 2 THEN 10 - (NOT privacy)::INT ELSE 5 END AS stages, kind <> 3 AND privacy AS private, kind IN (0, 3) OR (kind = 1 AND navigation) AS baked FROM k""")
def n01(spark, d):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("FULL", "INCREMENTAL", "ROOM", "STITCH"))), F.col("c_nationkey") % 4 + 1)
    plan = D.stage_plan(kind, k % 2 == 0, k % 3 == 0)
    return table(spark, d, "customer").select(k.alias("run"), F.size(plan).alias("stages"), F.array_contains(plan, "PRIVACY_PREPROCESS").alias("private"), F.array_contains(plan, "NAVIGATION_BAKING").alias("baked"))


@query("n07_supersede_in_region", """SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 AND p_size % 7 <> 0 AND p_partkey % 5 < 2 AND p_partkey % 13 * 0.4 BETWEEN 1 AND 3 AND p_partkey % 7 * 0.4 BETWEEN 0.5 AND 1.9 THEN (p_partkey % 5 + 10)::INT END AS superseded_by FROM part""")
def n07(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    points = table(spark, d, "part").select(k.alias("id"), (k % 5).cast("int").alias("floor"), F.when(s % 3 != 0, "AUTO_DETECTED").otherwise("MANUAL").alias("source"), (s % 7 == 0).alias("deleted"), (k % 13 * 0.4).alias("x"), (k % 7 * 0.4).alias("y"))
    box = [(1.0, 0.5), (3.0, 0.5), (3.0, 1.9), (1.0, 1.9)]
    regions = spark.createDataFrame([(0, 10, box), (1, 11, box), (1, 12, box), (2, 13, box[:2])], "floor int, version int, ring array<struct<x:double,y:double>>")
    return D.supersede_in_region(points, regions).select("id", "superseded_by")


@query("f23_rate_cards", """SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN NULL WHEN 1 THEN 'NOT_JSON' WHEN 2 THEN 'UNKNOWN_FIELD' WHEN 3 THEN 'CURRENCY' WHEN 4 THEN 'WORKER_CLASSES' WHEN 5 THEN 'CLASS_NAME' WHEN 6 THEN 'KIND' WHEN 7 THEN CASE WHEN p_retailprice > 1000 THEN 'RATE' END ELSE 'SOURCE' END AS problem FROM part""")
def f23(spark, d):
    card = lambda name="gpu-1", kind="LOCAL_HARDWARE", hourly=F.lit("1.25"), source="list of 2024", currency="USD", more="": F.concat(F.lit(f'{{"currency":"{currency}",{more}"workerClasses":{{"{name}":{{"hourly":'), hourly, F.lit(f',"kind":"{kind}","source":"{source}"}}}}}}'))
    price = F.when(F.col("p_retailprice") > 1000, F.lit("-1")).otherwise(F.col("p_retailprice").cast("string"))
    kinds = [card(), F.lit("{nope"), card(more='"extra":1,'), card(currency="usd"), F.lit('{"currency":"EUR","workerClasses":{}}'), card(name="no spaces"), card(kind="GUESS"), card(hourly=price), card(source=" ")]
    text = F.coalesce(*[F.when(F.col("p_size") % 9 == i, c) for i, c in enumerate(kinds)])
    return table(spark, d, "part").select("p_partkey", D.rate_card_problem(text).alias("problem"))
