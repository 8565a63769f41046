"""Hybrid search (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..sources.files import append_returning
from ..sources.shared import shared_dir
from ..sources.tables import table
from .expressions import strict_similarity_sql
from .registry import query


def _points(spark, d):
    """Parts as points of interest; the vector of the same number is their text embedding, the next one their image embedding."""
    e = table(spark, d, "embeddings")
    text = e.select((F.col("vec_id") + 1).alias("id"), "embedding")
    image = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("image_embedding"))
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("category"), F.split("p_type", " ").alias("tags"),
        F.when(F.col("p_size") % 3 == 0, (F.col("p_size") % 10) / 10.0).alias("confidence"), (1 + F.col("p_size") % 3).alias("views"),
        F.when(F.col("p_size") % 4 != 1, F.col("p_size") % 4 == 0).alias("accessible"), (F.col("p_partkey") % 5).alias("floor"), (F.col("p_partkey") % 13 * 0.4).alias("x"), (F.col("p_partkey") % 7 * 0.4).alias("y"))
    return p.join(text, "id", "left").join(image, "id", "left")


def _query_vector(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]  # one query's vector


@query("q00_hybrid_search")
def q00(spark, d):
    found = S.hybrid_search(_points(spark, d), "where is the nearest red lift", _query_vector(spark, d), 50, "accessible", position=(1.0, 1.0))
    return found.select("rank", "id", "label", "tier", F.round("score", 6).alias("score"), F.round("lexical", 6).alias("lexical"), "matched_by")


@query("q01_vocabulary", "SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type AS doc FROM part")
def q01(spark, d):
    return table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("doc")).distinct()


_ASKED = {0: ("", ""), 1: ("Where is the nearest ", "?"), 2: ("show me an accessible ", " please"), 3: ("wheelchair accessible ", " near me")}


@query("q02_query_interpretation", """WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS k, lower(p_name) AS name FROM part) SELECT id, CASE k WHEN 1 THEN 'where is the nearest ' WHEN 2 THEN 'show me an accessible ' WHEN 3 THEN 'wheelchair accessible ' ELSE '' END || trim(regexp_replace(name, '[^a-z0-9]+', ' ', 'g')) || CASE k WHEN 2 THEN ' please' WHEN 3 THEN ' near me' ELSE '' END AS normalized,
trim(regexp_replace(name, '[^a-z0-9]+', ' ', 'g')) AS subject, k IN (1, 3) AS nearest, k IN (2, 3) AS accessible FROM p""")
def q02(spark, d):
    k = F.col("p_partkey") % 4
    said = F.coalesce(*[F.when(k == i, F.concat(F.lit(a), F.col("p_name"), F.lit(z))) for i, (a, z) in _ASKED.items()])
    return S.read_requests(table(spark, d, "part").select(F.col("p_partkey").alias("id"), said.alias("said")), "said").select("id", "normalized", "subject", "nearest", "accessible")


@query("q03_scope", "SELECT p_partkey FROM part WHERE p_partkey % 5 = 2 AND p_size % 4 <> 3")
def q03(spark, d):
    return _points(spark, d).where("floor = 2").join(table(spark, d, "part").where("p_size % 4 <> 3").select(F.col("p_partkey").alias("id")), "id", "left_semi").select(F.col("id").alias("p_partkey"))


@query("q04_same_model_guard", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN embedding IS NOT NULL ELSE false END AS usable FROM part LEFT JOIN embeddings ON vec_id + 1 = p_partkey")
def q04(spark, d):
    p = _points(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "m1").otherwise("m0").alias("model")), "id")
    return p.select(F.col("id").alias("p_partkey"), F.when(F.col("model") == "m1", F.col("embedding")).isNotNull().alias("usable"))


_SIM = """v AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT p_partkey AS id, embedding, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)) AS sim FROM part, v LEFT JOIN embeddings ON vec_id + 1 = p_partkey),
m AS (SELECT avg(sim) AS mean, count(*) AS peers FROM (SELECT DISTINCT embedding, sim FROM s WHERE embedding IS NOT NULL))"""


@query("q05_mean_over_distinct_texts", f"WITH {_SIM} SELECT round(mean, 8) AS mean, peers FROM m")
def q05(spark, d):
    s = S.score_points(_points(spark, d), _query_vector(spark, d), ["red"])
    return s.select(F.round("mean", 8).alias("mean"), "peers").distinct()


@query("q06_margin_test", f"WITH {_SIM} SELECT id, coalesce(peers >= 8 AND sim - mean >= 0.078, false) AS by_text FROM s, m")
def q06(spark, d):
    return S.score_points(_points(spark, d), _query_vector(spark, d), ["red"]).select("id", "by_text")


_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[]) * list_dot_product({1}::DOUBLE[], {1}::DOUBLE[]))"


@query("q07_image_test", f"""WITH v AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), l AS (SELECT embedding AS label_vec FROM embeddings WHERE vec_id IN (3, 4, 5)), s AS (SELECT p_partkey AS id, p_size, embedding, {_COS.format("embedding", "q")} AS sim, (SELECT max({_COS.format("embedding", "label_vec")}) FROM l) AS best FROM part, v LEFT JOIN embeddings ON vec_id = p_partkey)
SELECT id, coalesce(sim >= best AND NOT coalesce(p_size % 3 = 0 AND (p_size % 10) / 10.0 < 0.5, false), false) AS by_image FROM s""")
def q07(spark, d):
    labels = [[float(x) for x in r["embedding"]] for r in table(spark, d, "embeddings").where("vec_id IN (3, 4, 5)").orderBy("vec_id").collect()]  # three detector labels
    return S.score_points(_points(spark, d), _query_vector(spark, d), ["red"], labels).select("id", "by_image")


@query("q08_lexical_term", f"""SELECT id, round(similarity, 6) AS lexical, similarity >= 0.5 AS by_lexical FROM ({strict_similarity_sql("SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part", ["red part", "blue"])})""")
def q08(spark, d):
    return S.score_points(_points(spark, d), None, ["red part", "blue"]).select("id", F.round("lexical", 6).alias("lexical"), "by_lexical")


@query("q09_exact_tiers", "SELECT p_partkey AS id, CASE WHEN coalesce(CASE WHEN p_size % 3 = 0 THEN (p_size % 10) / 10.0 END < 0.5, false) THEN 0 WHEN trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) = 'brand 3' OR lower(p_name) = 'brand 3' THEN 2 WHEN list_contains(string_split(lower(p_type), ' '), 'steel') THEN 1 ELSE 0 END AS tier FROM part")
def q09(spark, d):
    return S.score_points(_points(spark, d), None, ["brand 3", "steel"]).select("id", "tier")


@query("q10_rank_score", f"WITH {_SIM} SELECT id, round(sim + 0.05 * (CASE WHEN p_size % 3 = 0 THEN (p_size % 10) / 10.0 ELSE 1.0 END * CASE 1 + p_size % 3 WHEN 3 THEN 1.0 WHEN 2 THEN 0.75 ELSE 0.5 END - 1), 6) AS score FROM s JOIN part ON p_partkey = id")
def q10(spark, d):
    s = S.score_points(_points(spark, d), _query_vector(spark, d), ["zzzz"])
    return s.select("id", F.round(F.col("score") - S.LEXICAL_WEIGHT * F.col("lexical"), 6).alias("score"))


@query("q11_relevant", f"WITH {_SIM} SELECT id, coalesce(peers >= 8 AND sim - mean >= 0.078, false) OR (sim IS NOT NULL AND peers < 8) AS relevant FROM s, m")
def q11(spark, d):
    return S.score_points(_points(spark, d), _query_vector(spark, d), ["zzzz"]).select("id", "relevant")


@query("q13_matched_by", f"WITH {_SIM} SELECT id, CASE WHEN coalesce(peers >= 8 AND sim - mean >= 0.078, false) THEN 'TEXT' WHEN p_brand LIKE '%3' THEN 'SYNONYM' END AS matched_by FROM s, m JOIN part ON p_partkey = id")
def q13(spark, d):
    s = S.score_points(_points(spark, d), _query_vector(spark, d), ["zzzz"])
    return s.select("id", S.matched_by(F.col("category").endswith("3")).alias("matched_by"))


@query("q12_ranked_candidates", f"""WITH {_SIM}, x AS ({strict_similarity_sql("SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part", ["red part"])}),
e AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN (p_size % 10) / 10.0 ELSE 1.0 END * CASE 1 + p_size % 3 WHEN 3 THEN 1.0 WHEN 2 THEN 0.75 ELSE 0.5 END AS evidence FROM part),
o AS (SELECT s.id, sim + 0.05 * similarity + 0.05 * (evidence - 1) AS score, similarity AS lexical, sim, evidence FROM s JOIN x ON x.id = s.id JOIN e ON e.id = s.id)
SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, lexical DESC, sim DESC NULLS LAST, evidence DESC, id) AS rank, id, round(score, 6) AS score FROM o ORDER BY rank LIMIT 200""")
def q12(spark, d):
    s = S.score_points(_points(spark, d), _query_vector(spark, d), ["red part"])
    return S.ranked(s).select("rank", "id", F.round("score", 6).alias("score"))


@query("q14_duplicate_folding")
def q14(spark, d):
    s = S.ranked(S.score_points(_points(spark, d), _query_vector(spark, d), ["red part"]))
    detected = s.withColumn("foldable", F.col("confidence").isNotNull()).withColumn("fold_group", F.coalesce(S.synonym_group(T.normalize(F.col("label"))), T.merge_key(F.col("category"))))
    return S.fold_duplicates(detected.select("rank", "id", "floor", "fold_group", "foldable", "x", "y")).select("rank", "id")


@query("q16_closest_matches", f"WITH {_SIM} SELECT id, round(sim, 6) AS similarity FROM s, m WHERE NOT coalesce(sim - mean >= 0.078, false) ORDER BY sim DESC NULLS LAST, id LIMIT 3")
def q16(spark, d):
    s = S.score_points(_points(spark, d), _query_vector(spark, d), ["zzzz"])
    return s.where(~F.col("by_text")).orderBy(F.col("similarity").desc_nulls_last(), "id").limit(3).select("id", F.round("similarity", 6).alias("similarity"))


@query("q17_unconfirmed_accessible", "SELECT p_partkey AS id FROM part WHERE (CASE WHEN p_size % 4 <> 1 THEN p_size % 4 = 0 END) IS NOT FALSE")
def q17(spark, d):
    return _points(spark, d).where(F.col("accessible").isNull() | F.col("accessible")).select("id")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("q18_lexical_fallback", f"""WITH t AS (SELECT p_partkey AS id, p_name, {_GRAMS.format("p_name")} AS a, {_GRAMS.format("'red part'")} AS b FROM part), s AS (SELECT id, p_name, length(list_intersect(a, b)) / length(list_distinct(list_concat(a, b))) AS similarity FROM t)
SELECT id, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.2 OR contains(lower(p_name), 'red part')""")
def q18(spark, d):
    return S.lexical_fallback(_points(spark, d), "red part").select("id", F.round("similarity", 6).alias("similarity"))


@query("q19_index_diagnostics", "SELECT count(*) AS total, count(*) FILTER (embedding IS NOT NULL) AS indexed, count(*) FILTER (embedding IS NULL) AS pending FROM part LEFT JOIN embeddings ON vec_id + 1 = p_partkey")
def q19(spark, d):
    has = F.col("embedding").isNotNull()
    return _points(spark, d).agg(F.count("*").alias("total"), F.count_if(has).alias("indexed"), F.count_if(~has).alias("pending"))


@query("q20_explanation", "SELECT p_partkey AS id, 'matched ' || p_name || ' (size ' || p_size || ')' AS why FROM part")
def q20(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.format_string("matched %s (size %d)", "p_name", "p_size").alias("why"))


@query("q21_target_kind", "SELECT CASE WHEN max((p_size = 7)::INT) = 1 AND count(*) = 1 THEN 'NAMED_PLACE' WHEN count(*) > 0 THEN 'CATEGORY' ELSE 'DESCRIPTION' END AS kind FROM part WHERE p_brand = 'Brand#12'")
def q21(spark, d):
    hits = table(spark, d, "part").where("p_brand = 'Brand#12'").agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("p_size") == 7), F.lit(False)).alias("named"))
    return hits.select(F.when(F.col("named") & (F.col("n") == 1), "NAMED_PLACE").when(F.col("n") > 0, "CATEGORY").otherwise("DESCRIPTION").alias("kind"))


@query("q22_query_log", "SELECT c_custkey AS actor, lower(c_mktsegment) AS query, c_nationkey AS results FROM customer")
def q22(spark, d):
    path = shared_dir(spark)
    for part in (0, 1):
        append_returning(table(spark, d, "customer").where(F.col("c_custkey") % 2 == part).select(F.col("c_custkey").alias("actor"), F.lower("c_mktsegment").alias("query"), F.col("c_nationkey").alias("results")), path)
    return spark.read.parquet(path)


@query("q23_embedding_backlog", "SELECT p_partkey AS id, CASE WHEN embedding IS NULL THEN 'PENDING' ELSE 'STALE_MODEL' END AS state FROM part LEFT JOIN embeddings ON vec_id + 1 = p_partkey WHERE embedding IS NULL OR p_size % 2 = 1 ORDER BY id LIMIT 100")
def q23(spark, d):
    model = F.when(F.col("id") % 1 == 0, F.lit("m1"))
    p = _points(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "m1").alias("model")), "id")
    due = F.col("embedding").isNull() | ~F.col("model").eqNullSafe(model)
    return p.where(due).orderBy("id").limit(100).select("id", F.when(F.col("embedding").isNull(), "PENDING").otherwise("STALE_MODEL").alias("state"))


@query("k05_bounded_best_first", """WITH q AS (SELECT p_partkey AS id, (p_partkey % 13 * 0.4) AS x, (p_partkey % 7 * 0.4) AS y FROM part) SELECT id, round(sqrt((x - 1) ** 2 + (y - 1) ** 2), 8) AS distance FROM q ORDER BY 2, 1 LIMIT 20""")
def k05(spark, d):
    # with the single-source distances at hand every candidate is exact, so best-first search needs no bound
    near = F.hypot(F.col("x") - 1, F.col("y") - 1)
    return _points(spark, d).select("id", F.round(near, 8).alias("distance")).orderBy("distance", "id").limit(20)
