"""File formats (S03 to S13, S15): each query writes a table in the format to the shared folder, reads it back and returns what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from ..sources.shared import shared_dir
from ..sources.tables import table
from .registry import query


def _parts(spark, d):
    return table(spark, d, "part")


@query("s03_jsonl_images", "SELECT p_partkey::VARCHAR AS image_id, p_name || '.png' AS relative_path, 640 + p_size AS width, 480 AS height, CASE WHEN p_size % 2 = 0 THEN 'train' END AS split, p_brand AS group_id, p_size % 5 = 0 AS negative FROM part")
def s03(spark, d):
    path = shared_dir(spark)
    images = _parts(spark, d).select(
        F.col("p_partkey").cast("string").alias("image_id"), F.concat("p_name", F.lit(".png")).alias("relative_path"), (640 + F.col("p_size")).alias("width"), F.lit(480).alias("height"),
        F.when(F.col("p_size") % 2 == 0, "train").alias("split"), F.col("p_brand").alias("group_id"), (F.col("p_size") % 5 == 0).alias("negative"))
    S.write_jsonl(images, path)
    return S.read_jsonl(spark, path, S.IMAGES).select(images.columns)


@query("s04_jsonl_annotations", "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS annotation_id, l_partkey::VARCHAR AS image_id, l_returnflag AS object_class, l_quantity AS x, l_tax AS width, l_linestatus AS review_status FROM lineitem")
def s04(spark, d):
    path = shared_dir(spark)
    box = F.struct(F.col("l_quantity").alias("x"), F.lit(1.5).alias("y"), F.col("l_tax").alias("width"), F.lit(2.0).alias("height"), F.lit(False).alias("normalized"))
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("annotation_id"), F.col("l_partkey").cast("string").alias("image_id"), F.col("l_returnflag").alias("object_class"),
        box.alias("bounding_box"), F.struct(F.lit("human").alias("source"), F.col("l_linestatus").alias("review_status")).alias("provenance"))
    S.write_jsonl(rows, path)
    return S.read_jsonl(spark, path, S.ANNOTATIONS).select("annotation_id", "image_id", "object_class", "bounding_box.x", "bounding_box.width", "provenance.review_status")


@query("s05_jsonl_append", "SELECT n_nationkey AS id, n_name AS label, 1 AS pass FROM nation UNION ALL SELECT r_regionkey, r_name, 2 FROM region")
def s05(spark, d):
    path = shared_dir(spark)
    S.write_jsonl(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit(1).alias("pass")), path)
    S.write_jsonl(table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit(2).alias("pass")), path, append=True)
    return S.read_jsonl(spark, path, "id int, label string, pass int")


@query("s06_ply_cloud", "SELECT embedding[1]::FLOAT::DOUBLE AS x, embedding[2]::FLOAT::DOUBLE AS y, embedding[3]::FLOAT::DOUBLE AS z, embedding[4]::FLOAT::DOUBLE AS opacity, embedding[5]::FLOAT::DOUBLE AS scale_0, 0.0::DOUBLE AS nx FROM embeddings")
def s06(spark, d):
    path, e = shared_dir(spark), lambda i: F.col("embedding")[i]
    points = table(spark, d, "embeddings").select(e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), e(3).alias("opacity"), *[e(4 + i).alias(f"scale_{i}") for i in range(3)], *[e(7 + i).alias(f"rot_{i}") for i in range(4)], *[e(11 + i).alias(f"f_dc_{i}") for i in range(3)])
    S.write_ply(points, path, rows=300)
    return S.read_ply(spark, path).select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "opacity", "scale_0", "nx")])


@query("s07_obj_mesh", """SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS face, n_nationkey::BIGINT AS a, ((n_nationkey + 1) % 25)::BIGINT AS b, ((n_nationkey + 2) % 25)::BIGINT AS c, n_regionkey = 2 AS obstacle, n_regionkey = 1 AS level_change, round(n_nationkey * 0.25, 6)::DOUBLE AS x, round(n_regionkey * 1.5, 6)::DOUBLE AS y FROM nation""")
def s07(spark, d):
    path, n = shared_dir(spark), table(spark, d, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    vertices = n.select(k.alias("index"), (k * 0.25).alias("x"), (r * 1.5).alias("y"), F.lit(0.0).alias("z"))
    kind = F.when(r == 2, "obstacle").when(r == 1, "level_change").otherwise("walkable_candidates")
    S.write_obj(vertices, n.select(k.alias("a"), ((k + 1) % 25).alias("b"), ((k + 2) % 25).alias("c"), kind.alias("kind")), path, "a mesh\nof nations")
    v, t = S.read_obj(spark, path)
    corner = v.select(F.col("index").alias("a"), "x", "y")
    return t.join(corner, "a").select(F.col("a").alias("face"), "a", "b", "c", "obstacle", "level_change", "x", "y")


@query("s08_colmap_cameras", """SELECT s_suppkey AS camera_id, CASE s_nationkey % 3 WHEN 0 THEN 'PINHOLE' WHEN 1 THEN 'OPENCV' ELSE 'FISHEYE' END AS model, 640 AS width, 480 AS height, CASE WHEN s_nationkey % 3 = 2 THEN 'UNSUPPORTED_MODEL' WHEN s_nationkey % 3 = 1 THEN 'PARAMETER_COUNT' END AS problem, s_nationkey + 0.5::DOUBLE AS focal FROM supplier""")
def s08(spark, d):
    path, k = shared_dir(spark), F.col("s_nationkey")
    model = F.when(k % 3 == 0, "PINHOLE").when(k % 3 == 1, "OPENCV").otherwise("FISHEYE")
    lines = table(spark, d, "supplier").select(F.concat_ws(" ", "s_suppkey", model, F.lit("640 480"), k + F.lit(0.5), k + F.lit(0.5), F.lit("320 240")).alias("value"))
    lines.unionByName(spark.createDataFrame([("# Camera list",), ("",)], "value string")).write.text(path)
    return S.read_colmap_cameras(spark, path).select("camera_id", "model", "width", "height", "problem", F.get("params", 0).alias("focal"))


@query("s09_colmap_points", "SELECT c_custkey AS point_id, c_acctbal AS x, c_nationkey::DOUBLE AS y, c_nationkey % 256 AS r, 1 + c_nationkey % 4 AS track_length FROM customer")
def s09(spark, d):
    path, k = shared_dir(spark), F.col("c_nationkey")
    track = F.array_join(F.transform(F.sequence(F.lit(1), 1 + k % 4), lambda i: F.concat_ws(" ", i, i * 7)), " ")
    table(spark, d, "customer").select(F.concat_ws(" ", "c_custkey", "c_acctbal", k, F.lit("0.5"), k % 256, F.lit("7 8 0.25"), track).alias("value")).write.text(path)
    return S.read_colmap_points(spark, path).select("point_id", "x", "y", "r", "track_length")


@query("s10_colmap_images", "SELECT c_custkey AS image_id, 'frame' || c_custkey || '.jpg' AS name, 1::BIGINT AS camera_id, c_nationkey::DOUBLE AS tx FROM customer")
def s10(spark, d):
    path = shared_dir(spark)
    pose = F.concat_ws(" ", "c_custkey", F.lit("1 0 0 0"), "c_nationkey", F.lit("0 0 1"), F.concat(F.lit("frame"), "c_custkey", F.lit(".jpg")))
    lines = table(spark, d, "customer").select(F.explode(F.array(pose, F.lit("12.5 3.5 -1 4.5 6.5 8"))).alias("value"))
    lines.write.text(path)
    return S.read_colmap_images(spark, path).select("image_id", "name", "camera_id", F.get("translation", 0).alias("tx"))


@query("s12_frame_archives", "SELECT page_id, sha256(coalesce(html, '')) AS sha256 FROM pages")
def s12(spark, d):
    path, i = shared_dir(spark), F.col("page_id")
    frames = table(spark, d, "pages").select((F.floor(i / 20)).alias("archive").cast("string").alias("archive"), F.concat(F.lit("frame_"), i, F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    S.pack_frames(frames, path)
    return S.unpack_frames(spark, path).select(F.regexp_extract("name", r"\d+", 0).cast("long").alias("page_id"), "sha256")


@query("s13_trajectory_import", """WITH s AS (SELECT user_id, row_number() OVER w - 1 AS i, round(value, 3) AS x, lag(round(value, 3)) OVER w AS before FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'UNITS' WHEN 1 THEN 'TIME_ORDER' ELSE '' END AS errors, CASE WHEN user_id % 4 > 1 THEN count(*) END AS samples, CASE WHEN user_id % 4 > 1 THEN (max(i) * 0.5)::DOUBLE END AS duration_s, CASE WHEN user_id % 4 > 1 THEN round(sum(abs(x - before)), 4) END AS path_m FROM s GROUP BY user_id HAVING count(*) > 1""")
def s13(spark, d):
    k = F.col("user_id")
    rows = table(spark, d, "events").where("value IS NOT NULL").groupBy(k).agg(F.array_sort(F.collect_list(F.struct("event_id", F.round("value", 3).alias("x")))).alias("s")).where("size(s) > 1")  # a walk per user
    line = lambda s, i: F.concat_ws(",", F.when(k % 4 == 1, -i).otherwise(i * 0.5), s["x"], F.lit("1"))
    csv = F.concat(F.when(k % 4 == 0, "# units: feet").otherwise("# units: m"), F.lit("\nt, x, y\n"), F.array_join(F.transform("s", line), "\n"))
    samples = F.to_json(F.struct(F.lit("m").alias("units"), F.transform("s", lambda s, i: F.struct((i * 0.5).alias("t"), s["x"].alias("x"), F.lit(1.0).alias("y"))).alias("samples")))
    uploads = rows.select(k.cast("string").alias("name"), F.when(k % 4 == 2, samples).otherwise(csv).alias("text"))
    path = shared_dir(spark)
    uploads.write.json(path)
    found = S.import_trajectories(spark.read.schema("name string, text string").json(path), 1_700_000_000_000)
    return found.select(F.col("name").cast("long").alias("user_id"), F.array_join("errors", ",").alias("errors"), F.when(F.col("samples").isNotNull(), F.size("samples")).cast("long").alias("samples"), "duration_s", F.round("path_m", 4).alias("path_m"))


@query("s15_append_returning", "SELECT event_id AS id, user_id AS actor, lower(event_type) AS query, 7 AS results FROM events")
def s15(spark, d):
    path = shared_dir(spark)
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("actor"), F.lower("event_type").alias("query"), F.lit(7).alias("results"))
    S.append_returning(log.where("user_id % 2 = 0"), path)
    S.append_returning(log.where("user_id % 2 = 1"), path)
    return spark.read.parquet(path)
