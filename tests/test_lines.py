"""Lines of large files are numbered block by block."""

from pyspark.sql import functions as F

from plinth.sources import files


def test_lines_and_poses_of_a_file_of_many_blocks(spark, tmp_path):
    lines = ["# images", ""]
    for i in range(900):
        lines += [f"{i} 1 0 0 0 {i % 7} 0 1 3 frame{i}.jpg", *([" ", "# note"] if i % 11 == 0 else []), "1.5 2.5 -1 " * (i % 5) + "4 5 6"]
    path = tmp_path / "images.txt"
    path.write_bytes("\r\n".join(lines).encode() + b"\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        numbered = files.numbered_lines(spark, str(path))
        got = {r["line"]: r["value"] for r in numbered.collect()}
        poses = sorted((r["image_id"], r["name"], r["camera_id"], r["translation"][0]) for r in files.read_colmap_images(spark, str(path)).collect())
        assert numbered.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [got[i] for i in range(len(lines))] == lines
    assert poses == [(i, f"frame{i}.jpg", 3, float(i % 7)) for i in range(900)]
