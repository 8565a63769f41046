"""File formats of scans: JSON lines, PLY clouds, OBJ meshes, COLMAP text models, tar archives of frames and trajectory uploads.

Everything is read through Spark's text, JSON and binary sources and written through its writers, so paths may lie in any store that Spark reaches.
Line order within a file matters for meshes and pose lists: such a file is read block by block and its lines numbered. Clouds are
written as many parts of bounded size."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graphs

IMAGES = "image_id string, relative_path string, width int, height int, venue_id string, floor_id string, split string, group_id string, content_sha256 string, origin string, license string, semantic_mask string, negative boolean"
ANNOTATIONS = "annotation_id string, image_id string, object_class string, bounding_box struct<x:double,y:double,width:double,height:double,normalized:boolean>, provenance struct<source:string,annotator:string,created_at:string,review_status:string,model_id:string>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are no rows, missing fields null. A malformed line raises an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.select(*sorted(rows.columns)).write.mode("append" if append else "overwrite").json(path)


def append_returning(rows: DataFrame, path: str) -> DataFrame:
    """Appends rows to a Parquet table and returns what was written, with the ids they came with."""
    rows.write.mode("append").parquet(path)
    return rows


#: The properties of a degree-0 splat cloud, in file order.
PLY_PROPERTIES = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
PLY_ROWS = 100_000
#: The line separator behind each part of a binary text file; readers skip it.
_SEPARATOR = "\n"


def _binary_file(chunks: DataFrame, path: str) -> None:
    """chunks: one string column that holds bytes as they are."""
    chunks.write.option("lineSep", _SEPARATOR).mode("overwrite").text(path)


def _as_text(parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()).view(pa.string())], ["value"])


def write_ply(points: DataFrame, path: str, rows: int = PLY_ROWS) -> None:
    """Binary little-endian PLY, a cloud of at most `rows` points after another in each part file. Missing properties (normals) are zero, nulls NaN."""
    have = [c for c in PLY_PROPERTIES if c in points.columns]
    kind = np.dtype([(c, "<f4") for c in PLY_PROPERTIES])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                body = np.zeros(part.num_rows, kind)
                for c in have:
                    body[c] = part.column(c).to_numpy(zero_copy_only=False)
                head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(body)}", *(f"property float {c}" for c in PLY_PROPERTIES), "end_header", ""]
                yield _as_text(["\n".join(head).encode() + body.tobytes()])

    _binary_file(points.select(*[F.col(c).cast("float").alias(c) for c in have]).mapInArrow(run, "value string"), path)


def _clouds(raw: memoryview, name: str, drop_higher_sh: bool) -> Iterator[np.ndarray]:
    at = 0
    while at < len(raw):
        head = bytes(raw[at : at + 65536])
        if not head.strip(b"\r\n"):
            return
        end = head.find(b"end_header\n")
        if not head.startswith(b"ply") or end < 0:
            raise ValueError(f"{name}: not a PLY file")
        lines = head[:end].decode("ascii", "replace").split("\n")
        if not any(x.startswith("format binary_little_endian") for x in lines):
            raise ValueError(f"{name}: only binary_little_endian PLY is read")
        count = [int(x.split()[2]) for x in lines if x.startswith("element vertex ")]
        properties = [x.split()[2] for x in lines if x.startswith("property float ")]
        missing, higher = sorted(set(PLY_PROPERTIES) - set(properties)), [p for p in properties if p.startswith("f_rest_")]
        if not count or missing:
            raise ValueError(f"{name}: no vertex count, or properties missing: {missing}")
        if higher and not drop_higher_sh:
            raise ValueError(f"{name}: {len(higher)} coefficients of higher bands would be lost; pass drop_higher_sh to lose them")
        kind = np.dtype([(p, "<f4") for p in properties])
        start = at + end + len(b"end_header\n")
        stop = start + count[0] * kind.itemsize
        if stop > len(raw):
            raise ValueError(f"{name}: {len(raw) - start} bytes for {count[0]} points")
        yield np.frombuffer(raw[start:stop], kind)
        at = stop + len(_SEPARATOR) if bytes(raw[stop : stop + 1]) == b"\n" else stop


def read_ply(spark: SparkSession, path: str, drop_higher_sh: bool = False) -> DataFrame:
    """The points of all clouds under path: its file, and the properties as floats. Higher bands raise an error unless they may be dropped."""
    names = ["file", *PLY_PROPERTIES]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("path")[i].as_py()
                for cloud in _clouds(memoryview(batch.column("content")[i].as_buffer()), name, drop_higher_sh):
                    for at in range(0, len(cloud), 10_000):
                        part = cloud[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), *[pa.array(np.ascontiguousarray(part[p])) for p in PLY_PROPERTIES]], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, " + ", ".join(f"{p} float" for p in PLY_PROPERTIES))


def numbered_lines(spark: SparkSession, path: str, kept: Column | None = None) -> DataFrame:
    """file, line (from 0), value of all lines, or of those kept: for formats in which a line's meaning hangs on those before it. A file is read block by block, never as one row: lines are numbered within their block and the counts of the blocks before are added."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    lines = lines if kept is None else lines.where(kept)
    lines = graphs.materialize(lines.withColumn("row", F.monotonically_increasing_id()))  # without gaps within a block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over one row a block
    blocks = graphs.materialize(lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first")))
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("row") + F.col("shift")).alias("line"), "value")


def _fields(value: Column) -> Column:
    return F.split(F.trim(value), r"\s+")


def write_obj(vertices: DataFrame, triangles: DataFrame, path: str, header: str = "") -> None:
    """vertices: index (from 0), x, y, z; triangles: a, b, c (indices), kind ('walkable_candidates', 'level_change' or 'obstacle'). One file: a mesh is one building floor."""
    v = vertices.select(F.lit(1).alias("part"), F.col("index").cast("long").alias("at"), F.format_string("v %.6f %.6f %.6f", *[F.col(c).cast("double") for c in "xyz"]).alias("value"))
    order = F.when(F.col("kind") == "walkable_candidates", 2).when(F.col("kind") == "level_change", 4).otherwise(6)
    g = triangles.select("kind").distinct().select(order.alias("part"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("g "), "kind").alias("value"))
    f = triangles.select((order + 1).alias("part"), F.col("a").cast("long").alias("at"), F.format_string("f %d %d %d", *[F.col(c).cast("long") + 1 for c in "abc"]).alias("value"))
    lines = v.unionByName(g).unionByName(f)
    if header:
        lines = lines.sparkSession.createDataFrame([(0, i, f"# {x}") for i, x in enumerate(header.splitlines())], "part int, at long, value string").unionByName(lines)
    lines.coalesce(1).sortWithinPartitions("part", "at", "value").select("value").write.mode("overwrite").text(path)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices: file, index, x, y, z; triangles: file, a, b, c, obstacle, level_change). Polygons become fans; negative indices count back from the vertices read so far; groups and objects named obstacle* are blocked, level_change* next to a step."""
    lines = numbered_lines(spark, path).withColumn("f", _fields(F.col("value"))).withColumn("op", F.get("f", 0)).where(F.col("op").isin("v", "f", "g", "o"))
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # of one mesh
    lines = lines.withColumn("seen", F.count(F.when(F.col("op") == "v", 1)).over(before))
    group = F.when(F.col("op").isin("g", "o"), F.coalesce(F.get("f", 1), F.lit("")))
    lines = lines.withColumn("group", F.coalesce(F.last(group, ignorenulls=True).over(before), F.lit("")))
    number = lambda i: F.get("f", i).try_cast("double")
    vertices = lines.where("op = 'v'").select("file", (F.col("seen") - 1).alias("index"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"))
    corner = lambda t: F.element_at(F.split(t, "/"), 1).try_cast("long")
    corners = F.transform(F.slice("f", 2, F.size("f") - 1), lambda t: F.when(corner(t) > 0, corner(t) - 1).otherwise(F.col("seen") + corner(t)))
    faces = lines.where("op = 'f'").withColumn("p", corners).where("size(p) >= 3").withColumn("k", F.explode(F.sequence(F.lit(2), F.size("p") - 1)))
    triangles = faces.select("file", F.get("p", 0).alias("a"), F.get("p", F.col("k") - 1).alias("b"), F.get("p", F.col("k")).alias("c"), F.startswith("group", F.lit("obstacle")).alias("obstacle"), F.startswith("group", F.lit("level_change")).alias("level_change"))
    return vertices, triangles


_RECORD = "trim(value) <> '' AND NOT startswith(trim(value), '#')"


def _records(lines: DataFrame) -> DataFrame:
    return lines.where(_RECORD).withColumn("f", _fields(F.col("value")))


#: Camera models and how many parameters each has.
CAMERA_MODELS = {"SIMPLE_PINHOLE": 3, "PINHOLE": 4, "SIMPLE_RADIAL": 4, "RADIAL": 5, "OPENCV": 8}


def read_colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    """camera_id, model, width, height, params (all of them, distortion included) and problem: null, UNSUPPORTED_MODEL or PARAMETER_COUNT."""
    r = _records(spark.read.text(path)).select(F.get("f", 0).cast("long").alias("camera_id"), F.get("f", 1).alias("model"), F.get("f", 2).cast("int").alias("width"), F.get("f", 3).cast("int").alias("height"), F.transform(F.slice("f", 5, F.greatest(F.size("f") - 4, F.lit(0))), lambda x: x.cast("double")).alias("params"))
    wanted = F.create_map(*[F.lit(x) for pair in CAMERA_MODELS.items() for x in pair])[F.col("model")]
    return r.withColumn("problem", F.when(wanted.isNull(), "UNSUPPORTED_MODEL").when(F.size("params") != wanted, "PARAMETER_COUNT"))


def read_colmap_points(spark: SparkSession, path: str) -> DataFrame:
    """point_id, x, y, z, r, g, b, error, track_length (images that see the point)."""
    f = lambda i, kind: F.get("f", i).cast(kind)
    return _records(spark.read.text(path)).select(f(0, "long").alias("point_id"), *[f(i + 1, "double").alias(a) for i, a in enumerate("xyz")], *[f(i + 4, "int").alias(a) for i, a in enumerate("rgb")], f(7, "double").alias("error"), F.floor((F.size("f") - 8) / 2).cast("int").alias("track_length"))


def read_colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, name, camera_id, rotation_wxyz, translation: every other record of each file, from the first; those between list image points. A shorter pose line raises an error."""
    records = numbered_lines(spark, path, F.expr(_RECORD)).where("line % 2 = 0").withColumn("f", _fields(F.col("value")))
    f = lambda i, kind: F.get("f", i).cast(kind)
    whole = F.when(F.size("f") < 10, F.raise_error(F.concat(F.lit("malformed images.txt line: "), "value"))).otherwise(f(0, "long"))
    return records.select(whole.alias("image_id"), F.get("f", 9).alias("name"), f(8, "long").alias("camera_id"), F.array(*[f(i, "double") for i in range(1, 5)]).alias("rotation_wxyz"), F.array(*[f(i, "double") for i in range(5, 8)]).alias("translation"))


def _member(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def pack_frames(frames: DataFrame, path: str) -> None:
    """frames: archive, name, content (binary; null is empty). One uncompressed tar per archive, in a folder archive=<its name> below path, members sorted by name. A null or empty archive goes to Spark's default folder; a null name raises an error.

    Members stream: Spark sorts them and its text writer puts one after another, so a task holds two of them and never an archive. The writer's line separator
    is a zero byte, which stands for the last byte of a header (zero in this format) or of the archive's end; a row is what lies between two of these."""

    def run(batches):
        archive, number, body = None, 0, b""
        for batch in batches:
            names, contents = batch.column("name").to_pylist(), batch.column("content")
            for i, owner in enumerate(batch.column("archive").to_pylist()):
                if owner != archive:
                    if archive is not None:
                        yield row(archive, number, body + bytes(1023))
                    archive, number, body = owner, 0, b""
                content = contents[i].as_py() or b""
                yield row(archive, number, body + _member(names[i], len(content))[:-1])
                number, body = number + 1, content + bytes(-len(content) % 512)
        if archive is not None:
            yield row(archive, number, body + bytes(1023))

    def row(archive: str, number: int, value: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([number], pa.int64()), pa.array([value], pa.binary()).view(pa.string())], ["archive", "number", "value"])

    members = frames.select(F.coalesce(F.col("archive").cast("string"), F.lit("")).alias("archive"), "name", "content").repartition("archive").sortWithinPartitions("archive", "name")
    rows = members.mapInArrow(run, "archive string not null, number long, value string")  # not null: the writer then keeps this order
    rows = rows.sortWithinPartitions("archive", "number")
    rows.select("archive", "value").write.partitionBy("archive").option("lineSep", "\0").option("maxRecordsPerFile", 0).mode("overwrite").text(path)


def unpack_frames(spark: SparkSession, path: str) -> DataFrame:
    """archive (its file), name, content, sha256. A member that is not a plain file directly inside raises an error. An archive is read in place, a member at a time."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                archive = batch.column("path")[i].as_py()
                with tarfile.open(fileobj=pa.BufferReader(batch.column("content")[i].as_buffer()), mode="r:") as tar:
                    for member in tar:
                        if not member.isfile() or "/" in member.name or "\\" in member.name or member.name.startswith("."):
                            raise ValueError(f"{archive}: unsafe member {member.name!r}")
                        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([member.name]), pa.array([tar.extractfile(member).read()], pa.binary())], ["archive", "name", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, name string, content binary").withColumn("sha256", F.sha2("content", 256))


#: How metres may be written, and the most samples of one upload.
METRES, MOST_SAMPLES = ("m", "metre", "metres", "meter", "meters"), 20_000
_UPLOAD = "units string, frameId string, startedAtMs double, samples array<struct<t:double,x:double,y:double,yawDegrees:double>>"


def import_trajectories(uploads: DataFrame, now_ms: int) -> DataFrame:
    """uploads: name, text. A row per upload: errors (empty if it can be used), samples (captured_at_ms, x, y, yaw), duration_s and path_m; the last three null on errors.

    JSON objects hold units and samples; CSV has `# units: m` before a header t,x,y[,yawDegrees]. Units must be metres, times must increase. Without a start
    time, the walk is placed as if it had just ended. Null text is empty."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", ""))
    rows = uploads.select("name", text.alias("text")).withColumn("is_json", F.startswith("text", F.lit("{"))).withColumn("doc", F.when(F.col("is_json"), F.from_json("text", _UPLOAD)))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    notes = F.filter(lines, lambda x: F.startswith(x, F.lit("#")))
    body = F.filter(lines, lambda x: ~F.startswith(x, F.lit("#")))
    rows = rows.withColumns({"notes": notes, "body": body}).withColumn("header", F.split(F.lower(F.regexp_replace(F.coalesce(F.get("body", 0), F.lit("")), r"\s", "")), ","))
    number = lambda f, i: F.try_element_at(f, F.lit(i)).try_cast("double")
    parsed = F.transform(F.slice("body", 2, F.greatest(F.size("body") - 1, F.lit(0))), lambda x: F.split(x, r"\s*,\s*"))
    csv = F.transform(parsed, lambda f: F.struct(number(f, 1).alias("t"), number(f, 2).alias("x"), number(f, 3).alias("y"), F.when(F.size("header") > 3, number(f, 4)).alias("yawDegrees")))
    unit = F.when(F.col("is_json"), F.lower("doc.units")).otherwise(F.lower(F.regexp_extract(F.array_join("notes", "\n"), r"(?i)units\s*:\s*(\S+)", 1)))
    raw = F.when(F.col("is_json"), F.col("doc.samples")).otherwise(csv)
    rows = rows.withColumns({"unit": unit, "raw": F.coalesce(raw, F.array().cast("array<struct<t:double,x:double,y:double,yawDegrees:double>>"))})
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    bad = F.exists("raw", lambda s: ~(finite(s["t"]) & finite(s["x"]) & finite(s["y"])))
    pairs = F.zip_with(F.slice("raw", 1, F.greatest(F.size("raw") - 1, F.lit(0))), F.slice("raw", 2, F.greatest(F.size("raw") - 1, F.lit(0))), lambda a, b: F.struct((b["t"] - a["t"]).alias("dt"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("d")))
    late = F.exists(pairs, lambda p: ~(p["dt"] > 0))
    shape = ~F.col("is_json") & ~F.array_join(F.slice("header", 1, 3), ",").eqNullSafe(F.lit("t,x,y"))
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("unit").isin(*METRES), F.lit(False)), "UNITS"), F.when(shape, "HEADER"), F.when(F.size("raw") == 0, "NO_SAMPLES"),
        F.when(F.size("raw") > MOST_SAMPLES, "TOO_MANY"), F.when(bad, "NOT_FINITE"), F.when(~bad & late, "TIME_ORDER")))
    duration = F.element_at("raw", -1)["t"] - F.element_at("raw", 1)["t"]
    start = F.coalesce(F.when(F.col("is_json"), F.col("doc.startedAtMs")), F.lit(now_ms) - F.round(duration * 1000) - F.round(F.element_at("raw", 1)["t"] * 1000))
    samples = F.transform("raw", lambda s: F.struct((start + F.round(s["t"] * 1000)).cast("long").alias("captured_at_ms"), s["x"].alias("x"), s["y"].alias("y"), s["yawDegrees"].alias("yaw")))
    good = F.size("errors") == 0
    length = F.aggregate(pairs, F.lit(0.0), lambda total, p: total + p["d"])
    return rows.withColumn("errors", errors).select("name", "errors", F.when(good, samples).alias("samples"), F.when(good, duration).alias("duration_s"), F.when(good, length).alias("path_m"))
