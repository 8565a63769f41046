"""File formats: what the round trips of the registered queries do not reach."""

import tarfile

import numpy as np
import pytest

from plinth.operators import search
from plinth.sources import files


def test_foreign_ply_and_errors(spark, tmp_path):
    names = [*files.PLY_PROPERTIES, "f_rest_0"]
    body = np.zeros(3, np.dtype([(n, "<f4") for n in names]))
    body["x"] = [1, 2, 3]
    head = lambda n, form="binary_little_endian": "\n".join(["ply", f"format {form} 1.0", "comment made elsewhere", f"element vertex {n}", *(f"property float {x}" for x in names), "end_header", ""]).encode()
    (tmp_path / "a.ply").write_bytes(head(3) + body.tobytes())
    assert sorted(r["x"] for r in files.read_ply(spark, str(tmp_path / "a.ply"), drop_higher_sh=True).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="higher bands"):
        files.read_ply(spark, str(tmp_path / "a.ply")).collect()
    for name, raw, message in (("b", head(9) + body.tobytes(), "bytes for 9 points"), ("c", head(3, "ascii") + body.tobytes(), "little_endian"), ("d", b"no cloud", "not a PLY")):
        (tmp_path / f"{name}.ply").write_bytes(raw)
        with pytest.raises(Exception, match=message):
            files.read_ply(spark, str(tmp_path / f"{name}.ply"), drop_higher_sh=True).collect()


def test_obj_fans_negative_indices_and_groups(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\no obstacle_chair\nf -4 -3 -2\ng level_change1\nf 1 2 3\ng\nf 2 3 4\n")
    v, t = files.read_obj(spark, str(tmp_path / "m.obj"))
    assert v.count() == 4
    assert sorted(tuple(r)[1:] for r in t.collect()) == sorted([(0, 1, 2, False, False), (0, 2, 3, False, False), (0, 1, 2, True, False), (0, 1, 2, False, True), (1, 2, 3, False, False)])


def test_unsafe_archives_and_short_poses_are_errors(spark, tmp_path):
    (tmp_path / "x").write_text("x")
    with tarfile.open(tmp_path / "bad.tar", "w") as tar:
        tar.add(tmp_path / "x", arcname="../x")
    with pytest.raises(Exception, match="unsafe member"):
        files.unpack_frames(spark, str(tmp_path / "bad.tar")).collect()
    (tmp_path / "images.txt").write_text("# c\n1 1 0 0 0 0 0 0\n")
    with pytest.raises(Exception, match="malformed"):
        files.read_colmap_images(spark, str(tmp_path / "images.txt")).collect()


def test_trajectory_errors(spark):
    texts = {"ok": "# units: m\nt,x,y\n0,0,0\n1,3,4", "feet": "# units: ft\nt,x,y\n0,0,0", "none": "t,x,y\n0,0,0", "back": "# units: m\nt,x,y\n1,0,0\n1,1,0", "nan": "# units: m\nt,x,y\n1,x,0", "head": "# units: m\na,b,c\n1,2,3", "empty": "", "null": None, "json": '{"units":"metres","startedAtMs":5000,"samples":[{"t":0,"x":0,"y":0},{"t":2,"x":0,"y":1,"yawDegrees":90}]}', "broken": "{"}
    got = {r["name"]: r for r in files.import_trajectories(spark.createDataFrame(list(texts.items()), "name string, text string"), 10_000).collect()}
    assert {n: r["errors"] for n, r in got.items()} == {"ok": [], "feet": ["UNITS"], "none": ["UNITS"], "back": ["TIME_ORDER"], "nan": ["NOT_FINITE"], "head": ["HEADER"], "empty": ["UNITS", "HEADER", "NO_SAMPLES"], "null": ["UNITS", "HEADER", "NO_SAMPLES"], "json": [], "broken": ["UNITS", "NO_SAMPLES"]}
    assert got["ok"]["path_m"] == 5.0 and [s["captured_at_ms"] for s in got["ok"]["samples"]] == [9000, 10_000]
    assert [s["captured_at_ms"] for s in got["json"]["samples"]] == [5000, 7000] and got["json"]["samples"][1]["yaw"] == 90


def points(spark):
    rows = [(1, "armchairs", "seat", ["red"], 0, 0.0, 0.0, None), (2, "lift", "way", ["steel"], 0, 5.0, 0.0, None), (3, "Elevator", "way", [], 0, 1.0, 0.0, 0.9), (4, "elevator", "way", [], 0, 1.2, 0.0, 0.8), (5, "reception", "desk", [], 1, 2.0, 0.0, None)]
    none = "embedding array<double>, image_embedding array<double>"
    return spark.createDataFrame([(i, n, c, t, None, None, conf, 3, f, x, y) for i, n, c, t, f, x, y, conf in rows], f"id long, label string, category string, tags array<string>, {none}, confidence double, views int, floor int, x double, y double")


def test_spelling_and_reading_of_a_request(spark):
    r = search.read_request(points(spark), "Where is the nearest recption?")
    assert (r.subject, r.typed, r.nearest, r.corrections) == ("reception", "recption", True, {"recption": "reception"}) and "front desk" in r.terms
    assert search.read_request(points(spark), "armchair").terms[:2] == ["armchair", "armchairs"]
    assert search.read_request(points(spark), "where is the armchairz").subject == "armchairs"


def test_fallback_folds_and_orders_by_nearness(spark):
    found = search.hybrid_search(points(spark), "nearest elevator", None, position=(4.0, 0.0)).orderBy("rank").collect()
    assert [r["id"] for r in found] == [3] and found[0]["matched_by"] == "LEXICAL"


def test_archives_stream_and_any_tar_reader_reads_them(spark, tmp_path):
    """Contents of every length around a block, zero and high bytes, and one archive with most of the members."""
    rows = [("big" if i % 8 else f"small{i % 3}", f"f{i:04d}", bytes((i * 7 + j) % 256 for j in range(i if i < 1100 else 512 * (i % 5)))) for i in range(0, 1200, 3)]
    rows += [("empty", "none", None), ("empty", "zero", bytes(512))]
    path = str(tmp_path / "tars")
    files.pack_frames(spark.createDataFrame(rows, "archive string, name string, content binary").repartition(8), path)
    executions = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = executions.apply(executions.size() - 1).physicalPlanDescription()
    sorts = [line for line in plan.split("WriteFiles")[1].splitlines() if "Sort (" in line]
    assert "MapInArrow" in plan.split("WriteFiles")[1].split(sorts[1])[0]  # one sort behind the writer, which keeps members in order
    assert any(line.startswith("Arguments: [archive#") and "number#" in line for line in plan.splitlines())
    found = []
    for archive in {r[0] for r in rows}:
        (part,) = (tmp_path / "tars" / f"archive={archive}").glob("part-*")
        assert part.stat().st_size % 512 == 0
        with tarfile.open(part, "r:") as tar:
            names = tar.getnames()
            assert names == sorted(names)
            found += [(archive, m.name, tar.extractfile(m).read()) for m in tar]
    wanted = sorted((a, n, c or b"") for a, n, c in rows)
    assert sorted(found) == wanted
    back = files.unpack_frames(spark, path).selectExpr("regexp_extract(archive, 'archive=([^/]+)', 1)", "name", "content").collect()
    assert sorted((a, n, bytes(c)) for a, n, c in back) == wanted
