"""Readers and writers against files made by hand and by round trips, with splits smaller than a line or record."""

import io
import struct

import numpy as np
import pytest

from cloudframe.sources import files
from cloudframe.sources.files import read_lines
from cloudframe.sources.las import read_las, write_las
from cloudframe.sources.obj import read_obj, write_obj
from cloudframe.sources.ply import read_ply, sample_vertices, stream_vertices, write_ply
from cloudframe.sources.xyz import read_xyz, write_xyz


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def text_file(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


@pytest.fixture(scope="module")
def cloud(spark):
    data = [(i, i + 0.1, 10.0 + i, -1e8 - i / 3, 0.0, 0.0, 1.0, 10 + i, 20 + i, 250, 100 * i, i / 7) for i in range(5)]
    return spark.createDataFrame(data, "pid long, x double, y double, z double, nx double, ny double, nz double, red smallint, green smallint, blue smallint, intensity int, heat double")


@pytest.fixture(scope="module")
def faces(spark):
    return spark.createDataFrame([(0, 0, 1, 2), (1, 2, 3, 4)], "fid long, a int, b int, c int")


@pytest.mark.parametrize("split", [1, 5, 7, 1000])
def test_lines_in_any_split(spark, tmp_path, split):
    text = "a 1\n\n# c\r\nb\na 2\nlast"
    found = rows(read_lines(spark, text_file(tmp_path, "t", text), kinds=("a",), split=split).select("line", "kind", "seen", "text"), "line")
    assert [(r[0], r[3]) for r in found] == [(0, "a 1"), (1, ""), (2, "# c"), (3, "b"), (4, "a 2"), (5, "last")]
    assert [r[2][0] for r in found] == [0, 1, 1, 1, 1, 2] and [r[1] for r in found] == ["a", None, None, None, "a", None]


def test_xyz(spark, tmp_path, cloud):
    path = text_file(tmp_path, "p.xyz", "# head\n0 0 0 1 2 3\n\n1\t2  3 4 5 6\n")
    assert rows(read_xyz(spark, path), "pid") == [(0, 0.0, 0.0, 0.0, 1, 2, 3), (1, 1.0, 2.0, 3.0, 4, 5, 6)]
    bad = text_file(tmp_path, "bad.xyz", "1 2 3\nx y z\n4 5 6 7\nnan 1 2\n")
    with pytest.raises(Exception, match="XYZ parse error in line [234]"):
        read_xyz(spark, bad).collect()
    assert rows(read_xyz(spark, bad, strict=False), "pid") == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    write_xyz(cloud, str(tmp_path / "out.xyz"))
    assert rows(read_xyz(spark, str(tmp_path / "out.xyz"), split=16), "pid") == rows(cloud.select("pid", "x", "y", "z", "red", "green", "blue"), "pid")


@pytest.mark.parametrize("format", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_round_trip(spark, tmp_path, cloud, faces, format):
    path = str(tmp_path / f"{format}.ply")
    write_ply(cloud, path, faces, format)
    found = read_ply(spark, path, split=50)
    assert rows(found.points.select(*cloud.columns), "pid") == rows(cloud, "pid")
    assert rows(found.faces, "fid") == rows(faces, "fid")


def test_ply_conversions(spark, tmp_path):
    head = "ply\nformat ascii 1.0\ncomment POINT_OFFSET 10 0 -1\nelement face 2\nproperty list uchar int vertex_indices\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty float intensity\nend_header\n"
    path = text_file(tmp_path, "c.ply", head + "4 0 1 2 3\n3 0 1 2\n0 0 0 0\n1 0 0 0.5\n1 1 0 1\n0 1 0 300\n")
    found = read_ply(spark, path)
    assert found.offset == (10.0, 0.0, -1.0)
    assert rows(found.points.select("pid", "x", "z", "intensity", "red"), "pid") == [(0, 10.0, -1.0, 0, 0), (1, 11.0, -1.0, 32768, 128), (2, 11.0, -1.0, 65535, 255), (3, 10.0, -1.0, 300, 255)]
    assert rows(found.faces, "fid") == [(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 1, 2)]
    assert read_ply(spark, path, apply_offset=False).points.where("pid = 0").first()["x"] == 0.0


def test_ply_binary_polygons(spark, tmp_path):
    head = b"ply\nformat binary_big_endian 1.0\nelement face 2\nproperty list uchar int vertex_indices\nelement vertex 4\nproperty double x\nproperty double y\nproperty double z\nend_header\n"
    body = struct.pack(">B4i", 4, 0, 1, 2, 3) + struct.pack(">B3i", 3, 1, 2, 3) + np.arange(12, dtype=">f8").tobytes()
    found = read_ply(spark, text_file(tmp_path, "b.ply", head + body))
    assert rows(found.faces, "fid") == [(0, 0, 1, 2), (1, 0, 2, 3), (2, 1, 2, 3)]
    assert rows(found.points, "pid")[3] == (3, 9.0, 10.0, 11.0)


@pytest.mark.parametrize(
    "text,what",
    [
        ("plx\n", "begin with ply"), ("ply\nformat ascii 1.0\n", "end_header"), ("ply\nformat odd 1.0\nend_header\n", "format"),
        ("ply\nformat ascii 1.0\nelement vertex -1\nend_header\n", "element"), ("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n", "required"),
        ("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n", "ends within"),
        ("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list float int vertex_indices\nend_header\n1 2 3\n", "count of list"),
        ("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n", "one name"),
    ],
)
def test_ply_errors(spark, tmp_path, text, what):
    with pytest.raises(ValueError, match=what):
        read_ply(spark, text_file(tmp_path, "e.ply", text))


def test_ply_face_errors(spark, tmp_path):
    head = "ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n1 2 3\n"
    for face, what in (("3 0 0 7", "out of range"), ("2 0 0", "three corners"), ("3 0 0", "bad list"), ("3 0 0 0.5", "bad list")):
        with pytest.raises(Exception, match=what):
            read_ply(spark, text_file(tmp_path, "f.ply", head + face + "\n")).faces.collect()


def test_ply_streams(spark, tmp_path, cloud):
    path = str(tmp_path / "s.ply")
    write_ply(cloud.selectExpr("pid", "float(x) x", "float(y) y", "float(z) z"), path, format="binary_little_endian")
    found = stream_vertices(spark, path, chunk_bytes=24)
    assert found.rdd.getNumPartitions() == 3
    assert found.select("red", "nz", "has_normal").first()[:] == (200, 1.0, False)
    assert [r[0] for r in rows(sample_vertices(spark, path, 2).select("pid"), "pid")] == [0, 3]


def test_las_round_trip(spark, tmp_path, cloud):
    near = cloud.withColumn("z", cloud["pid"] * 0.5)
    path = str(tmp_path / "p.las")
    write_las(near, path)
    assert (tmp_path / "p.las").stat().st_size == 227 + 26 * 5
    found = rows(read_las(spark, path, split=60).selectExpr("pid", "round(x, 3)", "round(y, 3)", "round(z, 3)", "intensity", "red", "green", "blue"), "pid")
    assert found == rows(near.select("pid", "x", "y", "z", "intensity", "red", "green", "blue"), "pid")
    write_las(near.select("pid", "x", "y", "z"), path)
    assert read_las(spark, path).columns == ["pid", "x", "y", "z", "intensity"]
    assert {r["intensity"] for r in read_las(spark, path).collect()} == {255}


def test_las_errors(spark, tmp_path, cloud):
    with pytest.raises(ValueError, match="no LAS header"):
        read_las(spark, text_file(tmp_path, "e.las", "no"))
    with pytest.raises(ValueError, match="scale"):
        write_las(cloud, str(tmp_path / "x.las"), 0.0)
    with pytest.raises(ValueError, match="32 bits"):
        write_las(cloud.selectExpr("pid", "x * 1e9 as x", "y", "z"), str(tmp_path / "x.las"))


OBJ = """mtllib scene.mtl
v 0 0 0 1 0 0
v 1 0 0 0 1 0
vt 0 0
vt 1 0
v 1 1 0 0 0 1
vt 1 1
v 0 1 0 1 1 1
vt 0 1
vn 0 0 1
g part
f 1/1/1 2/2/1 3/3/1 4/4/1
f -4/-4/-1 -3/-3/-1 -2/-2/-1
"""


@pytest.mark.parametrize("split", [50, 1000])
def test_obj(spark, tmp_path, split):
    found = read_obj(spark, text_file(tmp_path, "o.obj", OBJ), split)
    assert rows(found.points.select("pid", "x", "y", "red", "green", "nz"), "pid") == [(0, 0.0, 0.0, 255, 0, 1.0), (1, 1.0, 0.0, 0, 255, 1.0), (2, 1.0, 1.0, 0, 0, 1.0), (3, 0.0, 1.0, 255, 255, 1.0)]
    assert rows(found.faces, "fid") == [(0, 0, 1, 2, 0, 1, 2), (1, 0, 2, 3, 0, 2, 3), (2, 0, 1, 2, 0, 1, 2)]
    assert found.uv.count() == 4 and found.material_library == "scene.mtl"
    path = str(tmp_path / "again.obj")
    write_obj(found.points, path, found.faces, found.uv, "scene.mtl", "t.png")
    again = read_obj(spark, path, split)
    assert rows(again.points.select(*found.points.columns), "pid") == rows(found.points, "pid")
    assert rows(again.faces, "fid") == rows(found.faces, "fid")


def test_obj_lines_are_parsed_once(spark, tmp_path):
    found = read_obj(spark, text_file(tmp_path, "p.obj", OBJ))
    for df in (found.points, found.uv, found.faces):  # what was parsed has been written
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "rlike" not in plan and "split(" not in plan


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_raw_lines_of_ranges(monkeypatch, block):
    monkeypatch.setattr(files, "READ", block)
    for data, begin in ((b"head\na\n\nbcd\r\n" + b"x" * 20 + b"\ny", 5), (b"a\nb\n", 0), (b"", 0), (b"\n\n", 0), (b"abc", 0)):
        for split in (1, 2, 5, 100):
            ranges = [files.Range(0, s, min(s + split, len(data))) for s in range(begin, max(len(data), begin + 1), split)]
            got = [x for r in ranges for x in files._raw_lines(io.BytesIO(data), begin, r)]
            want = data[begin:].split(b"\n")
            assert got == (want if want[-1] else want[:-1])


def test_obj_errors(spark, tmp_path):
    for line, what in (("f 1 2 0", "out of range, line 4"), ("f 1 2", "three corners, line 4"), ("f 1 2 9", "out of range"), ("f a b c", "malformed"), ("v 1 2", "three numbers")):
        with pytest.raises(Exception, match=what):
            found = read_obj(spark, text_file(tmp_path, "e.obj", "v 0 0 0\nv 1 0 0\nv 0 1 0\n" + line + "\n"))
            found.points.collect()
            found.faces.collect()


# Records by the format: x, y, z, intensity, flags, class, angle, user, source; then what each format adds.
_TIME, _COLORS, _WAVE = struct.pack("<d", 1.5), struct.pack("<3H", 257 * 7, 65535, 128), struct.pack("<BQIf3f", 1, 2, 3, 4.0, 5.0, 6.0, 7.0)


@pytest.mark.parametrize("kind,added,colored", [(0, b"", False), (1, _TIME, False), (2, _COLORS, True), (3, _TIME + _COLORS, True), (5, _TIME + _COLORS + _WAVE, True)])
@pytest.mark.parametrize("extra", [0, 3])
def test_las_formats_byte_by_byte(spark, tmp_path, kind, added, colored, extra):
    records = [struct.pack("<3iH2Bb BH".replace(" ", ""), k, -2 * k, 10, 1000 + k, 1, 1, 0, 0, 0) + added + bytes(extra) for k in range(7)]
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<HIIBHI", head, 94, 227, 240, 0, kind, len(records[0]), 7)
    struct.pack_into("<6d", head, 131, 0.5, 0.25, 2.0, 100.0, 0.0, -1.0)
    found = read_las(spark, text_file(tmp_path, f"{kind}.las", bytes(head) + bytes(13) + b"".join(records)), split=100)
    assert rows(found.select("pid", "x", "y", "z", "intensity"), "pid") == [(k, 100 + k / 2, -k / 2, 19.0, 1000 + k) for k in range(7)]
    assert ("red" in found.columns) == colored
    if colored:
        assert rows(found.select("red", "green", "blue").distinct(), "red") == [(7, 255, 0)]


TRIANGLE = "v 0 0 0\nv 1 0 0\nv 0 1 0\nv 5 5 5\n"


@pytest.mark.parametrize(
    "text,normals",
    [
        ("vn 1 0 0\nvn 0 1 0\nvn 0 0 1\nvn -1 0 0\nf 1 2 3\n", [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (-1.0, 0.0, 0.0)]),  # corners without: by order
        ("vn 1 0 0\nvn 0 1 0\nf 1 2 3\n", None),  # by order, but too few
        ("vn 1 0 0\nvn 0 1 0\nf 1//1 2//1 3//1\nf 1//2 2//1 3//1\n", None),  # two normals at one vertex
        ("vn 1 0 0\nvn 0 1 0\nvn 0 0 1\nvn -1 0 0\nf 1//4 2//4 3//4\n", [(-1.0, 0.0, 0.0)] * 4),  # the vertex without a face takes its own
        ("vn 1 0 0\nf 1//1 2//1 3//1\n", None),  # and has none here
        ("vn 1 0 0\nvn 0 1 0\nvn 0 0 1\nvn -1 0 0\n", [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (-1.0, 0.0, 0.0)]),  # no faces
    ],
)
def test_obj_normals(spark, tmp_path, text, normals):
    found = read_obj(spark, text_file(tmp_path, "n.obj", TRIANGLE + text)).points
    assert ("nx" in found.columns) == (normals is not None)
    if normals:
        assert [tuple(r)[1:] for r in rows(found.select("pid", "nx", "ny", "nz"), "pid")] == normals
