"""Binary PLY elements of rows with lists against a plain walk over their bytes, in ranges of any size."""

import random
import struct

import pytest

from cloudframe.sources import polygons
from cloudframe.sources.ply import read_ply, write_ply
from cloudframe.sources.polygons import DEAD, ListElement, ListRows

CODES = {"u1": "B", "u2": "H", "i4": "i", "f4": "f"}
LONG = {"u1": "uchar", "u2": "ushort", "i4": "int", "f4": "float"}


def made(properties, order, sizes, seed):
    """Bytes of rows, and the corners of each."""
    rng, body, corners = random.Random(seed), b"", []
    for n in sizes:
        for p in properties:
            if len(p) == 2:
                body += struct.pack(order + CODES[p[1]], rng.randrange(100))
                continue
            items = [rng.randrange(50) for _ in range(n if p[0] == "vertex_indices" else rng.randrange(4))]
            body += struct.pack(order + CODES[p[1]], len(items)) + struct.pack(f"{order}{len(items)}{CODES[p[2]]}", *items)
            if p[0] == "vertex_indices":
                corners.append(items)
    return body, corners


def ply(order, elements, vertices=50):
    """A file whose faces come before, and vertices after."""
    head = f"ply\nformat binary_{'little' if order == '<' else 'big'}_endian 1.0\n"
    data = b""
    for name, properties, count, body in elements:
        head += f"element {name} {count}\n" + "".join(f"property {LONG[p[1]]} {p[0]}\n" if len(p) == 2 else f"property list {LONG[p[1]]} {LONG[p[2]]} {p[0]}\n" for p in properties)
        data += body
    head += f"element vertex {vertices}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    return head.encode() + data + struct.pack(f"{order}{3 * vertices}f", *range(3 * vertices))


def fans(corners):
    return [(c[0], c[k - 1], c[k]) for c in corners for k in range(2, len(c))]


SHAPES = {
    "polygons": [("vertex_indices", "u1", "i4")],
    "two lists": [("flags", "u1"), ("vertex_indices", "u1", "i4"), ("shade", "f4"), ("uv", "u1", "f4"), ("end", "u2")],
    "long counts": [("vertex_indices", "i4", "u2")],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("order,split", [("<", 150), (">", 400)])
def test_polygons_in_any_range(spark, tmp_path, monkeypatch, shape, order, split):
    monkeypatch.setattr(polygons, "GROUP", 2)
    monkeypatch.setattr(polygons, "WINDOW", 6)  # the driver decides by both
    rng = random.Random(split)
    sizes = [rng.choice([3, 3, 4, 5, 9]) for _ in range(60)] + [200] + [3] * 5  # one row longer than several ranges
    body, corners = made(SHAPES[shape], order, sizes, 1)
    path = tmp_path / "p.ply"
    path.write_bytes(ply(order, [("face", SHAPES[shape], len(sizes), body)]))
    found = read_ply(spark, str(path), split=split)
    assert [r[1:] for r in found.faces.orderBy("fid").collect()] == fans(corners)
    assert [r.x for r in found.points.orderBy("pid").collect()] == [3.0 * k for k in range(50)]


def test_lists_of_other_elements_are_passed_over(spark, tmp_path):
    other, _ = made([("links", "u1", "u2")], "<", [0] * 30, 2)
    body, corners = made(SHAPES["polygons"], "<", [3, 4, 3, 6], 3)
    path = tmp_path / "o.ply"
    path.write_bytes(ply("<", [("strip", [("links", "u1", "u2")], 30, other), ("face", SHAPES["polygons"], 4, body), ("nothing", [("links", "u1", "u2")], 0, b"")]))
    found = read_ply(spark, str(path), split=11)
    assert [r[1:] for r in found.faces.orderBy("fid").collect()] == fans(corners)
    assert found.points.count() == 50


@pytest.mark.parametrize("cut_at", [1, 30])
def test_files_that_end_within_their_faces_raise(spark, tmp_path, cut_at):
    body, _ = made(SHAPES["polygons"], "<", [3, 4] * 20, 4)
    path = tmp_path / "e.ply"
    path.write_bytes(ply("<", [("face", SHAPES["polygons"], 40, body)], 0)[:-cut_at])
    with pytest.raises(ValueError, match="ends within a list"):
        read_ply(spark, str(path), split=17)
    path.write_bytes(ply("<", [("face", [("vertex_indices", "i4", "i4")], 2, struct.pack("<4ii", 3, 0, 1, 2, -1))], 0))
    with pytest.raises(ValueError, match="negative count"):
        read_ply(spark, str(path), split=17)


@pytest.mark.parametrize("shape", SHAPES)
def test_maps_equal_walks_from_every_place(tmp_path, shape):
    body, _ = made(SHAPES[shape], "<", [random.Random(k).randrange(3, 12) for k in range(80)], 5)
    path = tmp_path / "rows"
    path.write_bytes(body)
    element = ListElement(str(path), SHAPES[shape], "<", 0, len(body), 80, 300)
    for part in range(element.parts):
        start, stop = element.bounds(part)
        places, passed = element.rows(part).exits(stop, 10**6)
        whole = ListRows(str(path), SHAPES[shape], "<", 0, len(body), len(body))
        for k in range(stop - start):
            at, n = start + k, 0
            while DEAD < at < stop and (after := whole.row(at)) != DEAD:
                at, n = after, n + 1
            assert passed[k] == n and places[k] == (at if at >= stop else DEAD)


@pytest.mark.parametrize("format", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_polygons_round_trip(spark, tmp_path, format):
    points = spark.range(300).selectExpr("id AS pid", "double(id) x", "0D y", "1D z")
    faces = spark.range(40).selectExpr("id AS fid", "transform(sequence(0, 2 + id % 5), k -> int(k + id)) AS corners")
    path = str(tmp_path / "r.ply")
    write_ply(points, path, faces, format)
    want = [r.corners for r in faces.orderBy("fid").collect()]
    assert [r[1:] for r in read_ply(spark, path, split=64).faces.orderBy("fid").collect()] == fans(want)
    assert read_ply(spark, path).points.count() == 300
    with pytest.raises(Exception, match="over 255 corners"):
        write_ply(points, path + "x", spark.range(1).selectExpr("id AS fid", "sequence(0, 260) AS corners"), format)
