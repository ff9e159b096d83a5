"""Marching cubes on functions, splatted fields and the orientation of faces."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.operators import iso
from cloudframe.operators.mesh import quality
from cloudframe.operators.report import write_mesh_report
from cloudframe.sources.ply import read_ply

SCHEMA = "pid long, x double, y double, z double, nx double, ny double, nz double"


def soup(vertices):
    """Triangles as an array (n, 3, 3), from vertices numbered face by face."""
    rows = sorted((r.pid, r.x, r.y, r.z) for r in vertices.collect())
    return np.array([r[1:] for r in rows]).reshape(-1, 3, 3)


def volume(t):
    return np.einsum("ij,ij->i", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6


def open_edges(t):
    """Edges with an odd number of triangles; edges without length are none."""
    used = Counter()
    for face in np.round(t, 7) + 0.0:
        corners = [tuple(c) for c in face]
        used.update(tuple(sorted((a, b))) for a, b in zip(corners, corners[1:] + corners[:1], strict=True) if a != b)
    return sum(n % 2 for n in used.values()), len(used)


def test_sphere(spark):
    v, f = iso.marching_cubes(spark, lambda x, y, z: F.sqrt(x * x + y * y + z * z) - 2, (-3.0,) * 3, (3.0,) * 3, (24, 24, 24))
    t = soup(v)
    assert f.count() == len(t) and open_edges(t)[0] == 0
    assert np.allclose(np.sqrt((t**2).sum(axis=2)), 2, atol=0.05)
    assert 0.97 < volume(t) / (math.pi * 32 / 3) < 1  # seen from outside, less what chords cut off


def test_noise_is_closed(spark):
    """A field that crosses many faces at all four edges."""

    def field(x, y, z):
        noise = F.pmod(F.xxhash64(F.round(x, 3), F.round(y, 3), F.round(z, 3)), F.lit(2000)) / 1000 - 0.9995
        return F.when(F.greatest(F.abs(x), F.abs(y), F.abs(z)) > 0.99, F.lit(1.0)).otherwise(noise)

    wrong, edges = open_edges(soup(iso.marching_cubes(spark, field, (-1.0,) * 3, (1.0,) * 3, (9, 9, 9))[0]))
    assert wrong == 0 and edges > 1000


def test_splat_and_density_surface(spark):
    rng = np.random.default_rng(6)
    a = rng.uniform(0.5, 2.5, (200, 3))
    cloud = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(a)], "pid long, x double, y double, z double").repartition(3)
    low, step = (-1.0, -1.0, -1.0), (0.5, 0.4, 0.25)
    want = Counter()
    for p in a:
        g = (p - low) / step
        i = np.floor(g).astype(int)
        for c in iso.CORNERS:
            want[tuple((i + c).tolist())] += float(np.prod(np.where(c, g - i, 1 - (g - i))))
    found = {(r.ix, r.iy, r.iz): r.value for r in iso.splat_field(cloud, low, step).collect()}
    assert set(found) == {k for k, w in want.items() if w} and all(math.isclose(found[k], want[k], abs_tol=1e-12) for k in found)
    assert math.isclose(sum(found.values()), 200)
    t = soup(iso.density_surface(cloud, low, step, (16, 16, 24), 0.3)[0])
    assert open_edges(t)[0] == 0 and volume(t) > 0
    assert iso.density_surface(cloud.limit(0), low, step, (16, 16, 24), 0.3)[0].count() == 0
    with pytest.raises(ValueError):
        iso.density_surface(cloud, low, step, (4, 4, 4), 0.0)


def test_orientation_follows_the_nearest_normal(spark):
    """Each face is compared with the point nearest to its centre, the lowest id among equals; null and level faces stay."""
    rng = np.random.default_rng(12)
    p, n = rng.uniform(-1, 1, (60, 3)), rng.normal(size=(60, 3))
    p[1] = p[0]  # a tie
    v = rng.uniform(-1, 1, (50, 3))
    faces = [(k, *map(int, rng.choice(50, 3, replace=False))) for k in range(80)] + [(80, 3, 3, 4)]
    cloud = spark.createDataFrame([(k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(p, n, strict=True))], SCHEMA)
    vertices = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(v)], "pid long, x double, y double, z double")
    want = {}
    for k, a, b, c in faces:
        centre = (v[a] + v[b] + v[c]) / 3
        normal = n[((p - centre) ** 2).sum(axis=1).argmin()]
        turn = np.cross(v[b] - v[a], v[c] - v[a]) @ normal < 0
        want[k] = (a, c, b) if turn else (a, b, c)
    found = iso.orient_faces(vertices, spark.createDataFrame(faces, "fid long, a long, b long, c long"), cloud)
    assert {r.fid: (r.a, r.b, r.c) for r in found.collect()} == want
    assert any(want[k] != f[1:] for k, f in zip(want, map(tuple, faces), strict=True)) and any(want[k] == f[1:] for k, f in zip(want, map(tuple, faces), strict=True))


def test_quality_counts_invalid_and_empty_faces_apart(spark):
    corners = [(0, 0.0, 0.0, 2.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.0, 0.0, -3.0)]
    vertices = spark.createDataFrame(corners, "pid long, x double, y double, z double")
    # Outward, outward, inward; no area; a corner that is none, or null.
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 0), (2, 1, 3, 2), (3, 1, 2, 3), (4, 0, 0, 1), (5, 0, 1, 9), (6, 0, 1, None)], "fid long, a int, b int, c int")
    row = quality(vertices, faces, 2.0).first().asDict()
    outward = sum(np.dot(np.cross(np.subtract(b, a), np.subtract(c, a)), np.add(np.add(a, b), c)) > 0 for a, b, c in ([corners[k][1:] for k in f] for f in ((0, 1, 2), (1, 2, 0), (1, 3, 2), (1, 2, 3))))
    assert (row["vertex_count"], row["face_count"], row["invalid_faces"], row["degenerate_faces"]) == (4, 7, 2, 1)
    assert row["degenerate_ratio"] == 1 / 5 and row["max_abs_coordinate"] == 3.0
    assert row["max_radius_error"] == 1.0 and row["mean_radius_error"] == 0.25
    assert row["outward_ratio"] == outward / 4 and row["dominant_ratio"] == max(outward, 4 - outward) / 4
    empty = quality(vertices.limit(0), faces.limit(0), 2.0).first()
    assert set(empty) == {0}


def test_reports_of_several_meshes(spark, tmp_path):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 2.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0)], "pid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2)], "fid long, a int, b int, c int")
    figures = write_mesh_report({"b-1": (vertices, faces), "a_2": (vertices, faces)}, 2.0, str(tmp_path))
    document = json.loads((tmp_path / "report.json").read_text())
    assert list(document) == ["a_2", "b-1"] and document["a_2"] == {k: v for k, v in figures.first().asDict().items() if k != "name"}
    assert read_ply(spark, str(tmp_path / "b-1.ply")).faces.count() == 1
    with pytest.raises(ValueError, match="no name"):
        write_mesh_report({"../x": (vertices, faces)}, 2.0, str(tmp_path))
