"""Hole filling and smoothing in blocks against small dense versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cloudframe.operators import grid, mesh


def added(values):
    """A plain sum: Python's own makes up for rounding, which moves halves."""
    total = 0.0
    for v in values:
        total += v
    return total


def filled(cells, width, height, passes, least, radius):
    """Passes over a dictionary of ``(z, red)``."""
    out = {p: (*v, 0) for p, v in cells.items()}
    steps = [(a, b, 1 / math.hypot(a, b)) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a or b]
    for t in range(1, passes + 1):
        new = {}
        for p in ((x, y) for x in range(width) for y in range(height) if (x, y) not in out):
            near = [(out[q], w) for a, b, w in steps if (q := (p[0] + a, p[1] + b)) in out]
            if len(near) >= max(1, least):
                weight = added(w for _, w in near)
                reds = [(v[1], w) for v, w in near if v[1] is not None]
                red = math.floor(added(r * w for r, w in reds) / weight + 0.5) if reds else None
                new[p] = (added(v[0] * w for v, w in near) / weight, red, t)
        if not new:
            break
        out |= new
    return out


@pytest.mark.parametrize(("passes", "least", "radius", "block", "halo"), [(1, 1, 1, 4, 2), (7, 1, 1, 4, 2), (9, 3, 1, 5, 3), (4, 2, 2, 4, 2), (8, 1, 1, 256, 16), (40, 1, 1, 6, 1), (0, 1, 1, 4, 2)])
def test_holes_fill_alike_in_any_blocks(spark, monkeypatch, passes, least, radius, block, halo):
    monkeypatch.setattr(grid, "BLOCK", block)
    monkeypatch.setattr(grid, "HALO", halo)
    rng = random.Random(passes)
    cells = {(rng.randrange(19), rng.randrange(13)): (rng.uniform(-9, 9), rng.choice([None, rng.randrange(256)])) for _ in range(12)}
    rows = [(x, y, z, 1.0, r, r, r, 0) for (x, y), (z, r) in cells.items()]
    df = spark.createDataFrame(rows, "ix long, iy long, z double, weight double, red smallint, green smallint, blue smallint, fill_pass int").repartition(3)
    out = grid.fill_holes(grid.HeightGrid(df, 19, 13, 0.0, 0.0, 1.0, 1.0), passes, least, radius).cells
    assert out.dtypes == df.dtypes
    got = {(r.ix, r.iy): (r.z, r.blue, r.fill_pass) for r in out.collect()}
    assert out.count() == len(got)
    want = filled(cells, 19, 13, passes, least, radius)
    assert got.keys() == want.keys()
    for p, (z, red, t) in want.items():
        assert abs(got[p][0] - z) < 1e-9 and got[p][1:] == (red, t), p


def test_no_cells_stay_none(spark):
    empty = spark.createDataFrame([], "ix long, iy long, z double, weight double, fill_pass int")
    assert grid.fill_holes(grid.HeightGrid(empty, 5, 5, 0.0, 0.0, 1.0, 1.0)).cells.isEmpty()


def sheet(spark, n, extra=()):
    """A bumpy sheet of n x n vertices, a lonely vertex, one that is not finite, and a corner that is no vertex."""
    rng = random.Random(n)
    places = [(i * n + j, float(i), float(j), rng.uniform(-0.4, 0.4)) for i in range(n) for j in range(n)]
    places += [(n * n, 50.0, 50.0, 50.0), (n * n + 1, math.nan, 0.0, 0.0)]
    faces = [t for i in range(n - 1) for j in range(n - 1) for p in [i * n + j] for t in ((p, p + 1, p + n), (p + 1, p + n + 1, p + n))]
    faces += [(0, 1, 10**9), *extra]
    v = spark.createDataFrame(places, "pid long, x double, y double, z double").withColumn("label", F.concat(F.lit("v"), "pid")).repartition(3)
    f = spark.createDataFrame([(k, *t) for k, t in enumerate(faces)], "fid long, a long, b long, c long")
    return places, faces, v, f


def smoothed(places, faces, steps, fixed):
    near, sides = {}, {}
    for t in faces:
        for a, b in zip(t, (*t[1:], t[0]), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            sides[frozenset((a, b))] = sides.get(frozenset((a, b)), 0) + 1
    still = {p for s, n in sides.items() if n == 1 for p in s} if fixed else set()
    at = {p: v for p, *v in places}
    for f in steps:
        new = {}
        for p, v in at.items():
            ends = [at[q] for q in near.get(p, ()) if q in at] if p not in still else []
            new[p] = [c + f * (sum(e[k] for e in ends) / len(ends) - c) for k, c in enumerate(v)] if ends else v
        at = new
    return at


@pytest.mark.parametrize(("fixed", "rings", "most"), [(False, 4, 10**6), (True, 3, 10**6), (True, 4, 600), (False, 4, 10)])
def test_smoothing_in_blocks_equals_steps(spark, monkeypatch, fixed, rings, most):
    monkeypatch.setattr(mesh, "WORTH", 8)
    monkeypatch.setattr(mesh, "RINGS", rings)
    monkeypatch.setattr(mesh, "BLOCK_EDGES", most)
    seen = []
    made = mesh._mesh_blocks
    monkeypatch.setattr(mesh, "_mesh_blocks", lambda *a: seen.append(made(*a)) or seen[-1])
    monkeypatch.setattr(mesh, "SpatialIndex", lambda df, index=mesh.SpatialIndex: index(df, 6))
    places, faces, v, f = sheet(spark, 13)
    got = {r.pid: r for r in mesh.taubin_smooth(v, f, 5, fix_boundary=fixed).collect()}
    assert seen[0][1] == {10**6: rings, 600: 1, 10: 0}[most] or most == 600 and 0 < seen[0][1] < rings
    want = smoothed(places, faces, [0.5, -0.53] * 5, fixed)
    assert got.keys() == want.keys()
    for p, place in want.items():
        assert got[p].label == f"v{p}"
        for c, n in zip(place, "xyz", strict=True):
            assert got[p][n] == pytest.approx(c, abs=1e-9, nan_ok=True)


def test_a_vertex_with_very_many_neighbours_ends_the_rings(spark, monkeypatch):
    monkeypatch.setattr(mesh, "WORTH", 8)
    monkeypatch.setattr(mesh, "BLOCK_EDGES", 400)
    hub = 13 * 13
    places, faces, v, f = sheet(spark, 13, [(hub, p, p + 1) for p in range(0, 168, 2)])
    got = {r.pid: r for r in mesh.taubin_smooth(v, f, 5).collect()}
    want = smoothed(places, faces, [0.5, -0.53] * 5, False)
    assert all(got[p][n] == pytest.approx(c, abs=1e-9, nan_ok=True) for p, place in want.items() for c, n in zip(place, "xyz", strict=True))


def test_few_exchanges(spark, monkeypatch):
    """Forty steps write a table for each four of them, not for each step."""
    written = []
    cut = mesh.cut
    monkeypatch.setattr(mesh, "cut", lambda df, *a: written.append(1) or cut(df, *a))
    _, _, v, f = sheet(spark, 9)
    mesh.taubin_smooth(v, f, 20)
    assert len(written) <= 10 + mesh.RINGS + 6 < 40
