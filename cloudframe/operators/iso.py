"""Iso-surfaces: marching cubes over a column expression or a sampled field, and surfaces from oriented points."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import NORMAL, XYZ, cross, dot, finite, norm, vector
from ..plans.lineage import cut
from .points import bounds, checked, dense_ids
from .spatial import nearest

# Corners of a cube and the pairs of corners that its edges join.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))
#: Side of the blocks of cells that are relaxed in one task, and half sweeps between their exchanges.
BLOCK, HALO = 32, 8
#: Samples that one extraction may have.
MOST_SAMPLES = 100_000_000


@lru_cache(1)
def triangles() -> list[list[tuple[int, int, int]]]:
    """For each set of inside corners the triangles between crossed edges, made by rule.

    On every face the surface joins crossed edges; where all four are crossed each inside corner is
    cut off by itself. The joins form closed loops, which are cut into fans.
    """
    name = {frozenset(e): k for k, e in enumerate(EDGES)}
    faces = []
    for axis in range(3):
        for side in (0, 1):
            ring = [k for k, c in enumerate(CORNERS) if c[axis] == side]
            order = [ring[0]]
            while len(order) < 4:
                order.append(next(k for k in ring if k not in order and frozenset((order[-1], k)) in name))
            faces.append(order)
    out = []
    for inside in range(256):
        joins: dict[int, list[int]] = {}
        for ring in faces:
            crossed = [name[frozenset((ring[i], ring[(i + 1) % 4]))] for i in range(4) if (inside >> ring[i] & 1) != (inside >> ring[(i + 1) % 4] & 1)]
            pairs = [tuple(crossed)] if len(crossed) == 2 else []
            if len(crossed) == 4:
                pairs = [(name[frozenset((ring[i - 1], ring[i]))], name[frozenset((ring[i], ring[(i + 1) % 4]))]) for i in range(4) if inside >> ring[i] & 1]
            for a, b in pairs:
                joins.setdefault(a, []).append(b)
                joins.setdefault(b, []).append(a)
        found, left = [], set(joins)
        while left:
            loop = [min(left)]
            left.discard(loop[0])
            while step := [e for e in joins[loop[-1]] if e in left]:
                loop.append(step[0])
                left.discard(step[0])
            found += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
        out.append(found)
    return out


def _extract(cubes: DataFrame, low: tuple, step: tuple, iso: float) -> tuple[DataFrame, DataFrame]:
    """``cubes(ix, iy, iz, vals)`` with eight corner values to vertices and faces; three vertices of its own for each face."""
    spark = cubes.sparkSession
    v = [F.col("vals")[k] for k in range(8)]
    case = sum((F.when(c < iso, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(v[1:], 1)), F.when(v[0] < iso, F.lit(1)).otherwise(F.lit(0)))
    table = spark.createDataFrame([(k, t, *e) for k, found in enumerate(triangles()) for t, e in enumerate(found)], "case int, t int, e0 int, e1 int, e2 int")
    cut_up = cubes.withColumn("case", case).where((F.col("case") > 0) & (F.col("case") < 255)).join(F.broadcast(table), "case")
    ends = [F.array(*[F.lit(e[k]) for e in EDGES]) for k in (0, 1)]
    offsets = [F.array(*[F.lit(c[a]) for c in CORNERS]) for a in range(3)]

    def place(edge: str) -> Column:
        a, b = (F.element_at(e, F.col(edge) + 1) for e in ends)
        va, vb = (F.element_at("vals", c + 1) for c in (a, b))
        t = F.when(va == vb, F.lit(0.5)).otherwise((F.lit(iso) - va) / F.when(va == vb, F.lit(1.0)).otherwise(vb - va))
        out = []
        for n, i, o, s, off in zip(XYZ, ("ix", "iy", "iz"), low, step, offsets, strict=True):
            pa, pb = (F.lit(o) + (F.col(i) + F.element_at(off, c + 1)) * F.lit(s) for c in (a, b))
            out.append((pa + t * (pb - pa)).alias(n))
        return F.struct(*out)

    t = cut_up.select("ix", "iy", "iz", "t", "vals", *[place(f"e{k}").alias(f"p{k}") for k in range(3)])
    p = [tuple(F.col(f"p{k}.{n}") for n in XYZ) for k in range(3)]
    n = cross(tuple(b - a for a, b in zip(p[0], p[1], strict=True)), tuple(b - a for a, b in zip(p[0], p[2], strict=True)))
    gradient = [(sum((v[k] if CORNERS[k][a] else -v[k] for k in range(1, 8)), v[0] if CORNERS[0][a] else -v[0])) / F.lit(4 * step[a]) for a in range(3)]
    turned = dot(n, gradient) < 0
    t = t.withColumns({"q1": F.when(turned, F.col("p2")).otherwise(F.col("p1")), "q2": F.when(turned, F.col("p1")).otherwise(F.col("p2"))})
    numbered = dense_ids(t.select("ix", "iy", "iz", "t", "p0", "q1", "q2"), ["iz", "iy", "ix", "t"], "fid")
    vertices = numbered.select("fid", F.posexplode(F.array("p0", "q1", "q2")).alias("k", "p")).select((F.col("fid") * 3 + F.col("k")).alias("pid"), "p.*")
    return vertices, numbered.select("fid", *[(F.col("fid") * 3 + k).alias(n) for k, n in enumerate("abc")])


def marching_cubes(
    spark, f: Callable[[Column, Column, Column], Column], low=(-1.0, -1.0, -1.0), high=(1.0, 1.0, 1.0), resolution=(10, 10, 10), iso: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """The surface ``f = iso`` of a function that builds a column from three coordinate columns.

    Cubes are numbered by ``range`` and evaluate their eight corners in place, so nothing is
    shuffled before the surface itself. A sample that is not finite raises.
    """
    if not all(map(math.isfinite, (*low, *high, iso))) or not all(a < b for a, b in zip(low, high, strict=True)) or min(resolution) <= 0:
        raise ValueError("bounds are finite and not empty, the resolution positive and the iso level finite")
    nx, ny, nz = resolution
    if (nx + 1) * (ny + 1) * (nz + 1) > MOST_SAMPLES:
        raise ValueError(f"over {MOST_SAMPLES} samples")
    step = tuple((b - a) / n for a, b, n in zip(low, high, resolution, strict=True))
    cubes = spark.range(nx * ny * nz).select((F.col("id") % nx).alias("ix"), (F.floor(F.col("id") / nx) % ny).cast("long").alias("iy"), F.floor(F.col("id") / (nx * ny)).cast("long").alias("iz"))
    at = lambda i, o, s, d: F.lit(float(o)) + (F.col(i) + d) * F.lit(float(s))
    samples = [f(*[at(i, o, s, d) for i, o, s, d in zip(("ix", "iy", "iz"), low, step, c, strict=True)]).cast("double") for c in CORNERS]
    sampled = checked(cubes.withColumn("vals", F.array(*samples)), "a sample is not finite", *[F.col("vals")[k] for k in range(8)])
    return _extract(sampled, tuple(map(float, low)), step, float(iso))


def marching_cubes_sampled(samples: DataFrame, low, step, size: tuple[int, int, int], iso: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The surface of a sparse field ``samples(ix, iy, iz, value)``, 0 elsewhere; ``size``: cubes along each axis.

    Every sample goes to the cubes that it is a corner of and cubes gather their corners, so only
    cubes near samples exist.
    """
    spots = F.explode(F.array(*[F.struct(*[(F.col(i) - d).alias(i) for i, d in zip(("ix", "iy", "iz"), c, strict=True)], F.lit(k).alias("k")) for k, c in enumerate(CORNERS)]))
    near = samples.select(spots.alias("c"), "value").select("c.*", "value")
    for i, n in zip(("ix", "iy", "iz"), size, strict=True):
        near = near.where(F.col(i).between(0, n - 1))
    cubes = near.groupBy("ix", "iy", "iz").agg(F.array(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("value"))), F.lit(0.0)) for k in range(8)]).alias("vals"))
    return _extract(cubes, low, step, iso)


def splat_field(cloud: DataFrame, low, step, weight: Column | None = None) -> DataFrame:
    """A sparse field ``ix, iy, iz, value``: each point adds its trilinear weights (times ``weight``) to the eight samples around it.

    One partial and one final aggregation; samples without a point are no rows. A point that is not
    finite raises.
    """
    x, y, z = vector()
    good = checked(cloud, "a point of a field is not finite", x, y, z)
    at = {g: (c - F.lit(float(o))) / F.lit(float(s)) for g, c, o, s in zip(("gx", "gy", "gz"), (x, y, z), low, step, strict=True)}
    placed = good.select(*[c.alias(g) for g, c in at.items()], (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    share = lambda g, d: F.col(g) - F.floor(g) if d else 1 - (F.col(g) - F.floor(g))
    corners = [F.struct(*[(F.floor(g) + d).cast("long").alias(i) for i, g, d in zip(("ix", "iy", "iz"), at, c, strict=True)], (share("gx", c[0]) * share("gy", c[1]) * share("gz", c[2]) * F.col("w")).alias("value")) for c in CORNERS]
    return placed.select(F.explode(F.array(*corners)).alias("c")).select("c.*").where("value <> 0").groupBy("ix", "iy", "iz").agg(F.sum("value").alias("value"))


def density_surface(cloud: DataFrame, low, step, size: tuple[int, int, int], level: float) -> tuple[DataFrame, DataFrame]:
    """The surface around the places where the splatted weight of a cloud exceeds ``level``: only cubes near points exist.

    It is closed if no point is within two steps of the sides of the ``size`` cubes; normals look away from the points.
    """
    if not level > 0:
        raise ValueError("a level is positive, as there is no weight outside")
    field = splat_field(cloud, low, step)
    return marching_cubes_sampled(field.withColumn("value", -F.col("value")), tuple(map(float, low)), tuple(map(float, step)), size, -float(level))


def poisson_box(cloud: DataFrame) -> tuple[tuple[float, float, float], float]:
    """Corner and side of the cube in which a cloud is reconstructed: its box, padded by a fifth of the longest side."""
    box = bounds(cloud).first()
    low, high = ([box[f"{m}_{n}"] for n in XYZ] for m in ("min", "max"))
    pad = 0.2 * max(*(b - a for a, b in zip(low, high, strict=True)), 1e-6)
    low, high = [a - pad for a in low], [b + pad for b in high]
    side = max(b - a for a, b in zip(low, high, strict=True))
    return tuple((a + b) / 2 - side / 2 for a, b in zip(low, high, strict=True)), side


def poisson_cells(cloud: DataFrame, depth: int, low, side: float) -> DataFrame:
    """Occupied cells of the cube cut into 2^depth along each axis, with their mean normals: ``ix, iy, iz, weight, vx, vy, vz``."""
    h, most = side / 2**depth, 2**depth - 1
    index = {i: F.least(F.floor((c - F.lit(o)) / F.lit(h)), F.lit(most)).cast("long") for i, c, o in zip(("ix", "iy", "iz"), vector(), low, strict=True)}
    good = checked(cloud, "points and normals of a reconstruction are finite and normals not zero", *vector(), *vector(NORMAL), 1 / F.nullif(dot(vector(NORMAL), vector(NORMAL)), F.lit(0.0)))
    placed = good.withColumns(index)
    share = [1 - F.abs(c - (F.lit(o) + (F.col(i) + 0.5) * F.lit(h))) / F.lit(h / 2) for i, c, o in zip(("ix", "iy", "iz"), vector(), low, strict=True)]
    placed = placed.withColumn("w", F.greatest(share[0] * share[1] * share[2], F.lit(0.0)))
    sums = placed.groupBy("ix", "iy", "iz").agg(F.sum("w").alias("weight"), *[F.sum(F.col("w") * c).alias(f"s{n}") for n, c in zip(XYZ, vector(NORMAL), strict=True)])
    return sums.select("ix", "iy", "iz", "weight", *[(F.col(f"s{n}") / F.greatest("weight", F.lit(1e-10))).alias(f"v{n}") for n in XYZ])


def poisson_divergence(cells: DataFrame, h: float) -> DataFrame:
    """Cells with the divergence of their normals over the neighbours that exist, each difference over 2h.

    A cell sends its values to its six neighbours; one aggregation brings them together.
    """
    own = F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(0).alias("dz"), F.lit("own").alias("k"))
    sent = [own]
    for a, n in enumerate(XYZ):
        for d in (-1, 1):  # to the neighbour on that side, for which this cell lies on the other
            sent.append(F.struct(*[F.lit(d if b == a else 0).alias(f"d{m}") for b, m in enumerate(XYZ)], F.lit(f"{n}{'p' if d < 0 else 'm'}").alias("k")))
    rows = cells.select("*", F.explode(F.array(*sent)).alias("s"))
    rows = rows.select(*[(F.col(f"i{n}") + F.col(f"s.d{n}")).alias(f"i{n}") for n in XYZ], "s.k", "weight", "vx", "vy", "vz")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    out = [pick("own", "weight").alias("weight"), *[pick("own", f"v{n}").alias(f"v{n}") for n in XYZ], *[pick(f"{n}{s}", f"v{n}").alias(f"{n}{s}") for n in XYZ for s in "pm"]]
    met = rows.groupBy("ix", "iy", "iz").agg(*out).where("weight is not null")
    parts = []
    for n in XYZ:
        p, m, v = F.col(f"{n}p"), F.col(f"{n}m"), F.col(f"v{n}")
        up, down = F.coalesce(p, v), F.coalesce(m, v)
        parts.append((up - down) / F.lit(2 * h))
    return met.select("ix", "iy", "iz", "weight", "vx", "vy", "vz", (parts[0] + parts[1] + parts[2]).alias("divergence"))


def _half_sweeps(times: range, side: int, halo: int, lasts: int | None):
    """Half sweeps over a block of cells and the ``halo`` cells around it; the block's own cells are given back.

    At time t those cells move whose indices sum to t, t - 2, ...; with ``lasts`` only up to the sum
    t - lasts (exclusive), so that each moves lasts / 2 times, beginning when t reaches its sum.
    """
    shape = (side + 2 * halo + 2,) * 3

    def around(v: np.ndarray) -> np.ndarray:
        return v[:-2, 1:-1, 1:-1] + v[2:, 1:-1, 1:-1] + v[1:-1, :-2, 1:-1] + v[1:-1, 2:, 1:-1] + v[1:-1, 1:-1, :-2] + v[1:-1, 1:-1, 2:]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = [int(pdf[f"b{n}"].iloc[0]) for n in XYZ]
        own = np.logical_and.reduce([pdf[f"i{n}"].to_numpy() // side == b for n, b in zip(XYZ, block, strict=True)])
        if not own.any():
            return pdf.loc[own, ["ix", "iy", "iz", "load", "value"]]
        low = [b * side - halo - 1 for b in block]
        at = tuple(pdf[f"i{n}"].to_numpy() - o for n, o in zip(XYZ, low, strict=True))
        here, load, value = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        here[at], load[at], value[at] = 1, pdf["load"], pdf["value"]
        number, load, inner = around(here), load[1:-1, 1:-1, 1:-1], value[1:-1, 1:-1, 1:-1]
        moves = (here[1:-1, 1:-1, 1:-1] > 0) & (number > 0)
        sums = np.indices(inner.shape).sum(axis=0) + sum(low) + 3
        for t in times:
            now = moves & ((t - sums) % 2 == 0)
            if lasts is not None:
                now &= (t >= sums) & (t < sums + lasts)
            if now.any():
                inner[now] = ((around(value) - load)[now]) / number[now]
        return pdf.loc[own, ["ix", "iy", "iz", "load"]].assign(value=value[at][own])

    return run


def poisson_solve(cells: DataFrame, h: float, depth: int, iterations: int = 30, in_order: bool = False) -> DataFrame:
    """``ix, iy, iz, value``: relaxed solution of the Poisson equation on occupied cells.

    By default red-black sweeps. ``in_order`` gives, to the bit, what sweeps in the order of the
    octree walk give: there a cell comes after its lower and before its upper neighbours on every
    axis, so all cells whose indices have one sum may move together, and sweep k + 1 follows sweep k
    two sums behind. Either way cells are dealt to blocks, each with as many cells around it as
    half sweeps are done before the blocks exchange (HALO): one shuffle and one written table for
    each HALO half sweeps. A block is one task's work and bounded, however many cells there are.
    In order there are as many half sweeps more as the grid has sums: a deep grid takes many rounds.
    """
    side, halo = max(1, min(BLOCK, 2**depth)), HALO
    total = F.col("ix") + F.col("iy") + F.col("iz")
    now = cut(cells.select("ix", "iy", "iz", (F.col("divergence") * F.lit(h * h)).alias("load"), F.lit(0.0).alias("value")))
    begin, end, lasts = 0, 2 * iterations, None
    if in_order:
        ends = now.agg(F.min(total), F.max(total)).first()
        begin, lasts = ends[0] or 0, 2 * iterations
        end = (ends[1] or 0) + lasts - 1
    for t in range(begin, end, halo):
        dealt = now
        for n in XYZ:
            blocks = F.sequence(F.floor((F.col(f"i{n}") - halo) / side), F.floor((F.col(f"i{n}") + halo) / side))
            dealt = dealt.withColumn(f"b{n}", F.explode(blocks))
        run = _half_sweeps(range(t, min(t + halo, end)), side, halo, lasts)
        now = cut(dealt.groupBy("bx", "by", "bz").applyInPandas(run, "ix long, iy long, iz long, load double, value double"))
    return now.select("ix", "iy", "iz", "value")


def orient_faces(vertices: DataFrame, faces: DataFrame, cloud: DataFrame) -> DataFrame:
    """Swap corners of faces that look against the normal of the point nearest to their centre."""
    from .mesh import face_normals

    f = face_normals(vertices, faces)
    middle = {n: (F.col(f"pa.{n}") + F.col(f"pb.{n}") + F.col(f"pc.{n}")) / 3 for n in XYZ}
    near = nearest(cloud, f.select(F.col("fid").alias("pid"), *[c.alias(n) for n, c in middle.items()])).select(F.col("qid").alias("fid"), F.col("pid").alias("__p"))
    normals = cloud.select(F.col("pid").alias("__p"), *NORMAL)
    joined = f.join(near, "fid").join(normals, "__p", "left")
    n = tuple(F.col(c) for c in ("fx", "fy", "fz"))
    turn = (dot(n, n) > 1e-20) & (F.coalesce(dot(n, vector(NORMAL)), F.lit(0.0)) < -1e-12)
    return joined.select("fid", "a", F.when(turn, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(turn, F.col("b")).otherwise(F.col("c")).alias("c"))


def poisson(cloud: DataFrame, depth: int = 6, iterations: int = 30, in_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """Surface of a cloud with normals: cells, divergence, relaxation, marching cubes, orientation."""
    if not 1 <= depth <= 8 or iterations <= 0:
        raise ValueError("the depth is 1 to 8 and iterations are positive")
    if not set(NORMAL) <= set(cloud.columns):
        raise ValueError("a reconstruction needs normals")
    low, side = poisson_box(cloud)
    h = side / 2**depth
    cells = poisson_divergence(poisson_cells(cloud, depth, low, side), h)
    field = cut(poisson_solve(cells, h, depth, iterations, in_order))
    vertices, faces = marching_cubes_sampled(field, low, (h, h, h), (2**depth,) * 3)
    return vertices, orient_faces(vertices, faces, cloud)


__all__ = ["density_surface", "finite", "marching_cubes", "marching_cubes_sampled", "norm", "orient_faces", "poisson", "poisson_box", "poisson_cells", "poisson_divergence", "poisson_solve", "splat_field", "triangles"]
