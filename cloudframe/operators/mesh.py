"""Triangle meshes: ``vertices(pid, x, y, z, ...)`` and ``faces(fid, a, b, c)``."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import NORMAL, XYZ, cell, dot, face_normal, finite, minus, norm, vector
from ..plans.lineage import cut
from .index import SpatialIndex
from .points import bounds, dense_ids, mean_attributes

#: Rings of vertices that a block of a mesh takes with it, and neighbours that a block lists, at most.
RINGS, BLOCK_EDGES = 4, 1_000_000
#: Steps from which making the rings pays.
WORTH = 32


def with_corners(vertices: DataFrame, faces: DataFrame, columns: tuple[str, ...] = XYZ) -> DataFrame:
    """Faces with the named vertex columns of their corners as structs ``pa, pb, pc``.

    Corners are exploded and joined in one equi-join, then brought together by face.
    """
    rest = [c for c in faces.columns]
    corners = faces.select(*rest, F.posexplode(F.array("a", "b", "c")).alias("__k", "__v"))
    values = vertices.select(F.col("pid").alias("__v"), F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("__p"))
    joined = corners.join(values, "__v")
    picked = [F.max(F.when(F.col("__k") == k, F.col("__p"))).alias(n) for k, n in enumerate(("pa", "pb", "pc"))]
    return joined.groupBy(*rest).agg(*picked).where("pa is not null and pb is not null and pc is not null")


def _corner(name: str) -> tuple:
    return tuple(F.col(f"{name}.{c}") for c in XYZ)


def face_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with normals ``fx, fy, fz``, twice the area long."""
    n = face_normal(_corner("pa"), _corner("pb"), _corner("pc"))
    return with_corners(vertices, faces).withColumns(dict(zip(("fx", "fy", "fz"), n, strict=True)))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices with unit normals, the area-weighted sum of their faces'; (0, 0, 1) where that vanishes."""
    each = face_normals(vertices, faces).select(F.explode(F.array("a", "b", "c")).alias("pid"), "fx", "fy", "fz")
    sums = each.groupBy("pid").agg(*[F.sum(c).alias(f"__{c}") for c in ("fx", "fy", "fz")])
    joined = vertices.drop(*NORMAL).join(sums, "pid", "left")
    s = [F.coalesce(f"__{c}", F.lit(0.0)) for c in ("fx", "fy", "fz")]
    length = norm(s)
    up = length > 1e-18
    return joined.withColumns({n: F.when(up, c / length).otherwise(F.lit(float(n == "nz"))) for n, c in zip(NORMAL, s, strict=True)}).drop("__fx", "__fy", "__fz")


def orient_outward(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flip all normals and the faces' second and third corners if the normals point inwards in sum."""
    centre = vertices.agg(*[F.avg(c).alias(f"__c{n}") for n, c in zip(XYZ, vector(), strict=True)])
    out = dot(vector(NORMAL), minus(vector(), [F.col(f"__c{n}") for n in XYZ]))
    vote = vertices.join(F.broadcast(centre)).agg(F.coalesce(F.sum(out), F.lit(0.0)).alias("__vote"))
    flip = F.col("__vote") < 0
    v = vertices.join(F.broadcast(vote)).withColumns({n: F.when(flip, -F.col(n)).otherwise(F.col(n)) for n in NORMAL}).drop("__vote")
    f = faces.join(F.broadcast(vote)).withColumns({"b": F.when(flip, F.col("c")).otherwise(F.col("b")), "c": F.when(flip, F.col("b")).otherwise(F.col("c"))}).drop("__vote")
    return v, f


def remove_degenerate_faces(vertices: DataFrame, faces: DataFrame, least_area: float = 0.0) -> DataFrame:
    """Faces with three different corners and an area over ``least_area``; vertices are not touched."""
    area = norm((F.col("fx"), F.col("fy"), F.col("fz"))) * 0.5
    return face_normals(vertices, faces.where("a <> b and b <> c and a <> c")).where(area > least_area).select(*faces.columns)


def compact(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop unused vertices and number the rest in the order in which faces first use them."""
    corners = faces.select("fid", F.posexplode(F.array("a", "b", "c")).alias("k", "pid"))
    first = corners.groupBy("pid").agg(F.min(F.struct("fid", "k")).alias("at"))
    renamed = dense_ids(first.select("pid", "at.fid", "at.k"), ["fid", "k"], "new").select("pid", "new")
    out = vertices.join(renamed, "pid").drop("pid").withColumnRenamed("new", "pid")
    return out.select("pid", *[c for c in vertices.columns if c != "pid"]), remap(faces, renamed)


def remap(faces: DataFrame, names: DataFrame) -> DataFrame:
    """Faces with corners replaced by ``names(pid, new)``; one join for all corners."""
    rest = [c for c in faces.columns if c not in "abc"]
    corners = faces.select(*rest, F.posexplode(F.array("a", "b", "c")).alias("__k", "pid")).join(names, "pid")
    return corners.groupBy(*rest).agg(*[F.max(F.when(F.col("__k") == k, F.col("new"))).alias(n) for k, n in enumerate("abc")])


def directed_edges(faces: DataFrame) -> DataFrame:
    """Neighbour pairs ``pid, neighbour``, each once in each direction."""
    pairs = F.array(*[F.struct(F.col(u).alias("pid"), F.col(v).alias("neighbour")) for u, v in ("ab", "ba", "bc", "cb", "ca", "ac")])
    return faces.select(F.explode(pairs).alias("e")).select("e.*").where("pid <> neighbour").distinct()


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges by face: ``fid, u, v`` with u < v."""
    sides = F.array(*[F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")) for u, v in ("ab", "bc", "ca")])
    return faces.select("fid", F.explode(sides).alias("e")).select("fid", "e.*")


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Edges ``u, v`` of exactly one face."""
    return edges(faces).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("u", "v")


def _mesh_blocks(vertices: DataFrame, pairs: DataFrame, rings: int, most: int) -> tuple[DataFrame | None, int, int]:
    """Blocks of near vertices with up to ``rings`` rings of vertices around each.

    Gives rows ``block, pid, ring, near``, the number of rings and that of blocks. ``near`` holds the
    neighbours of all but the last ring. A ring is added only if the neighbours in each block then
    number at most ``most``, which is counted before anything is listed: a vertex with very many
    neighbours ends the rings. Without any ring there is no table.
    """
    degrees = cut(pairs.groupBy("pid").agg(F.count(F.lit(1)).alias("n")))
    placed = finite(*vector())
    at = SpatialIndex(vertices.where(placed).select("pid", *[c.alias(f"p{n}") for n, c in zip(XYZ, vector(), strict=True)]))
    blocks = len(at.parts.n)
    rest = vertices.where(~placed).select("pid", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int").alias("block"))
    ring = inside = cut(at.points.select("pid", F.col("part").alias("block")).unionByName(rest).withColumn("ring", F.lit(0)))
    for k in range(rings):
        sizes = inside.join(degrees, "pid").groupBy("block").agg(F.sum("n").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) > most:
            rings = k
            break
        found = ring.join(pairs, "pid").select("block", F.col("neighbour").alias("pid")).distinct()
        ring = cut(found.join(inside.select("block", "pid"), ["block", "pid"], "left_anti").withColumn("ring", F.lit(k + 1)))
        inside = inside.unionByName(ring)
    if not rings:
        return None, 0, blocks
    lists = inside.where(F.col("ring") < rings).join(pairs, "pid").groupBy("block", "pid").agg(F.collect_list("neighbour").alias("near"))
    return cut(inside.join(lists, ["block", "pid"], "left")), rings, blocks


def _smooth_block(factors: list[float]):
    """Steps over the vertices of a block and its rings; the block's own vertices are given back."""

    def run(table: pa.Table) -> pa.Table:
        pid, own = table["pid"].to_numpy(), table["ring"].to_numpy() == 0
        near = table["near"].combine_chunks()
        ends, listed = near.flatten().to_numpy(), pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False)
        order = np.argsort(pid)
        to = order[np.minimum(np.searchsorted(pid, ends, sorter=order), len(pid) - 1)]
        known = pid[to] == ends  # a corner that is no vertex has no place
        row, to = np.repeat(np.arange(len(pid)), listed)[known], to[known]
        number = np.bincount(row, minlength=len(pid))
        moves, place = number > 0, np.stack([table[c].to_numpy() for c in XYZ], axis=1)
        for f in factors:
            mean = np.stack([np.bincount(row, axis[to], len(pid)) for axis in place.T], axis=1)[moves] / number[moves, None]
            place[moves] += f * (mean - place[moves])
        return pa.table({"pid": pid[own], **dict(zip(XYZ, place[own].T, strict=True))})

    return run


def taubin_smooth(vertices: DataFrame, faces: DataFrame, iterations: int, first: float = 0.5, second: float = -0.53, fix_boundary: bool = False) -> DataFrame:
    """Move vertices towards and away from the mean of their neighbours, ``iterations`` times.

    The edge list is made once. With at least ``WORTH`` steps, vertices are dealt to blocks of
    near ones, each with rings of vertices around it, and a block does as many steps inside its task
    as it has rings: one exchange and one written table for them. Where a block's rings would hold
    over ``BLOCK_EDGES`` neighbours (a vertex with very many), and for few steps, each step is a join,
    a mean and a written table. Vertices without neighbours (with ``fix_boundary`` also those of
    boundary edges) stay. Coordinates are not null. Normals, if there are any, are computed anew.
    """
    if iterations < 0 or not (math.isfinite(first) and math.isfinite(second)):
        raise ValueError("iterations are not negative and factors finite")
    steps = [float(f) for f in (first, second) if f] * iterations
    pairs = cut(directed_edges(faces))
    if fix_boundary:
        still = boundary_edges(faces).select(F.explode(F.array("u", "v")).alias("pid")).distinct()
        pairs = cut(pairs.join(still, "pid", "left_anti"))
    out = vertices.drop(*NORMAL).withColumns(dict(zip(XYZ, vector(), strict=True)))
    blocks, rings, n = _mesh_blocks(out, pairs, RINGS, BLOCK_EDGES) if len(steps) >= WORTH else (None, 0, 0)
    if blocks is not None:
        now = out.select("pid", *XYZ)
        for k in range(0, len(steps), rings):
            run = _smooth_block(steps[k : k + rings])
            now = cut(blocks.join(now, "pid").repartition(n, "block").groupBy("block").applyInArrow(run, "pid long, x double, y double, z double"))
        moved = now.select("pid", *[F.coalesce(c, F.lit(math.nan)).alias(f"__{c}") for c in XYZ])
        out = out.join(moved, "pid", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in XYZ}).drop(*[f"__{c}" for c in XYZ])
    for factor in () if blocks is not None else steps:
        near = pairs.join(out.select(F.col("pid").alias("neighbour"), *[F.col(c).alias(f"__{c}") for c in XYZ]), "neighbour")
        means = near.groupBy("pid").agg(*[F.avg(f"__{c}").alias(f"__{c}") for c in XYZ])
        out = out.join(means, "pid", "left").withColumns({c: F.col(c) + F.coalesce(F.lit(factor) * (F.col(f"__{c}") - F.col(c)), F.lit(0.0)) for c in XYZ})
        out = cut(out.drop(*[f"__{c}" for c in XYZ]))
    return vertex_normals(out, faces) if set(NORMAL) <= set(vertices.columns) else out


def face_components(faces: DataFrame) -> DataFrame:
    """``fid, component``: the lowest face reachable over shared edges. Minimum labels travel over edges until none changes.

    Labels also jump to the label of their label's face, so the rounds grow with the logarithm of a
    component's width. Every round is checkpointed.
    """
    sides = cut(edges(faces))
    labels = faces.select("fid", F.col("fid").alias("component"))
    while True:
        by_edge = sides.join(labels, "fid").groupBy("u", "v").agg(F.min("component").alias("low"))
        low = sides.join(by_edge, ["u", "v"]).groupBy("fid").agg(F.min("low").alias("low"))
        new = labels.join(low, "fid", "left").select("fid", "component", F.least("component", F.coalesce("low", "component")).alias("low"))
        jump = new.select(F.col("fid").alias("low"), F.col("low").alias("next"))
        new = cut(new.join(jump, "low", "left").select("fid", "component", F.least("low", F.coalesce("next", "low")).alias("new")))
        changed = new.where("new <> component").limit(1).count()
        labels = new.select("fid", F.col("new").alias("component"))
        if not changed:
            return labels


def remove_small_components(vertices: DataFrame, faces: DataFrame, least_faces: int) -> tuple[DataFrame, DataFrame]:
    """Keep components of at least so many faces; faces are numbered component by component, vertices compacted."""
    labels = cut(face_components(faces))
    large = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_faces)
    kept = faces.join(labels.join(large, "component").select("fid", "component"), "fid")
    ordered = dense_ids(kept.withColumnRenamed("fid", "__old"), ["component", "__old"], "fid").select("fid", "a", "b", "c")
    return compact(vertices, ordered)


def cluster_vertices(vertices: DataFrame, faces: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Merge the vertices of each cell of a grid that begins at the least coordinates.

    New vertices are means (colours and intensities rounded), numbered in cell order; faces follow,
    those with two equal corners go, repeated ones stay.
    """
    if not (math.isfinite(size) and size > 0):
        raise ValueError("a cell size is finite and positive")
    box = bounds(vertices).first()
    keys = {k: cell(c, size, F.lit(box[f"min_{n}"] or 0.0)) for k, n, c in zip(("kx", "ky", "kz"), XYZ, vector(), strict=True)}
    keyed = vertices.withColumns(keys)
    merged = keyed.groupBy("kx", "ky", "kz").agg(*[F.avg(c).alias(n) for n, c in zip(XYZ, vector(), strict=True)], *mean_attributes(vertices.drop(*NORMAL), scalars=False))
    merged = dense_ids(merged, ["kx", "ky", "kz"])
    names = keyed.select("pid", "kx", "ky", "kz").join(merged.select(F.col("pid").alias("new"), "kx", "ky", "kz"), ["kx", "ky", "kz"]).select("pid", "new")
    return merged.drop("kx", "ky", "kz"), remap(faces, names).where("a <> b and b <> c and a <> c")


def quality(vertices: DataFrame, faces: DataFrame, radius: float) -> DataFrame:
    """One row of figures about a mesh of a sphere around the origin.

    Counts of vertices, faces, faces with a corner that is no vertex (``invalid_faces``) and valid
    faces of no area; distances of the vertices from the sphere and their largest coordinate; and,
    of the faces with an area that look outward or inward, the share that looks outward and the
    share of the commoner side. Shares of nothing are 0, as all figures of an empty mesh.
    """
    error = F.abs(norm(vector()) - F.lit(float(radius)))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    v = vertices.agg(F.count(F.lit(1)).alias("vertex_count"), zero(F.max(error), "max_radius_error"), zero(F.avg(error), "mean_radius_error"), zero(F.max(F.greatest(*map(F.abs, vector()))).cast("double"), "max_abs_coordinate"))
    all_faces = faces.agg(F.count(F.lit(1)).alias("face_count"))
    n = tuple(F.col(c) for c in ("fx", "fy", "fz"))
    middle = tuple((F.col(f"pa.{c}") + F.col(f"pb.{c}") + F.col(f"pc.{c}")) / 3 for c in XYZ)
    empty, side = norm(n) <= 1e-10, dot(n, middle)
    f = face_normals(vertices, faces).agg(
        F.count(F.lit(1)).alias("valid"), F.count_if(empty).alias("degenerate_faces"), F.count_if(~empty & (side > 1e-12)).alias("outward"), F.count_if(~empty & (side < -1e-12)).alias("inward")
    )
    share = lambda a, b, name: zero(F.try_divide(a, b), name)
    sides = F.col("outward") + F.col("inward")
    return v.join(F.broadcast(all_faces)).join(F.broadcast(f)).select(
        "vertex_count", "face_count", (F.col("face_count") - F.col("valid")).alias("invalid_faces"), "degenerate_faces", share(F.col("degenerate_faces"), F.col("valid"), "degenerate_ratio"),
        "max_radius_error", "mean_radius_error", "max_abs_coordinate", share(F.col("outward"), sides, "outward_ratio"), share(F.greatest("outward", "inward"), sides, "dominant_ratio"),
    )
