"""Height grids: splatting, hole filling, points and meshes of a grid. Only cells that hold a height are rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import COLOR, finite, vector
from ..plans.lineage import cut
from .points import bounds, checked, dense_ids, half_up
from .selection import kth_smallest
from .spatial import nearest

#: Cells of a block's side, and cells around it that it takes with it, about.
BLOCK, HALO = 256, 16


@dataclass(frozen=True)
class HeightGrid:
    """``cells``: ``ix, iy, z, weight, fill_pass`` and perhaps colours, for valid cells; and where the grid lies."""

    cells: DataFrame
    width: int
    height: int
    min_x: float
    min_y: float
    step_x: float
    step_y: float

    def dense(self) -> DataFrame:
        """Every cell, with ``valid``; cells without a height have z and weight 0."""
        every = self.cells.sparkSession.range(self.width * self.height).select((F.col("id") % self.width).alias("ix"), F.floor(F.col("id") / self.width).cast("long").alias("iy"))
        joined = every.join(self.cells.withColumn("valid", F.lit(True)), ["ix", "iy"], "left")
        return joined.withColumns({"valid": F.coalesce("valid", F.lit(False)), "z": F.coalesce("z", F.lit(0.0)), "weight": F.coalesce("weight", F.lit(0.0)), "fill_pass": F.coalesce("fill_pass", F.lit(0))})


def height_grid(
    cloud: DataFrame, width: int, height: int, aggregate: str = "mean", bilinear: bool = True, padding: float = 0.0,
    explicit: tuple[float, float, float, float] | None = None, skip_non_finite: bool = False,
) -> HeightGrid:
    """Splat points onto a raster: ``explicit`` bounds are (min_x, max_x, min_y, max_y), else those of the points.

    Each point adds to the four cells around it by its bilinear weights, or to the nearest cell.
    Points outside are left out. A cell is valid if its weights sum to over 1e-9; its height is the
    weighted mean, the least or the greatest height. One partial and one final aggregation; the
    bounds, one row, become literals, and the cells are written to the shared folder, as every later
    step starts from them.
    """
    if width < 2 or height < 2:
        raise ValueError("a grid has at least 2 x 2 cells")
    if not (math.isfinite(padding) and padding >= 0):
        raise ValueError("padding is finite and not negative")
    if aggregate not in ("mean", "min", "max"):
        raise ValueError("aggregate is mean, min or max")
    x, y, z = vector()
    good = cloud.where(finite(x, y, z)) if skip_non_finite else checked(cloud, "a point to be put in a height grid is not finite", x, y, z)
    if explicit:
        x0, x1, y0, y1 = map(float, explicit)
        if not (all(map(math.isfinite, (x0, x1, y0, y1))) and x1 > x0 and y1 > y0):
            raise ValueError("explicit bounds are finite and not empty")
    else:
        box = bounds(cloud).first()
        x0, x1, y0, y1 = (box[c] if box["n"] else 0.0 for c in ("min_x", "max_x", "min_y", "max_y"))
        px, py = max(x1 - x0, 1e-6) * padding, max(y1 - y0, 1e-6) * padding
        x0, x1, y0, y1 = x0 - px, x1 + px, y0 - py, y1 + py
    step_x, step_y = max(x1 - x0, 1e-6) / (width - 1), max(y1 - y0, 1e-6) / (height - 1)
    gx, gy = (x - F.lit(x0)) / F.lit(step_x), (y - F.lit(y0)) / F.lit(step_y)
    colors = [c for c in COLOR if c in cloud.columns]
    placed = good.select(gx.alias("gx"), gy.alias("gy"), z.alias("z"), *colors).where(F.col("gx").between(0, width - 1) & F.col("gy").between(0, height - 1))
    if bilinear:
        clamp = lambda c, n: F.least(F.floor(c), F.lit(n - 2)).cast("long")
        placed = placed.withColumns({"ix": clamp(F.col("gx"), width), "iy": clamp(F.col("gy"), height)})
        tx, ty = (F.least(F.greatest(F.col(g) - F.col(i), F.lit(0.0)), F.lit(1.0)) for g, i in (("gx", "ix"), ("gy", "iy")))
        corners = [F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy"), ((tx if dx else 1 - tx) * (ty if dy else 1 - ty)).alias("w")) for dy in (0, 1) for dx in (0, 1)]
        placed = placed.select("z", *colors, F.explode(F.array(*corners)).alias("c")).select("z", *colors, "c.*").where("w > 0")
    else:
        placed = placed.select("z", *colors, F.round("gx").cast("long").alias("ix"), F.round("gy").cast("long").alias("iy"), F.lit(1.0).alias("w"))
    value = {"mean": F.sum(F.col("z") * F.col("w")) / F.sum("w"), "min": F.min("z"), "max": F.max("z")}[aggregate]
    means = [half_up(F.sum(F.col(c) * F.col("w")) / F.sum("w"), 255).cast("smallint").alias(c) for c in colors]
    cells = placed.groupBy("ix", "iy").agg(value.alias("z"), F.sum("w").alias("weight"), *means).where(F.col("weight") > 1e-9).withColumn("fill_pass", F.lit(0))
    return HeightGrid(cut(cells, "grid"), width, height, x0, y0, step_x, step_y)


def _fill_block(passes: range, least: int, radius: int, side: int, halo: int, width: int, height: int, colors: list[str]):
    """Passes over a block of cells and the ``halo`` cells around it; the block's own new cells are given back."""
    n, reach = side + 2 * halo, range(-radius, radius + 1)
    steps = [(dx, dy, 1 / math.hypot(dx, dy)) for dx in reach for dy in reach if dx or dy]
    inner = slice(radius, radius + n)
    names = ["z", *colors]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = (int(pdf[b].iloc[0]) * side - halo for b in ("bx", "by"))
        at = pdf["ix"].to_numpy() - x0 + radius, pdf["iy"].to_numpy() - y0 + radius
        shape = (n + 2 * radius,) * 2
        valid, made = np.zeros(shape, bool), np.zeros(shape, np.int32)
        valid[at] = True
        values, known = np.zeros((len(names), *shape)), np.zeros((len(names), *shape), bool)
        for k, c in enumerate(names):
            column = pdf[c].to_numpy(float, na_value=np.nan)
            known[(k, *at)] = ~np.isnan(column)
            values[(k, *at)] = np.nan_to_num(column)
        xs, ys = x0 + np.arange(n)[:, None], y0 + np.arange(n)[None]
        inside = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        for t in passes:
            number, weight = np.zeros((n, n), np.int64), np.zeros((n, n))
            sums, some = np.zeros((len(names), n, n)), np.zeros((len(names), n, n), bool)
            for dx, dy, w in steps:
                near = slice(radius + dx, radius + dx + n), slice(radius + dy, radius + dy + n)
                number += valid[near]
                weight += valid[near] * w
                sums += values[(slice(None), *near)] * w
                some |= known[(slice(None), *near)]
            new = inside & ~valid[inner, inner] & (number >= max(1, least))
            if not new.any():
                break
            spot = tuple(i + radius for i in np.nonzero(new))
            valid[spot], made[spot] = True, t
            known[(slice(None), *spot)] = some[:, new]
            mean = sums[:, new] / weight[new]
            if colors:
                mean[1:] = _half_up(mean[1:])
            values[(slice(None), *spot)] = mean
        own = slice(radius + halo, radius + halo + side)
        i, j = np.nonzero(made[own, own])
        spot = i + radius + halo, j + radius + halo
        out = {"ix": i + x0 + halo, "iy": j + y0 + halo, "fill_pass": made[spot]}
        return pd.DataFrame(out | {c: np.where(known[(k, *spot)], values[(k, *spot)], np.nan) for k, c in enumerate(names)})

    return run


def _half_up(a: np.ndarray) -> np.ndarray:
    """Colours rounded half away from zero, from 0 to 255."""
    whole = np.floor(a)
    return np.clip(whole + (a - whole >= 0.5), 0, 255)


def fill_holes(grid: HeightGrid, passes: int = 8, least: int = 1, radius: int = 1) -> HeightGrid:
    """Fill cells that have ``least`` valid cells around them with their inverse-distance mean, pass by pass.

    A pass sees only what was valid before it. Cells are dealt to blocks of ``BLOCK`` a side, each
    with as many cells around it as ``HALO // radius`` passes can reach; a block does that many
    passes inside its task before blocks exchange, so there is one shuffle and one written table for
    them, and a block is bounded, however large the grid. After the first exchange only blocks near
    cells of the last pass are looked at: nothing changed around the others. Stops when a pass fills
    nothing. A value that is null counts as missing, but its cell's weight stays.
    """
    if passes <= 0 or radius <= 0:
        return grid
    cells, colors = grid.cells, [c for c in COLOR if c in grid.cells.columns]
    together = max(1, HALO // radius)
    last = None

    def dealt(df: DataFrame, halo: int) -> DataFrame:
        """Rows with the blocks that they are in or around."""
        for i, b, n in (("ix", "bx", grid.width), ("iy", "by", grid.height)):
            near = F.sequence(F.floor((F.col(i) - halo) / BLOCK), F.floor((F.col(i) + halo) / BLOCK))
            df = df.withColumn(b, F.explode(near)).where(F.col(b).between(0, (n - 1) // BLOCK))
        return df

    for done in range(0, passes, together):
        now = range(done + 1, min(done + together, passes) + 1)
        halo = len(now) * radius
        blocks = dealt(cells.select("ix", "iy", F.col("z").cast("double").alias("z"), *colors), halo)
        if last is not None:
            blocks = blocks.join(dealt(last, halo).select("bx", "by").distinct(), ["bx", "by"], "left_semi")
        run = _fill_block(now, least, radius, BLOCK, halo, grid.width, grid.height, colors)
        schema = ", ".join(["ix long", "iy long", "fill_pass int", "z double", *[f"{c} double" for c in colors]])
        new = blocks.groupBy("bx", "by").applyInPandas(run, schema)
        new = cut(new.select("ix", "iy", "z", F.lit(0.0).alias("weight"), *[F.when(~F.isnan(c), F.col(c)).cast("smallint").alias(c) for c in colors], "fill_pass"))
        cells, last = cells.unionByName(new), new.where(F.col("fill_pass") == now[-1])
        if last.isEmpty():
            break
    return replace(grid, cells=cells)


def _coordinate(grid: HeightGrid) -> dict[str, Column]:
    return {"x": F.lit(grid.min_x) + F.col("ix") * F.lit(grid.step_x), "y": F.lit(grid.min_y) + F.col("iy") * F.lit(grid.step_y)}


def grid_to_points(grid: HeightGrid) -> DataFrame:
    """Valid cells as points, numbered row by row: ``pid, ix, iy, x, y, z`` and colours."""
    colors = [c for c in COLOR if c in grid.cells.columns]
    return dense_ids(grid.cells, ["iy", "ix"]).withColumns(_coordinate(grid)).select("pid", "ix", "iy", "x", "y", "z", *colors)


def height_jump(grid: HeightGrid, configured: float = 0.0) -> float:
    """Largest step in height that a face may have: as configured, else four times the upper median step."""
    if math.isfinite(configured) and configured > 0:
        return configured
    fallback = max(1e-6, 1.5 * math.hypot(grid.step_x, grid.step_y))
    pairs = F.explode(F.array(*[F.struct((F.col("ix") + a).alias("x"), (F.col("iy") + b).alias("y"), F.lit(k).alias("pair"), F.lit(first).alias("first")) for k, a, b, first in (("r", 0, 0, True), ("r", -1, 0, False), ("d", 0, 0, True), ("d", 0, -1, False))]))
    ends = grid.cells.select("z", pairs.alias("p")).groupBy("p.x", "p.y", "p.pair").agg(F.count(F.lit(1)).alias("n"), (F.max("z") - F.min("z")).alias("step"))
    steps = cut(ends.where("n = 2").select("step"), "steps")
    n = steps.count()
    if not n:
        return fallback
    middle, _ = kth_smallest(steps, n // 2 + 1, "step")
    return max(fallback, 4 * middle)


def grid_to_mesh(grid: HeightGrid, source: DataFrame | None = None, jump: float = 0.0, least_normal_z: float = 0.08, most_fill: int = 8) -> tuple[DataFrame, DataFrame]:
    """Vertices (see ``grid_to_points``) and faces ``fid, a, b, c`` of a grid.

    A quad needs four valid corners and is cut along the diagonal with the smaller step, the main
    one if equal. A triangle stays if no corner was filled after pass ``most_fill``, no two corners
    differ by over ``jump`` in height, and it is not steeper than ``least_normal_z`` allows. Colours
    come from the grid, else from the nearest point of ``source``, as do intensities. Corners meet
    in one aggregation by quad.
    """
    vertices = grid_to_points(grid)
    limit = height_jump(grid, jump)
    ids = vertices.select("pid", "ix", "iy").join(grid.cells.select("ix", "iy", "z", "fill_pass"), ["ix", "iy"])
    corner = F.explode(F.array(*[F.struct((F.col("ix") - dx).alias("qx"), (F.col("iy") - dy).alias("qy"), F.lit(f"v{dx}{dy}").alias("k")) for dx in (0, 1) for dy in (0, 1)]))
    at = F.struct("pid", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "z", "fill_pass")
    quads = ids.select(corner.alias("q"), at.alias("at")).groupBy("q.qx", "q.qy").agg(*[F.max(F.when(F.col("q.k") == k, F.col("at"))).alias(k) for k in ("v00", "v10", "v01", "v11")])
    quads = quads.where(" and ".join(f"{k} is not null" for k in ("v00", "v10", "v01", "v11")))
    c = {k: F.col(k) for k in ("v00", "v10", "v01", "v11")}
    triangle = lambda a, b, d, n: F.struct(c[a].alias("a"), c[b].alias("b"), c[d].alias("c"), F.lit(n).alias("n"))
    main = F.abs(F.col("v00.z") - F.col("v11.z")) <= F.abs(F.col("v10.z") - F.col("v01.z"))
    halves = F.when(main, F.array(triangle("v00", "v10", "v11", 0), triangle("v00", "v11", "v01", 1))).otherwise(F.array(triangle("v00", "v10", "v01", 0), triangle("v10", "v11", "v01", 1)))
    t = quads.select("qx", "qy", F.explode(halves).alias("t")).select("qx", "qy", "t.*")
    z = [F.col(f"{v}.z") for v in "abc"]
    u, v = ([(F.col(f"{p}.x") - F.col("a.x")) * F.lit(grid.step_x), (F.col(f"{p}.y") - F.col("a.y")) * F.lit(grid.step_y), F.col(f"{p}.z") - F.col("a.z")] for p in "bc")
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    flat = (F.abs(z[0] - z[1]) <= limit) & (F.abs(z[0] - z[2]) <= limit) & (F.abs(z[1] - z[2]) <= limit)
    reliable = flat & (F.greatest("a.fill_pass", "b.fill_pass", "c.fill_pass") <= max(0, most_fill)) & (length > 1e-19) & (F.abs(n[2]) >= F.lit(least_normal_z) * length)
    faces = dense_ids(t.where(reliable).select("qx", "qy", "n", F.col("a.pid").alias("a"), F.col("b.pid").alias("b"), F.col("c.pid").alias("c")), ["qy", "qx", "n"], "fid").select("fid", "a", "b", "c")
    if source is not None:
        wanted = [c for c in (*(() if COLOR[0] in vertices.columns else COLOR), "intensity") if c in source.columns]
        if wanted:
            near = nearest(source, vertices).select(F.col("qid").alias("__v"), F.col("pid").alias("__s"))
            values = source.select(F.col("pid").alias("__s"), *wanted)
            vertices = vertices.join(near, F.col("pid") == F.col("__v"), "left").join(values, "__s", "left").drop("__v", "__s")
    return vertices, faces


def cloud_to_mesh(cloud: DataFrame, width: int, height: int, fill_passes: int = 8, **options) -> tuple[DataFrame, DataFrame]:
    """Height grid, filled, as a mesh."""
    return grid_to_mesh(fill_holes(height_grid(cloud, width, height, **options), fill_passes), cloud)
