"""Point operators: rows, columns, identifiers, index-preserving filters, voxel grids, statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import COLOR, NORMAL, RESERVED, XYZ, cell, dot, finite, minus, vector
from ..plans.lineage import cut


def dense_ids(df: DataFrame, order: Sequence[str | Column], name: str = "pid") -> DataFrame:
    """Number rows 0..N-1 in the given order without bringing them into one task.

    Rows are range-partitioned, sorted and written once with their partition and their place in it.
    Both the sizes of the partitions, one small row each, and the rows come from what was written:
    a second evaluation of the exchange might draw other borders. Rows with equal keys stay in one
    partition, so the order should hold few of them.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    placed = cut(placed.withColumn("__in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    start = F.when(F.col("__before").isNull(), F.raise_error(F.lit("a partition has no first number")).cast("long")).otherwise(F.col("__before"))
    return placed.join(F.broadcast(starts), "__part", "left").withColumn(name, start + F.col("__in")).drop("__part", "__in", "__before")


def row(df: DataFrame, pid: int) -> DataFrame:
    """The point with an id; one row, or an error if there is none."""
    found = df.where(F.col("pid") == pid)
    if found.isEmpty():
        raise IndexError(f"no point has id {pid}")
    return found


def scalar_fields(df: DataFrame) -> list[str]:
    """Names of the user columns of a cloud."""
    return [c for c in df.columns if c not in RESERVED and c != "pid"]


def scalar(df: DataFrame, name: str) -> Column:
    if name not in scalar_fields(df):
        raise KeyError(f"the cloud has no scalar field {name!r}")
    return df[name]


def with_attributes(df: DataFrame, values: DataFrame) -> DataFrame:
    """Add or replace column groups from ``values(pid, ...)``, which must cover every point exactly once."""
    names = [c for c in values.columns if c != "pid"]
    for group in (NORMAL, COLOR):
        if set(group) & set(names) and not set(group) <= set(names):
            raise ValueError(f"{', '.join(group)} come together")
    bad = [c for c in names if not c or any(ch.isspace() for ch in c)]
    if bad or len(set(names)) != len(names):
        raise ValueError(f"scalar fields need unique names without white space: {names}")
    joined = df.drop(*names).join(values.withColumn("__has", F.lit(True)), "pid", "left")
    complete = F.when(F.col("__has").isNull(), F.raise_error(F.lit("a point has no attribute row")).cast("boolean")).otherwise(F.lit(True))
    return joined.where(complete).drop("__has")


def gather(df: DataFrame, picks: DataFrame) -> DataFrame:
    """Points by ``picks(position, pid)``: in that order, repeats allowed; an unknown id raises."""
    joined = picks.join(df.withColumn("__has", F.lit(True)), "pid", "left")
    known = F.when(F.col("__has").isNull(), F.raise_error(F.lit("a picked id is out of range")).cast("boolean")).otherwise(F.lit(True))
    return joined.where(known).drop("__has")


def kept_ids(df: DataFrame, mask: str = "keep") -> DataFrame:
    return df.where(F.col(mask)).select("pid")


def removed_ids(df: DataFrame, mask: str = "keep") -> DataFrame:
    return df.where(~F.col(mask)).select("pid")


def complement(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Ids of ``df`` that are not in ``kept``."""
    return df.select("pid").join(kept.select("pid"), "pid", "left_anti")


def merge_clouds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both clouds, the ids of the second following those of the first; missing attributes are null."""
    last = a.agg(F.coalesce(F.max("pid"), F.lit(-1)).alias("__last"))
    moved = b.join(F.broadcast(last)).withColumn("pid", F.col("pid") + F.col("__last") + 1).drop("__last")
    return a.unionByName(moved, allowMissingColumns=True)


def validate_faces(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with a corner that is no point: ``fid, corner, pid``, empty if the structure is valid."""
    corners = faces.select("fid", F.posexplode(F.array("a", "b", "c")).alias("corner", "pid"))
    return corners.join(points.select("pid"), "pid", "left_anti").select("fid", "corner", "pid")


def transform(df: DataFrame, matrix) -> DataFrame:
    """Apply a 4x4 transform to coordinates (and its rotation to normals); the 16 numbers become literals."""
    m = np.asarray(matrix, float)
    if m.shape != (4, 4) or not np.isfinite(m).all():
        raise ValueError("a transform is a finite 4x4 matrix")
    out = {}
    for names, shift in ((XYZ, 1.0), (NORMAL, 0.0)):
        if set(names) <= set(df.columns):
            v = vector(names)
            for i, n in enumerate(names):
                out[n] = sum((F.lit(float(m[i, j])) * v[j] for j in range(1, 3)), F.lit(float(m[i, 0])) * v[0]) + F.lit(float(m[i, 3]) * shift)
    return df.withColumns(out)


def uniform_downsample(df: DataFrame, step: int = 2) -> DataFrame:
    """Points whose dense id is a multiple of the step (at least 1); non-finite points count and stay."""
    return df.where(F.col("pid") % max(1, int(step)) == 0)


def sample_rows(df: DataFrame, total: int, most: int) -> DataFrame:
    """Every n-th row, so that at most ``most`` of ``total`` are kept."""
    return uniform_downsample(df, -(-total // max(1, most)))


def checked(df: DataFrame, message: str, *columns: Column) -> DataFrame:
    """The same rows; a row where a column is not finite raises while it is computed."""
    ok = F.when(finite(*columns), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(ok)


def half_up(value: Column, top: float) -> Column:
    """Rounded half away from zero and clamped to 0..top."""
    return F.least(F.greatest(F.round(value), F.lit(0.0)), F.lit(float(top)))


def mean_attributes(df: DataFrame, scalars: bool = True) -> list[Column]:
    """Aggregates for the attributes of merged points: means, colours and intensity rounded and clamped."""
    out = []
    for c in df.columns:
        if c in NORMAL:
            out.append(F.avg(F.col(c).cast("double")).alias(c))
        elif c in COLOR:
            out.append(half_up(F.avg(c), 255).cast("smallint").alias(c))
        elif c == "intensity":
            out.append(half_up(F.avg(c), 65535).cast("int").alias(c))
        elif scalars and c not in RESERVED and c != "pid":
            out.append(F.avg(F.col(c).cast("double")).alias(c))
    return out


def voxel_cells(df: DataFrame, leaf: tuple[float, float, float]) -> DataFrame:
    """One row per occupied voxel: ``kx, ky, kz``, the mean point, mean attributes and ``n``."""
    if not all(np.isfinite(v) and v > 0 for v in leaf):
        raise ValueError("leaf sizes are positive and finite")
    x, y, z = vector()
    keyed = checked(df, "a point to be put in a voxel is not finite", x, y, z).withColumns({k: cell(c, s) for k, c, s in zip(("kx", "ky", "kz"), (x, y, z), leaf, strict=True)})
    inside = F.lit(True)
    for k in ("kx", "ky", "kz"):
        inside = inside & F.col(k).between(-(2**31), 2**31 - 1)
    keyed = keyed.where(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.lit("a voxel key is out of range")).cast("boolean")))
    means = [F.avg(c).alias(n) for n, c in zip(XYZ, (x, y, z), strict=True)]
    return keyed.groupBy("kx", "ky", "kz").agg(*means, *mean_attributes(df), F.count(F.lit(1)).alias("n"))


def voxel_downsample(df: DataFrame, leaf: float | tuple[float, float, float]) -> DataFrame:
    """Voxel centroids as a cloud, with dense ids in key order."""
    sizes = leaf if isinstance(leaf, tuple) else (leaf,) * 3
    return dense_ids(voxel_cells(df.drop("pid"), sizes), ["kx", "ky", "kz"]).drop("kx", "ky", "kz", "n")


def bounds(df: DataFrame) -> DataFrame:
    """One row: least and greatest coordinate of the finite points, and their number."""
    x, y, z = vector()
    aggregates = [f(c).alias(f"{p}_{n}") for n, c in zip(XYZ, (x, y, z), strict=True) for p, f in (("min", F.min), ("max", F.max))]
    return df.where(finite(x, y, z)).agg(*aggregates, F.count(F.lit(1)).alias("n"))


def statistics(df: DataFrame, error: str | None = None, intensity: str | None = None) -> DataFrame:
    """One row of figures about a cloud: points, share of finite ones, means, box; of an error and an intensity column."""
    ok = finite(*vector())
    out = [F.count(F.lit(1)).alias("point_count"), F.avg(ok.cast("double")).alias("finite_ratio")]
    for n, c in zip(XYZ, vector(), strict=True):
        v = F.when(ok, c)
        out += [F.avg(v).alias(f"mean_{n}"), F.min(v).alias(f"min_{n}"), F.max(v).alias(f"max_{n}")]
    if error:
        out += [F.avg(F.col(error).cast("double")).alias("error_mean"), F.max(F.col(error).cast("double")).alias("error_max")]
    if intensity:
        v = F.col(intensity).cast("double")
        out += [F.avg(v).alias("intensity_mean"), F.min(v).alias("intensity_min"), F.max(v).alias("intensity_max")]
    return df.agg(*out)


def orient_to_viewpoint(df: DataFrame, viewpoint: tuple[float, float, float]) -> DataFrame:
    """Turn normals towards a viewpoint; a cloud without normals is returned as it is."""
    if not set(NORMAL) <= set(df.columns):
        return df
    n = vector(NORMAL)
    away = dot(minus([F.lit(float(v)) for v in viewpoint], vector()), n) < 0
    return df.withColumns({c: F.when(away, -v).otherwise(v) for c, v in zip(NORMAL, n, strict=True)})
