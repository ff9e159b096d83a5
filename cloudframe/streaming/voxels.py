"""Voxel aggregates over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import XYZ, cell, finite, vector


def stream_voxels(points: DataFrame, leaf: float, time: str | None = None, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Centroids and counts by voxel, for update mode; with ``time`` by voxel and time window behind a watermark.

    Non-finite points are left out. State is one row per voxel (and open window).
    """
    x, y, z = vector()
    good = points.where(finite(x, y, z))
    keys = [cell(c, leaf).alias(f"k{n}") for n, c in zip(XYZ, (x, y, z), strict=True)]
    if time:
        good = good.withWatermark(time, delay)
        keys = [F.window(time, window).alias("window"), *keys]
    return good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(n) for n, c in zip(XYZ, (x, y, z), strict=True)])
