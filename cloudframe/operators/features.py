"""Neighbourhood features: covariances, normals, smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import NORMAL, XYZ, norm, vector
from .spatial import knn_join

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _neighbours(cloud: DataFrame, k: int, neighbours: DataFrame | None) -> DataFrame:
    return (knn_join(cloud, cloud, k) if neighbours is None else neighbours).select("qid", "pid")


def knn_covariance(cloud: DataFrame, k: int = 10, neighbours: DataFrame | None = None) -> DataFrame:
    """Population covariance of the k nearest points (itself included): ``pid, n, xx, xy, xz, yy, yz, zz``."""
    points = cloud.select("pid", *[c.alias(n) for n, c in zip(XYZ, vector(), strict=True)])
    joined = _neighbours(cloud, k, neighbours).join(points, "pid")
    out = joined.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(p[0], p[1]).alias(p) for p in PAIRS])
    return out.withColumnRenamed("qid", "pid")


def estimate_normals(cloud: DataFrame, k: int = 10, neighbours: DataFrame | None = None) -> DataFrame:
    """Cloud with unit normals: the direction of least spread of the k nearest points.

    The largest component is made positive, since the sign is arbitrary. Fewer than three points
    give (0, 0, 0). The eigenvectors of 3x3 matrices are found in Arrow batches; the rest are joins
    and aggregates.
    """
    if k < 3:
        raise ValueError("normals need k >= 3")
    covariance = knn_covariance(cloud, k, neighbours)

    @F.pandas_udf("nx double, ny double, nz double")
    def least(n: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3).astype(float)
        v = np.linalg.eigh(m)[1][:, :, 0]
        big = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
        v = v * np.where(big < 0, -1.0, 1.0) * (n.to_numpy() >= 3)[:, None]
        return pd.DataFrame(v, columns=list(NORMAL))

    normals = covariance.select("pid", least("n", *PAIRS).alias("v")).select("pid", "v.*")
    return cloud.drop(*NORMAL).join(normals, "pid", "left").fillna(0.0, list(NORMAL))


def smooth_normals(cloud: DataFrame, k: int, neighbours: DataFrame | None = None) -> DataFrame:
    """Cloud with each normal replaced by the unit sum of the k nearest points' normals; unchanged where that vanishes."""
    if k <= 0:
        raise ValueError("k is positive")
    normals = cloud.select("pid", *[c.alias(f"__{n}") for n, c in zip(NORMAL, vector(NORMAL), strict=True)])
    sums = _neighbours(cloud, k, neighbours).join(normals, "pid").groupBy("qid").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in NORMAL])
    joined = cloud.join(sums, F.col("pid") == F.col("qid"), "left").drop("qid")
    s = tuple(F.coalesce(f"__{n}", F.lit(0.0)) for n in NORMAL)
    length = norm(s)
    out = {n: F.when(length > 1e-10, c / length).otherwise(F.col(n).cast("double")) for n, c in zip(NORMAL, s, strict=True)}
    return joined.withColumns(out).drop(*[f"__{n}" for n in NORMAL])
