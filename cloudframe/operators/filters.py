"""Outlier filters, the filter interface, and one-call forms of the preprocessing operators."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import finite, vector
from ..plans.lineage import cut
from .points import complement, uniform_downsample, voxel_downsample
from .spatial import knn_join, radius_count


class Filter(ABC):
    """Keeps some points. Subclasses give the ids to keep."""

    @abstractmethod
    def keep(self, cloud: DataFrame) -> DataFrame:
        """Ids ``pid`` of the points that stay."""

    def apply(self, cloud: DataFrame) -> DataFrame:
        return cloud.join(self.keep(cloud), "pid", "left_semi")

    def removed(self, cloud: DataFrame) -> DataFrame:
        """Ids of the points that go."""
        return complement(cloud, self.keep(cloud))

    def both(self, cloud: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.apply(cloud), self.removed(cloud)


class StatisticalOutlierRemoval(Filter):
    """Drops points whose mean neighbour distance exceeds mean + ``factor`` standard deviations.

    Of the ``k + 1`` nearest points of each finite point, itself is left out (if duplicates push it
    out, k + 1 others count). Non-finite points go, and count in no statistic.
    """

    def __init__(self, k: int = 8, factor: float = 1.0, neighbours: DataFrame | None = None):
        if k <= 0:
            raise ValueError("k is positive")
        self.k, self.factor, self.neighbours = k, factor, neighbours

    def mean_distances(self, cloud: DataFrame) -> DataFrame:
        good = cloud.where(finite(*vector()))
        near = self.neighbours if self.neighbours is not None else knn_join(good, good, self.k + 1)
        means = near.where("qid <> pid").groupBy("qid").agg(F.avg("d").alias("d"))
        return good.select("pid").join(means, F.col("pid") == F.col("qid"), "left").select("pid", F.coalesce("d", F.lit(0.0)).alias("d"))

    def keep(self, cloud: DataFrame) -> DataFrame:
        means = cut(self.mean_distances(cloud), "means")  # read for the limit and against it
        limit = means.agg((F.avg("d") + F.lit(float(self.factor)) * F.stddev_pop("d")).alias("limit"))
        return means.join(F.broadcast(limit), F.col("d") <= F.col("limit")).select("pid")


class RadiusOutlierRemoval(Filter):
    """Keeps finite points with at least ``least`` points (themselves included) within ``radius``."""

    def __init__(self, radius: float = 0.1, least: int = 2):
        if radius < 0 or least <= 0:
            raise ValueError("the radius is not negative and the number of neighbours positive")
        self.radius, self.least = radius, least

    def keep(self, cloud: DataFrame) -> DataFrame:
        good = cloud.where(finite(*vector()))
        if self.radius == 0:
            from .spatial import radius_join

            counts = radius_join(good, good, 0.0).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        else:
            counts = radius_count(good, good, self.radius, self.least)
        return counts.where(F.col("n") >= self.least).select(F.col("qid").alias("pid"))


class UniformDownsample(Filter):
    def __init__(self, step: int = 2):
        self.step = step

    def keep(self, cloud: DataFrame) -> DataFrame:
        return uniform_downsample(cloud, self.step).select("pid")


def statistical_outlier_removal(cloud: DataFrame, k: int = 8, factor: float = 1.0) -> DataFrame:
    return StatisticalOutlierRemoval(k, factor).apply(cloud)


def radius_outlier_removal(cloud: DataFrame, radius: float = 0.1, least: int = 2) -> DataFrame:
    return RadiusOutlierRemoval(radius, least).apply(cloud)


__all__ = ["Filter", "RadiusOutlierRemoval", "StatisticalOutlierRemoval", "UniformDownsample", "radius_outlier_removal", "statistical_outlier_removal", "uniform_downsample", "voxel_downsample"]
