"""Proximity joins: pairs, nearest points and counts by an index in partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import XYZ, finite, vector
from .index import SpatialIndex
from .points import checked

#: Pairs up to which comparing everything with everything is cheaper than rounds of joins, and rows that are broadcast for it at most.
BRUTE_PAIRS, BRUTE_ROWS = 4_000_000, 20_000


def _side(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.select(F.col("pid").alias(key), *(c.alias(f"{prefix}{n}") for n, c in zip(XYZ, vector(), strict=True)))


def _points(df: DataFrame) -> DataFrame:
    return _side(df.where(finite(*vector())), "pid", "p")


def _queries(df: DataFrame) -> DataFrame:
    return _side(checked(df, "a query point is not finite", *vector()), "qid", "q")


def _square():
    x, y, z = (F.col(f"p{n}") - F.col(f"q{n}") for n in XYZ)
    return x * x + y * y + z * z


def radius_join(points: DataFrame, queries: DataFrame, radius: float, skip_self: bool = False) -> DataFrame:
    """All pairs ``qid, pid, d`` with distance at most ``radius``; equal points for radius 0.

    Both sides are dealt to partitions of about equal numbers, whatever their density, and written
    once; a task compares one partition of queries with some of points near it (see ``index``). Pairs
    are not shuffled, and come in an order that is small where they are written. Non-finite points
    are no partners; a non-finite query raises. Ids are whole numbers.
    """
    if not (math.isfinite(radius) and radius >= 0):
        raise ValueError("a radius is finite and not negative")
    if radius == 0:
        joined = _queries(queries).join(_points(points), [F.col(f"p{n}") == F.col(f"q{n}") for n in XYZ]).withColumn("d", F.lit(0.0))
    else:
        here = SpatialIndex.tiled(_side(checked(queries, "a query point is not finite", *vector()), "pid", "p"))
        there = here if points is queries else SpatialIndex.tiled(_points(points))
        joined = there.pairs(here, radius)
    if skip_self:
        joined = joined.where("qid <> pid")
    return joined.select("qid", "pid", "d")


def _indexed(points: DataFrame | SpatialIndex) -> SpatialIndex:
    return points if isinstance(points, SpatialIndex) else SpatialIndex(_points(points))


def index(points: DataFrame) -> SpatialIndex:
    """An index of the finite points of a cloud, for several searches: it is written once."""
    return SpatialIndex(_points(points))


def radius_count(points: DataFrame | SpatialIndex, queries: DataFrame, radius: float, early_stop: int | None = None, skip_self: bool = False) -> DataFrame:
    """``qid, n``: partners of every query within the radius, at most ``early_stop``; an empty search for radius <= 0.

    Boxes of points that lie within the radius as a whole add their number unseen, and a query ends
    once that reaches ``early_stop``, so crowded balls cost no more than others; no pair leaves
    a task. With ``skip_self`` the point of the query's id, should it be within the radius, is taken
    off after the count; ids of points are unique.
    """
    if not math.isfinite(radius):
        raise ValueError("a radius is finite")
    if radius <= 0:
        return queries.select(F.col("pid").alias("qid"), F.lit(0).cast("long").alias("n"))
    q, stop = _queries(queries), early_stop or None
    there = _indexed(points)
    found = there.within(q, radius, stop + int(skip_self) if stop else None)
    if skip_self:
        own = q.join(there.points, F.col("qid") == F.col("pid")).where(F.sqrt(_square()) <= radius).select("qid", F.lit(-1).cast("long").alias("n"))
        if stop:
            found = found.withColumn("n", F.least("n", F.lit(stop + 1)))
        found = found.unionByName(own).groupBy("qid").agg(F.sum("n").alias("n"))
    return found.select("qid", F.least("n", F.lit(stop).cast("long")).alias("n") if stop else "n")


def _top(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("d2", "pid")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(points: DataFrame | SpatialIndex, queries: DataFrame, k: int, skip_self: bool = False, strategy: str = "auto", most: float = math.inf) -> DataFrame:
    """The ``k`` nearest points of every query, none farther than ``most``: ``qid, pid, d, d2, rank``, nearest first, ties by id.

    ``tree``: points are dealt to partitions of about equal numbers, whatever their density, and
    searched there in blocks (see ``index``); a query sees its own partition, then those others
    that can hold something nearer, in three rounds at most. ``brute``: every query with
    every point, the smaller side being broadcast if it has at most ``BRUTE_ROWS`` rows; ``auto``
    takes it after counting both sides, where the pairs are few, too.

    Fewer than k points give fewer rows; k <= 0 none. Non-finite points are no neighbours; a
    non-finite query raises. Ids are whole numbers.
    """
    p, q = points.points.select("pid", "px", "py", "pz") if isinstance(points, SpatialIndex) else _points(points), _queries(queries)
    columns = ["qid", "pid", F.sqrt("d2").alias("d"), "d2", "rank"]
    if k <= 0:
        return q.join(p, F.lit(False)).select("qid", "pid", F.lit(0.0).alias("d"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank"))
    near = F.sqrt("d2") <= F.lit(float(most)) if math.isfinite(most) else F.lit(True)
    if strategy != "tree":
        n, m = points.n if isinstance(points, SpatialIndex) else p.count(), q.count()
        if min(n, m) <= BRUTE_ROWS and (strategy == "brute" or n * m <= BRUTE_PAIRS):
            other = F.col("qid") != F.col("pid") if skip_self else F.lit(True)
            pairs = q.join(F.broadcast(p), other) if n <= m else F.broadcast(q).join(p, other)
            return _top(pairs.withColumn("d2", _square()).where(near).select("qid", "pid", "d2"), k).select(*columns)
    found = _indexed(points).nearest(q, k, skip_self, most)
    rows = found.select("qid", F.posexplode("best").alias("at", "b")).select("qid", "b.pid", "b.d2", (F.col("at") + 1).alias("rank"))
    return rows.where(near).select(*columns)


def nearest(points: DataFrame | SpatialIndex, queries: DataFrame, skip_self: bool = False) -> DataFrame:
    """The nearest point of every query, lowest id first among equals: ``qid, pid, d``; -1 and null if there is none."""
    found = knn_join(points, queries, 1, skip_self).select("qid", "pid", "d")
    return queries.select(F.col("pid").alias("qid")).join(found, "qid", "left").select("qid", F.coalesce("pid", F.lit(-1).cast("long")).alias("pid"), "d")


def knn_padded(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows a query: ``qid, rank, pid, d2``; missing neighbours have id -1 and the largest double."""
    slots = queries.select(F.col("pid").alias("qid"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    found = knn_join(points, queries, k).select("qid", "rank", "pid", "d2")
    return slots.join(found, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("pid", F.lit(-1).cast("long")).alias("pid"), F.coalesce("d2", F.lit(1.7976931348623157e308)).alias("d2"))
