"""Rigid registration: correspondences and moments as joins and aggregates, a driver loop over one row a step."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import XYZ, finite, vector
from ..plans.lineage import cut
from .index import SpatialIndex
from .points import transform
from .selection import smallest
from .spatial import BRUTE_PAIRS, knn_join
from .spatial import index as build_index


def correspondences(
    source: DataFrame, target: DataFrame, most: float = math.inf, reciprocal: bool = False, one_to_one: bool = False, overlap: float = 1.0, index: SpatialIndex | None = None,
) -> DataFrame:
    """Nearest target point of every source point, ``src, tgt, d``, and what the rejectors leave.

    ``most``: largest distance; it bounds the search, and the pairs that are compared do not grow with it.
    ``reciprocal``: the source point has to be the nearest of its target, too. ``one_to_one``: a
    target keeps its nearest source, lowest id first. ``overlap``: the nearest ceil(overlap *
    sources) stay, at least three; their last is found by counts, no row is sorted.
    ``index``: of the target, if it is searched more than once.
    """
    if not most > 0 or not 0 < overlap <= 1:
        raise ValueError("the distance is positive and the overlap in (0, 1]")
    pairs = knn_join(index or target, source, 1, most=most).select(F.col("qid").alias("src"), F.col("pid").alias("tgt"), "d")
    if reciprocal or overlap < 1:
        pairs = cut(pairs, "pairs")
    if reciprocal:  # only targets that some source chose need to choose
        asked = target.join(pairs.select(F.col("tgt").alias("pid")), "pid", "left_semi")
        back = knn_join(source, asked, 1, most=most).select(F.col("pid").alias("src"), F.col("qid").alias("tgt"))
        pairs = pairs.join(back, ["src", "tgt"], "left_semi")
    if one_to_one:
        pairs = pairs.groupBy("tgt").agg(F.min(F.struct("d", "src")).alias("m")).select("m.src", "tgt", "m.d")
    if overlap < 1:
        if reciprocal or one_to_one:
            pairs = cut(pairs, "pairs")
        pairs = smallest(pairs, max(3, math.ceil(source.count() * overlap - 1e-6)), "d", "src")
    return pairs


def ordered_correspondences(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of equal ids."""
    s, t = source.alias("s"), target.alias("t")
    d = sum(((F.col(f"s.{c}") - F.col(f"t.{c}")) ** 2 for c in "yz"), (F.col("s.x") - F.col("t.x")) ** 2)
    return s.join(t, F.col("s.pid") == F.col("t.pid")).select(F.col("s.pid").alias("src"), F.col("t.pid").alias("tgt"), F.sqrt(d).alias("d"))


def moments(source: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: pairs ``n``, means ``mp*, mq*``, cross-covariances ``h<pq>``, covariances ``p<ab>, q<ab>`` and ``sum_d2``."""
    p = source.select(F.col("pid").alias("src"), *[c.alias(f"p{n}") for n, c in zip(XYZ, vector(), strict=True)])
    q = target.select(F.col("pid").alias("tgt"), *[c.alias(f"q{n}") for n, c in zip(XYZ, vector(), strict=True)])
    joined = pairs.join(p, "src").join(q, "tgt")
    out = [F.count(F.lit(1)).alias("n"), F.sum(F.col("d") * F.col("d")).alias("sum_d2")]
    out += [F.avg(f"{s}{c}").alias(f"m{s}{c}") for s in "pq" for c in XYZ]
    out += [F.covar_pop(f"p{a}", f"q{b}").alias(f"h{a}{b}") for a in XYZ for b in XYZ]
    out += [F.covar_pop(f"{s}{a}", f"{s}{b}").alias(f"{s}{a}{b}") for s in "pq" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return joined.agg(*out)


def metrics(source: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: ``fitness``, the share of source points that have a pair, and ``rmse``, the root of the mean squared distance (infinite without pairs)."""
    size = source.agg(F.count(F.lit(1)).alias("size"))
    found = pairs.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    return found.join(F.broadcast(size)).select((F.col("n") / F.nullif("size", F.lit(0))).alias("fitness"), F.coalesce("rmse", F.lit(float("inf"))).alias("rmse"))


def flat(row, side: str) -> bool:
    """Whether the paired points of one side lie on a line, by the principal minors of their covariance."""
    xx, xy, xz, yy, yz, zz = (row[f"{side}{p}"] for p in ("xx", "xy", "xz", "yy", "yz", "zz"))
    trace = xx + yy + zz
    return xx * yy - xy * xy + xx * zz - xz * xz + yy * zz - yz * yz <= max(1e-12 * trace * trace, 1e-30 * trace)


def rigid_step(row) -> np.ndarray:
    """The proper rotation and shift that bring the source means and spreads nearest to the target's."""
    h = np.array([[row[f"h{a}{b}"] for b in XYZ] for a in XYZ])
    u, _, vt = np.linalg.svd(h)
    v = vt.T
    if np.linalg.det(v @ u.T) < 0:
        v[:, 2] = -v[:, 2]
    r = v @ u.T
    out = np.eye(4)
    out[:3, :3] = r
    out[:3, 3] = np.array([row[f"mq{c}"] for c in XYZ]) - r @ np.array([row[f"mp{c}"] for c in XYZ])
    return out


@dataclass
class Registration:
    transformation: np.ndarray
    converged: bool
    fitness: float
    rmse: float
    iterations: int
    aligned: DataFrame


def icp(
    source: DataFrame, target: DataFrame, guess=None, iterations: int = 50, epsilon: float = 1e-6, rotation_epsilon: float = 0.0, fitness_epsilon: float = 0.0,
    most: float = math.inf, least_fitness: float = 0.0, reciprocal: bool = False, one_to_one: bool = False, overlap: float = 1.0, final_metrics: bool = True, ordered: bool = False,
) -> Registration:
    """Iterative closest point. Each step is one aggregation over a join; the driver sees one row.

    A large target is indexed once, for all steps.

    The transform is applied to the original source as literals, so plans do not grow. Stops before
    a step if the error is at most ``epsilon``, after a step if it moved less than ``epsilon`` in
    sum, turned less than ``rotation_epsilon``, or changed the error by at most
    ``fitness_epsilon``. Fewer than three pairs, or pairs on a line, raise. The result keeps
    coordinates only.
    """
    if epsilon <= 0 or iterations <= 0 or not 0 <= least_fitness <= 1:
        raise ValueError("epsilon and iterations are positive and the fitness in [0, 1]")
    total = np.eye(4) if guess is None else np.asarray(guess, float)
    if total.shape != (4, 4) or not np.isfinite(total).all():
        raise ValueError("a guess is a finite 4x4 matrix")
    base = cut(source.select("pid", *[c.alias(n) for n, c in zip(XYZ, vector(), strict=True)]))
    goal = cut(target.select("pid", *[c.alias(n) for n, c in zip(XYZ, vector(), strict=True)]))
    size = base.count()
    if not size or goal.isEmpty():
        raise ValueError("source and target hold points")
    if base.where(~finite(*vector())).limit(1).count():
        raise ValueError("source points are finite")

    there = build_index(goal) if not ordered and size * goal.count() > BRUTE_PAIRS else None

    def measure(matrix):
        moved = transform(base, matrix)
        pairs = ordered_correspondences(moved, goal) if ordered else correspondences(moved, goal, most, reciprocal, one_to_one, overlap, there)
        found = moments(moved, goal, pairs).first()
        n = found["n"]
        return found, n, n / size, math.sqrt(found["sum_d2"] / n) if n else math.inf

    converged, fitness, rmse, before, step = False, 0.0, math.inf, math.inf, 0
    state = measure(total)
    for step in range(1, iterations + 1):  # noqa: B007
        found, n, fitness, rmse = state
        if n < 3 or flat(found, "p") or flat(found, "q"):
            raise RuntimeError("registration needs three pairs that are not on a line")
        if rmse <= epsilon:
            converged = fitness >= least_fitness
            break
        move = rigid_step(found)
        total = move @ total
        active = n
        if final_metrics or step < iterations:
            state = measure(total)
        if final_metrics:
            _, active, fitness, rmse = state
        delta = np.abs(move[:3, :3] - np.eye(3)).sum() + np.abs(move[:3, 3]).sum()
        angle = math.acos(min(1.0, max(-1.0, (np.trace(move[:3, :3]) - 1) / 2)))
        still = delta < epsilon or (rotation_epsilon > 0 and angle <= rotation_epsilon)
        level = fitness_epsilon > 0 and math.isfinite(rmse) and math.isfinite(before) and abs(rmse - before) <= fitness_epsilon
        before = rmse
        if still or level:
            converged = active >= 3 and fitness >= least_fitness
            break
    return Registration(total, converged, fitness, rmse, step, transform(base, total))


__all__ = ["Registration", "correspondences", "flat", "icp", "knn_join", "metrics", "moments", "ordered_correspondences", "rigid_step"]
