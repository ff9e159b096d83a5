"""A partitioned index of points: equi-depth boxes from a sample, small boxes inside each task.

Partitions are cut at medians of a bounded sample, so a crowd gets as many of them as its points
need, at any scale. Tasks cut their points further into leaves and compare blocks of queries with
leaves by boxes first. Only partitions whose box can matter to a query see it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import XYZ
from ..plans.lineage import cut

#: Points of a partition, about, and partitions at most (beyond, they grow); points sampled for each.
PART_POINTS, MOST_PARTS, SAMPLE = 20_000, 32_768, 32
#: Points of a leaf and queries of a block; points that a block is compared with before it is halved.
LEAF, BLOCK, WIDE = 32, 64, 4_000
#: Queries that one task takes for one partition; its points go to further tasks for the others.
QUERIES = 100_000
#: Partitions that a query asks in its second round; the third asks all that are left.
NEXT = 4
#: Where pairs are returned: points of a partition, about; comparisons and points of a task; pairs put in order together; rows of a batch.
TILE, COMPARED, MET, SORTED, ROWS = 4_096, 1 << 26, 1 << 16, 1 << 22, 1 << 16


def _median_tree(sample: np.ndarray, parts: int) -> list[tuple]:
    """Nodes ``(axis, value, left, right)`` that cut a sample into ``parts``.

    With ``axis`` -1 a node is the partition ``left``, or, where one place alone has the points of
    several, the ``right`` partitions from ``left`` on.
    """
    nodes, used = [], 0

    def grow(rows: np.ndarray, n: int) -> int:
        nonlocal used
        at = len(nodes)
        nodes.append(None)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(3)
        axis = int(np.argmax(spread))
        if n == 1 or not spread[axis] > 0:
            nodes[at] = (-1, 0.0, used, n)
            used += n
            return at
        values = np.sort(rows[:, axis])
        value = values[len(values) * (n // 2) // n]
        if value == values[0]:
            value = values[np.searchsorted(values, value, side="right")]
        below = rows[:, axis] < value
        share = min(n - 1, max(1, round(n * below.mean())))
        left = grow(rows[below], share)
        nodes[at] = (axis, float(value), left, grow(rows[~below], n - share))
        return at

    grow(sample, parts)
    return nodes


def _leaves(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` in an order in which runs of at most ``most`` lie together: order and the starts of runs (and the end)."""
    order, starts, stack = np.arange(len(a)), [], [(0, len(a))]
    while stack:
        low, high = stack.pop()
        if high - low <= most:
            starts.append(low)
            continue
        rows = order[low:high]
        near = a[rows]
        axis = np.argmax(near.max(axis=0) - near.min(axis=0))
        middle = (high - low) // 2
        order[low:high] = rows[np.argpartition(near[:, axis], middle)]
        stack += [(low + middle, high), (low, low + middle)]
    return order, np.array([*starts, len(a)])


def _boxes(a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(a) == 0:
        return np.zeros((0, 3)), np.zeros((0, 3))
    return np.minimum.reduceat(a, starts[:-1]), np.maximum.reduceat(a, starts[:-1])


def _square(d: np.ndarray) -> np.ndarray:
    """Squares over the last axis, added in the order of the SQL, so that bounds and distances round alike."""
    d *= d
    return d[..., 0] + d[..., 1] + d[..., 2]


def _pairs(axes: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """Squared distances of points, an array an axis, and queries: a row a query."""
    out = None
    for axis, place in zip(axes, q.T, strict=True):
        d = axis[None] - place[:, None]
        d *= d
        out = d if out is None else np.add(out, d, out=out)
    return out


def _least(low, high, lows, highs) -> np.ndarray:
    """Least squared distances of a box to boxes."""
    return _square(np.maximum(np.maximum(lows - high, low - highs), 0.0))


def _most(low, high, lows, highs) -> np.ndarray:
    """Greatest squared distances of a box to boxes."""
    return _square(np.maximum(highs - low, high - lows))


def _squared(radius: float) -> float:
    """The largest double whose root is at most ``radius``: compared with it, squares decide as their roots would."""
    out = radius * radius
    while np.sqrt(out) > radius:
        out = np.nextafter(out, 0.0)
    while np.isfinite(out) and np.sqrt(after := np.nextafter(out, np.inf)) <= radius:
        out = after
    return float(out)


def _ranges(starts: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The places of the rows of the picked leaves."""
    sizes = starts[picked + 1] - starts[picked]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[picked] - ends + sizes, sizes)


class _Cloud:
    """The points of one partition in leaves."""

    def __init__(self, pid: np.ndarray, xyz: np.ndarray, copies: int = 0):
        if copies and len(pid):  # of points at one place only the first few by id can be among the nearest
            by = np.lexsort((pid, xyz[:, 2], xyz[:, 1], xyz[:, 0]))
            new = np.concatenate([[True], (xyz[by][1:] != xyz[by][:-1]).any(axis=1)])
            place = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            pid, xyz = pid[by][place < copies], xyz[by][place < copies]
        order, self.starts = _leaves(xyz, LEAF)
        self.pid, self.xyz = pid[order], xyz[order]
        self.axes = np.ascontiguousarray(self.xyz.T)
        self.low, self.high = _boxes(self.xyz, self.starts)

    def _blocks(self, q: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of ``q`` in blocks that lie together."""
        order, starts = _leaves(q, BLOCK)
        for k in range(len(starts) - 1 if len(q) else 0):
            yield order[starts[k] : starts[k + 1]]

    def _kth(self, qid, q, k: int, skip_self: bool, leaves: np.ndarray) -> np.ndarray:
        """Squared distance of the k-th point of each query in some leaves, infinite if they hold fewer."""
        places = _ranges(self.starts, leaves)
        if len(places) <= k + int(skip_self):
            return np.full(len(q), np.inf)
        d2 = _pairs(self.axes[:, places], q)
        if skip_self:
            d2[self.pid[places][None] == qid[:, None]] = np.inf
        return np.partition(d2, k - 1, axis=1)[:, k - 1]

    def nearest(self, qid: np.ndarray, q: np.ndarray, k: int, skip_self: bool, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, pid, d2`` of the k nearest points of every query within its squared ``limit``, by row, distance and id."""
        if not len(self.pid) or not len(q):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        out = [[], [], []]
        blocks = list(self._blocks(q))
        while blocks:
            rows = blocks.pop()
            low, high = q[rows].min(axis=0), q[rows].max(axis=0)
            far = _least(low, high, self.low, self.high)
            bound, enough = limit[rows], k + int(skip_self)
            some = 2 + enough // (LEAF // 2)
            if len(far) > 2 * some:  # the nearest few leaves hold enough points to bound the others
                whole = _most(low, high, self.low, self.high)
                bound = np.minimum(bound, self._kth(qid[rows], q[rows], k, skip_self, np.argpartition(whole, some)[: some + 1]))
            bound = bound.max()
            leaves = np.flatnonzero(far <= bound)
            if len(leaves) * LEAF > WIDE and len(rows) > 1:
                order = _leaves(q[rows], len(rows) // 2 + 1)[0]
                blocks += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
                continue
            places = _ranges(self.starts, leaves)
            if not len(places):
                continue
            d2 = _pairs(self.axes[:, places], q[rows])
            if skip_self:
                d2[self.pid[places][None] == qid[rows][:, None]] = np.inf
            if len(places) > k:
                kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
            else:
                kth = np.full(len(rows), np.inf)
            r, c = np.nonzero(d2 <= np.minimum(np.minimum(kth, limit[rows]), np.finfo(float).max)[:, None])
            d, p = d2[r, c], self.pid[places][c]
            by = np.lexsort((p, d, r))
            r, d, p = r[by], d[by], p[by]
            first = np.searchsorted(r, np.arange(len(rows)))
            top = np.arange(len(r)) - first[r] < k
            for part, values in zip(out, (rows[r[top]], p[top], d[top]), strict=True):
                part.append(values)
        row, pid, d2 = (np.concatenate(part) if part else np.zeros(0, t) for part, t in zip(out, (np.int64, np.int64, float), strict=True))
        by = np.argsort(row, kind="stable")
        return row[by], pid[by], d2[by]

    def within(self, q: np.ndarray, radius: float, stop: int | None) -> np.ndarray:
        """Points within the radius of each query; where ``stop`` is reached, at least that many."""
        out, most = np.zeros(len(q), np.int64), _squared(radius)
        blocks = list(self._blocks(q)) if len(self.pid) else []
        while blocks:
            rows = blocks.pop()
            low, high = q[rows].min(axis=0), q[rows].max(axis=0)
            inside = _most(low, high, self.low, self.high) <= most
            sure = int((self.starts[1:] - self.starts[:-1])[inside].sum())
            leaves = np.flatnonzero(~inside & (_least(low, high, self.low, self.high) <= most))
            if stop is not None and sure >= stop:
                out[rows] = sure
            elif len(leaves) * LEAF > WIDE and len(rows) > 1:
                order = _leaves(q[rows], len(rows) // 2 + 1)[0]
                blocks += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
            else:
                near = _pairs(self.axes[:, _ranges(self.starts, leaves)], q[rows])
                out[rows] = sure + np.count_nonzero(near <= most, axis=1)
        return out


    def pairs(self, q: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of ``q``, places of points and squared distances of the pairs within the radius, a block at a time."""
        most = _squared(radius)
        for rows in self._blocks(q) if len(self.pid) else ():
            leaves = np.flatnonzero(_least(q[rows].min(axis=0), q[rows].max(axis=0), self.low, self.high) <= most)
            for some in np.array_split(leaves, -(-len(leaves) * LEAF // WIDE) or 1):
                places = _ranges(self.starts, some)
                d2 = _pairs(self.axes[:, places], q[rows])
                r, c = np.nonzero(d2 <= most)
                yield rows[r].astype(np.int32), places[c].astype(np.int32), d2[r, c]


def _xyz(table: pa.Table | pa.RecordBatch, names) -> np.ndarray:
    return np.stack([table.column(n).to_numpy() if isinstance(table, pa.Table) else table.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1).astype(float)


@dataclass(frozen=True)
class Parts:
    """What tasks know of all partitions: where they are cut, and box and size of each."""

    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray

    def of(self, a: np.ndarray, ids: np.ndarray | None = None) -> np.ndarray:
        """The partition of each row, by walking the cuts for all rows at once; with ``ids`` points at a crowded place are dealt."""
        at = np.zeros(len(a), np.int64)
        while (inner := self.nodes["axis"][at] >= 0).any():
            node = self.nodes[at[inner]]
            right = a[inner, node["axis"]] >= node["value"]
            at[inner] = np.where(right, node["right"], node["left"])
        part = self.nodes["left"][at]
        if ids is None:
            return part
        dealt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return part + (dealt % self.nodes["right"][at].astype(np.uint64)).astype(np.int64)

    def reach(self, q: np.ndarray, want: int) -> np.ndarray:
        """A squared distance within which ``want`` points of each query lie for sure, infinite if there are fewer."""
        out = np.full(len(q), np.inf)
        if self.n.sum() >= want:
            for k, row in enumerate(q):
                whole = _most(row, row, self.low, self.high)
                by = np.argsort(whole)
                out[k] = whole[by[np.searchsorted(np.cumsum(self.n[by]), want)]]
        return out


class SpatialIndex:
    """Points ``pid, px, py, pz`` dealt to equi-depth partitions and written once; searched any number of times.

    ``points`` hold finite coordinates. Their number, a sample of ``SAMPLE`` rows for each
    partition, and a box for each partition come to the driver: at most ``MOST_PARTS`` of these.
    """

    def __init__(self, points: DataFrame, parts: int | None = None, most: int = PART_POINTS, each: int = 8):
        self.spark = points.sparkSession
        base = cut(points.select("pid", "px", "py", "pz"), "points")
        n = base.count()
        slots = self.spark.sparkContext.defaultParallelism
        parts = parts or min(MOST_PARTS, max(-(-n // most), min(each * slots, n // 256), 1))
        wanted = SAMPLE * parts
        sample = base.select("px", "py", "pz")
        if n > wanted:
            sample = sample.sample(min(1.0, 1.2 * wanted / n), seed=7).limit(2 * wanted)
        kind = [("axis", np.int8), ("value", float), ("left", np.int64), ("right", np.int64)]
        nodes = np.array(_median_tree(sample.toPandas().to_numpy(float).reshape(-1, 3), parts), dtype=kind)
        cuts = Parts(nodes, np.zeros((0, 3)), np.zeros((0, 3)), np.zeros(0))
        self.points = cut(self._placed(base, cuts, ("px", "py", "pz"), "pid long, px double, py double, pz double", "pid"), "placed")
        box = [f(c).alias(f"{m}{c}") for m, f in (("l", F.min), ("h", F.max)) for c in ("px", "py", "pz")]
        rows = self.points.groupBy("part").agg(*box, F.count(F.lit(1)).alias("n")).collect()
        low, high, size = np.full((parts, 3), np.inf), np.full((parts, 3), -np.inf), np.zeros(parts, np.int64)
        for r in rows:
            low[r.part], high[r.part], size[r.part] = r[1:4], r[4:7], r.n
        self.parts = Parts(nodes, low, high, size)
        self.n = int(size.sum())

    @cached_property
    def _known(self):
        return self.spark.sparkContext.broadcast(self.parts)

    @staticmethod
    def _placed(df: DataFrame, parts: Parts, names, schema: str, ids: str | None = None) -> DataFrame:
        def run(batches):
            for batch in batches:
                at = parts.of(_xyz(batch, names), batch.column(ids).fill_null(0).to_numpy() if ids else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "part"])

        return df.mapInArrow(run, f"{schema}, part int")

    def _met(self, asked: DataFrame, search, schema: str) -> DataFrame:
        """``search`` of each partition's points and the queries ``asked(..., part)`` for it, in as many tasks as the queries need."""
        counts = asked.groupBy("part").count().collect()  # a row a partition
        pieces = [(r["part"], -(-r["count"] // QUERIES)) for r in counts]
        tasks = max(1, sum(n for _, n in pieces))
        shares = F.broadcast(self.spark.createDataFrame(pieces, "part int, pieces long"))
        points = self.points.join(shares, "part").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
        queries = asked.join(shares, "part").withColumn("piece", F.pmod(F.xxhash64("qid"), F.col("pieces"))).drop("pieces")
        points, queries = (x.repartition(tasks, "part", "piece") for x in (points, queries))  # small as they are, a task each
        return points.groupBy("part", "piece").cogroup(queries.groupBy("part", "piece")).applyInArrow(search, schema)

    def nearest(self, queries: DataFrame, k: int, skip_self: bool = False, most: float = np.inf) -> DataFrame:
        """The k nearest points of ``queries(qid, qx, qy, qz)`` no farther than ``most``: ``qid, best``, an array of ``(d2, pid)``.

        First each query asks the partition that it lies in, then up to ``NEXT`` others whose boxes are
        nearer than its k-th point, then all that still are. Queries without a point are left out.
        """
        known, limit2 = self._known, _squared(most)
        spare = k + int(skip_self)

        def answers(qid, row, pid, d2):
            """One list of structs a query, from rows in order."""
            n = np.bincount(row, minlength=len(qid))
            flat = pa.StructArray.from_arrays([pa.array(d2), pa.array(pid)], names=["d2", "pid"])
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat), n

        def first(key, points: pa.Table, asked: pa.Table) -> pa.Table:
            parts, own = known.value, key[0].as_py()
            q, qid = _xyz(asked, ("qx", "qy", "qz")), asked.column("qid").to_numpy()
            cloud = _Cloud(points.column("pid").to_numpy(), _xyz(points, ("px", "py", "pz")), spare)
            row, pid, d2 = cloud.nearest(qid, q, k, skip_self, np.full(len(q), limit2))
            best, n = answers(qid, row, pid, d2)
            kth = np.full(len(q), limit2)
            ends = np.cumsum(n)
            full = n >= k
            kth[full] = np.minimum(limit2, d2[ends[full] - 1])
            short = ~full
            if short.any():
                kth[short] = np.minimum(limit2, parts.reach(q[short], spare))
            more = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for rows in cloud._blocks(q):
                low, high = q[rows].min(axis=0), q[rows].max(axis=0)
                others = np.flatnonzero((_least(low, high, parts.low, parts.high) <= kth[rows].max()) & (parts.n > 0))
                others = others[others != own]
                for piece in np.array_split(others, -(-len(others) // 512) or 1):
                    far = _square(np.maximum(np.maximum(parts.low[piece][None] - q[rows][:, None], q[rows][:, None] - parts.high[piece][None]), 0.0))
                    r, c = np.nonzero(far <= kth[rows][:, None])
                    more.append((rows[r], piece[c], far[r, c]))
            at, other, far = (np.concatenate(x) for x in zip(*more, strict=True))
            by = np.lexsort((other, far, at))
            todo = pa.StructArray.from_arrays([pa.array(far[by]), pa.array(other[by].astype(np.int32))], names=["least", "part"])
            todo = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(q)))]).astype(np.int32)), todo)
            return pa.table([asked.column("qid"), asked.column("qx"), asked.column("qy"), asked.column("qz"), best, pa.array(kth), todo], names=["qid", "qx", "qy", "qz", "best", "kth", "todo"])

        def again(key, points: pa.Table, asked: pa.Table) -> pa.Table:
            cloud = _Cloud(points.column("pid").to_numpy(), _xyz(points, ("px", "py", "pz")), spare)
            qid = asked.column("qid").to_numpy()
            row, pid, d2 = cloud.nearest(qid, _xyz(asked, ("qx", "qy", "qz")), k, skip_self, asked.column("kth").to_numpy())
            return pa.table([asked.column("qid"), answers(qid, row, pid, d2)[0]], names=["qid", "best"])

        best = "best array<struct<d2: double, pid: long>>"
        asked = cut(self._placed(queries.select("qid", "qx", "qy", "qz"), self.parts, ("qx", "qy", "qz"), "qid long, qx double, qy double, qz double"), "asked")
        state = cut(self._met(asked, first, f"qid long, qx double, qy double, qz double, {best}, kth double, todo array<struct<least: double, part: int>>"), "first")
        done = state.where("size(todo) = 0").select("qid", "best")
        state = state.where("size(todo) > 0")
        for take in (NEXT, None):
            asking = state.select("*", F.explode(F.slice("todo", 1, take) if take else F.col("todo")).alias("at")).select("qid", "qx", "qy", "qz", "kth", "at.part")
            asking = cut(asking, "asking")
            if asking.isEmpty():
                break
            found = self._met(asking, again, f"qid long, {best}")
            merged = state.select("qid", "best").unionByName(found).groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("new"))
            state = state.drop("best").join(merged, "qid").withColumnRenamed("new", "best")
            if take:  # distances of the partitions left are compared with the k-th point known now
                kth = F.when(F.size("best") >= k, F.least("kth", F.element_at("best", k)["d2"])).otherwise(F.col("kth"))
                left = F.when(F.size("todo") > take, F.filter(F.slice("todo", take + 1, MOST_PARTS), lambda x: x["least"] <= F.col("kth"))).otherwise(F.expr("slice(todo, 1, 0)"))
                state = cut(state.withColumn("kth", kth).withColumn("todo", left), "second")
                done = done.unionByName(state.where("size(todo) = 0").select("qid", "best"))
                state = state.where("size(todo) > 0")
            else:
                done = done.unionByName(cut(state.select("qid", "best"), "third"))
        return done.where("size(best) > 0")

    def within(self, queries: DataFrame, radius: float, stop: int | None = None) -> DataFrame:
        """``qid, n``: points within ``radius`` of ``queries(qid, qx, qy, qz)``; where there are ``stop`` of them or more, ``stop`` at least.

        Partitions wholly inside the ball add their size unseen; where that reaches ``stop`` nothing is
        asked. Those that the ball cuts are searched by leaves, alike.
        """
        known, limit2 = self._known, _squared(radius)

        def reached(batches):
            """Each query with each partition that its ball cuts, the sure count with the first; -1 where there is none."""
            parts = known.value
            for batch in batches:
                q, qid = _xyz(batch, ("qx", "qy", "qz")), batch.column("qid").to_numpy(zero_copy_only=False)
                sure, asks = np.zeros(len(q), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                order, starts = _leaves(q, BLOCK)
                for b in range(len(starts) - 1 if len(q) else 0):
                    rows = order[starts[b] : starts[b + 1]]
                    low, high = q[rows].min(axis=0), q[rows].max(axis=0)
                    near = np.flatnonzero((_least(low, high, parts.low, parts.high) <= limit2) & (parts.n > 0))
                    for piece in np.array_split(near, -(-len(near) // 512) or 1):
                        one = q[rows][:, None]
                        inside = _most(one, one, parts.low[piece][None], parts.high[piece][None]) <= limit2
                        touched = ~inside & (_least(one, one, parts.low[piece][None], parts.high[piece][None]) <= limit2)
                        sure[rows] += inside @ parts.n[piece]
                        r, c = np.nonzero(touched)
                        asks.append((rows[r], piece[c]))
                row, part = (np.concatenate(x) for x in zip(*asks, strict=True))
                if stop is not None:
                    part, row = part[sure[row] < stop], row[sure[row] < stop]
                alone = np.setdiff1d(np.arange(len(q)), row)
                row, part = np.concatenate([row, alone]), np.concatenate([part, np.full(len(alone), -1)])
                first = np.zeros(len(row), bool)
                first[np.unique(row, return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), *[pa.array(q[row, a]) for a in range(3)], pa.array(part.astype(np.int32)), pa.array(np.where(first, sure[row], 0))], names=["qid", "qx", "qy", "qz", "part", "n"])

        def counted(key, points: pa.Table, asked: pa.Table) -> pa.Table:
            cloud = _Cloud(points.column("pid").to_numpy(), _xyz(points, ("px", "py", "pz")))
            found = cloud.within(_xyz(asked, ("qx", "qy", "qz")), radius, stop)
            return pa.table([asked.column("qid"), pa.array(found + asked.column("n").to_numpy())], names=["qid", "n"])

        told = cut(queries.select("qid", "qx", "qy", "qz").mapInArrow(reached, "qid long, qx double, qy double, qz double, part int, n long"), "reached")
        asked = self._met(told.where("part >= 0"), counted, "qid long, n long")
        return told.where("part < 0").select("qid", "n").unionByName(asked).groupBy("qid").agg(F.sum("n").alias("n"))


    @staticmethod
    def tiled(points: DataFrame) -> SpatialIndex:
        """An index whose partitions are small enough for ``pairs``."""
        return SpatialIndex(points, most=TILE, each=1)

    def pairs(self, queries: SpatialIndex, radius: float) -> DataFrame:
        """``qid, pid, d``: all pairs of the points of ``queries`` and of this index within the radius; both are ``tiled``.

        A task has one partition of queries and a run of those partitions of points whose boxes are
        within the radius of its box: ``COMPARED`` comparisons and ``MET`` points at most, or one
        partition. The pairs are as many as they are, so what they take where they are written counts:
        of each ``SORTED`` of them the farthest come first, so that equal distances lie together, and a
        task has few ids. No pair is shuffled, and a task holds ``SORTED`` of them and some.
        """
        plan, tasks, here, there, limit2 = [], 0, queries.parts, self.parts, _squared(radius)
        for own in np.flatnonzero(here.n > 0):
            near = np.flatnonzero((_least(here.low[own], here.high[own], there.low, there.high) <= limit2) & (there.n > 0))
            most, held = min(MET, COMPARED // int(here.n[own])), 0
            for at, part in enumerate(near):
                if at == 0 or held + there.n[part] > most:
                    plan.append((tasks, True, int(own)))
                    tasks, held = tasks + 1, 0
                plan.append((tasks - 1, False, int(part)))
                held += there.n[part]
        plan = F.broadcast(self.spark.createDataFrame(plan, "task int, asks boolean, part int"))
        rows = queries.points.join(plan.where("asks"), "part").unionByName(self.points.join(plan.where("not asks"), "part"))

        def ordered(blocks, qid, pid):
            row, place, d2 = (np.concatenate(x) for x in zip(*blocks, strict=True))
            by = np.argsort(-d2)
            for first in range(0, len(by), ROWS):
                some = by[first : first + ROWS]
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(row[some])), pid.take(pa.array(place[some])), pa.array(np.sqrt(d2[some]))], names=["qid", "pid", "d"])

        def search(batches):
            got = list(batches)
            table = pa.Table.from_batches(got) if got else None
            for task in table.column("task").unique() if got else ():
                one = table.filter(pc.equal(table.column("task"), task)).combine_chunks()
                asking, points = one.filter(one.column("asks")), one.filter(pc.invert(one.column("asks")))
                cloud = _Cloud(np.arange(len(points)), _xyz(points, ("px", "py", "pz")))
                qid, pid = asking.column("pid").combine_chunks(), points.column("pid").take(pa.array(cloud.pid)).combine_chunks()
                found, held = [], 0
                for block in cloud.pairs(_xyz(asking, ("px", "py", "pz")), radius):
                    found.append(block)
                    held += len(block[0])
                    if held >= SORTED:
                        yield from ordered(found, qid, pid)
                        found, held = [], 0
                if found:
                    yield from ordered(found, qid, pid)

        return rows.repartitionById(max(tasks, 1), F.col("task")).mapInArrow(search, "qid long, pid long, d double")


__all__ = ["XYZ", "SpatialIndex"]
