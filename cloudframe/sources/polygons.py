"""Rows of binary elements with lists, whose places follow only from all rows before, read by many tasks.

Each byte range first tells, for every place near its beginning at which a row might start, where
the rows from there leave the range and how many they are. These maps are composed, in groups of
ranges and then group by group, which gives each range its first row; then the ranges are read.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .files import BATCH_ROWS, open_input

#: Ranges of a group, and the most places at the beginning of a range for which its map is made.
GROUP, WINDOW = 64, 1 << 14
#: A row that cannot be: its count is negative or it goes beyond the end.
DEAD = -1
_CODES = {"i1": "b", "u1": "B", "i2": "h", "u2": "H", "i4": "i", "u4": "I"}


class ListRows:
    """Rows of (name, type) and (name, count type, item type) properties within bytes ``start`` to ``stop`` of a file.

    A row belongs to the range in which it starts; what it has beyond is read when it is needed.
    """

    def __init__(self, path: str, properties: list[tuple], order: str, start: int, stop: int, end: int, list_name: str | None = None):
        self.path, self.start, self.end = path, start, end
        with open_input(path) as f:
            f.seek(start)
            self.data = f.read(stop - start)
        self.lists, skip, self.wanted = [], 0, None
        for p in properties:
            if len(p) == 2:
                skip += int(p[1][1])
                continue
            if p[0] == list_name:
                self.wanted = len(self.lists)
                self.item = np.dtype(order + p[2])
            self.lists.append((skip, struct.Struct(order + _CODES[p[1]]).unpack_from, int(p[1][1]), int(p[2][1])))
            skip = 0
        self.tail = skip

    def load(self, stop: int) -> None:
        """Have the bytes up to ``stop``."""
        at = self.start + len(self.data)
        if stop > at:
            with open_input(self.path) as f:
                f.seek(at)
                self.data += f.read(stop - at)

    def row(self, at: int, found: list | None = None) -> int:
        """Where the row at ``at`` ends, or DEAD; the place and length of the wanted list go into ``found``."""
        for k, (skip, unpack, size, width) in enumerate(self.lists):
            at += skip
            if at + size > self.end:
                return DEAD
            if at + size - self.start > len(self.data):
                with open_input(self.path) as f:  # a list after a long one of the last row: only its count is read
                    f.seek(at)
                    n = unpack(f.read(size))[0]
            else:
                n = unpack(self.data, at - self.start)[0]
            if n < 0:
                return DEAD
            at += size
            if found is not None and k == self.wanted:
                found.append((at, n))
            at += n * width
        at += self.tail
        return at if at <= self.end else DEAD

    def walk(self, at: int, stop: int, most: int | None = None) -> tuple[int, int]:
        """Follow rows from ``at`` to the first that starts at ``stop`` or later, or over ``most`` rows: where that is, and rows passed."""
        n = 0
        while DEAD < at < stop and n != most:
            if (at := self.row(at)) != DEAD:
                n += 1
        return at, n

    def exits(self, stop: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """``walk`` from each of the first ``window`` places.

        Chains of rows that meet go on as one. Wrong chains soon meet the right one in real files; at
        worst all of them last to the end of the range.
        """
        window = min(window, stop - self.start)
        leads = [(0, 0)] * window  # for a chain that has met another: that one, and rows it has passed more
        passed, place = [0] * window, [DEAD] * window
        alive = [(self.start + k, k) for k in range(window)]  # a heap, by place
        met = [False] * window
        while alive:
            at, k = heapq.heappop(alive)
            until = min(alive[0][0], stop) if alive else stop
            if alive and alive[0][0] == at:
                met[k], leads[k] = True, (alive[0][1], passed[k] - passed[alive[0][1]])
                continue
            at, n = self.walk(at, until)
            passed[k] += n
            if at == DEAD or at >= stop:
                place[k] = at
            else:
                heapq.heappush(alive, (at, k))
        places, rows = np.empty(window, np.int64), np.empty(window, np.int64)
        for k in range(window):
            c, more = k, 0
            while met[c]:
                c, step = leads[c]
                more += step
            places[k], rows[k] = place[c], passed[c] + more
        return places, rows

    def lists_from(self, at: int, stop: int, most: int) -> Iterator[list[np.ndarray]]:
        """The wanted lists of at most ``most`` rows from ``at`` on that start before ``stop``, in batches."""
        while at < stop and most > 0:
            found: list = []
            first, items = at, 0
            while at < stop and len(found) < min(most, BATCH_ROWS) and items < 16 * BATCH_ROWS:
                at = self.row(at, found)
                items += found[-1][1]
            self.load(at)
            most -= len(found)
            begins, sizes = (np.array(c, np.int64) for c in zip(*found, strict=True))
            width = self.item.itemsize
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            places = np.repeat(begins - first, sizes) + within * width
            raw = np.frombuffer(self.data, np.uint8, at - first, first - self.start)
            values = raw[places[:, None] + np.arange(width)].reshape(-1).view(self.item).astype(np.int64)
            yield [values, np.concatenate([[0], np.cumsum(sizes)])]


class ListElement:
    """The rows of one element, from ``begin``, in ranges of ``split`` bytes; ``end`` is a bound of where they end."""

    def __init__(self, path: str, properties: list[tuple], order: str, begin: int, end: int, count: int, split: int):
        self.path, self.properties, self.order = path, properties, order
        self.begin, self.end, self.count, self.split = begin, end, count, max(split, 1)
        self.parts = max(1, -(-(end - begin) // self.split))
        longest = sum(int(p[1][1]) if len(p) == 2 else int(p[1][1]) + int(p[2][1]) * (2 ** (8 * int(p[1][1])) - 1) for p in properties)
        self.window = min(longest, WINDOW)

    def bounds(self, part: int) -> tuple[int, int]:
        start = self.begin + part * self.split
        return start, min(start + self.split, self.end)

    def rows(self, part: int, list_name: str | None = None) -> ListRows:
        return ListRows(self.path, self.properties, self.order, *self.bounds(part), self.end, list_name)

    def _maps(self, spark: SparkSession) -> DataFrame:
        def run(batches):
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    places, rows = self.rows(part).exits(self.bounds(part)[1], self.window)
                    yield pa.RecordBatch.from_pylist([{"part": part, "places": places.tolist(), "passed": rows.tolist()}], pa.schema([("part", pa.int64()), ("places", pa.list_(pa.int64())), ("passed", pa.list_(pa.int64()))]))

        maps = spark.range(0, self.parts, 1, self.parts).mapInArrow(run, "part long, places array<bigint>, passed array<bigint>")
        return cut(maps.withColumn("group", F.floor(F.col("part") / GROUP)))

    def _through(self, maps: pd.DataFrame, at: int, seen: dict):
        """Lead one place through the ranges of a group: (part, place, rows of the range, place after it) of each range with rows."""
        for part, places, passed in zip(maps["part"], maps["places"], maps["passed"], strict=True):
            start, stop = self.bounds(part)
            if at == DEAD:
                return
            if at >= stop:  # a row that goes over the whole range
                continue
            if (part, at) not in seen:
                k = at - start
                # A row before this range that is longer than the window leads behind the map's places.
                seen[part, at] = (int(places[k]), int(passed[k])) if k < len(places) else self.rows(part).walk(at, stop)
            after, n = seen[part, at]
            yield part, at, n, after
            at = after

    def _lead(self, place: int):
        """The place and the rows passed after a group that is entered at ``place``."""

        def run(group: pd.DataFrame) -> pd.DataFrame:
            at, rows = place, 0
            for _, _, n, at in self._through(group.sort_values("part"), at, {}):
                rows += n
            return pd.DataFrame({"place": [at], "rows": [rows]})

        return run

    def places(self, spark: SparkSession) -> tuple[DataFrame, int]:
        """``part, place, row, done`` of each range with rows: where the first begins and its number; and where the element ends.

        Raises if the rows end before their count.
        """
        if not self.count:
            return spark.createDataFrame([], "part long, place long, row long, done long"), self.begin
        maps = self._maps(spark)

        def compose(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("part")
            seen: dict = {}
            first = self.bounds(group["part"].iloc[0])[0]
            places, passed = [], []
            for at in range(first, first + len(group["places"].iloc[0])):
                rows = 0
                for _, _, n, at in self._through(group, at, seen):
                    rows += n
                places.append(at)
                passed.append(rows)
            return pd.DataFrame({"group": [group["group"].iloc[0]], "places": [places], "passed": [passed]})

        groups = cut(maps.groupBy("group").applyInPandas(compose, "group long, places array<bigint>, passed array<bigint>"))

        at, row, starts = self.begin, 0, []
        for g in groups.orderBy("group").toLocalIterator():  # a row for each 64 ranges
            first, stop = self.bounds(g["group"] * GROUP)[0], self.bounds(min((g["group"] + 1) * GROUP, self.parts) - 1)[1]
            if at == DEAD or row >= self.count:
                break
            if at >= stop:
                continue
            starts.append((g["group"], at, row))
            k = at - first
            if k < len(g["places"]):
                at, row = g["places"][k], row + g["passed"][k]
            else:  # as above, for a group: one task leads the one place through it
                found = maps.where(F.col("group") == g["group"]).groupBy("group").applyInPandas(self._lead(at), "place long, rows long").first()
                at, row = found["place"], row + found["rows"]
        if row < self.count:
            raise ValueError(f"PLY parse error in {self.path}: the file ends within a list or a list has a negative count")

        def descend(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("part")
            at, row = int(group["at"].iloc[0]), int(group["row"].iloc[0])
            out = []
            for part, place, n, after in self._through(group, at, {}):
                if row >= self.count:
                    break
                done = None
                if row + n >= self.count:
                    done = after if row + n == self.count and after != DEAD else self.rows(part).walk(place, self.end, self.count - row)[0]
                out.append((part, place, row, done))
                row += n
            return pd.DataFrame(out, columns=["part", "place", "row", "done"]).astype({"done": "Int64"})

        known = spark.createDataFrame(starts, "group long, at long, row long")
        found = cut(maps.join(known, "group").groupBy("group").applyInPandas(descend, "part long, place long, row long, done long"))
        return found, found.agg(F.max("done")).first()[0]

    def lists(self, places: DataFrame, list_name: str) -> DataFrame:
        """``row, corners``: the lists of one name, a task a range."""
        def run(batches):
            for batch in batches:
                for part, place, row in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "row")), strict=True):
                    for values, offsets in self.rows(part, list_name).lists_from(place, self.bounds(part)[1], self.count - row):
                        n = len(offsets) - 1
                        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), lists], names=["row", "corners"])
                        row += n

        return places.repartition(self.parts).mapInArrow(run, "row long, corners array<bigint>")
