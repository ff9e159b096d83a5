"""Embedding near-duplicates by hashing to the E8 lattice.

A table of the hash rotates unit vectors at random, takes two groups of eight coordinates, and
decodes each, scaled and shifted, to the nearest point of E8. A vector is stored in its own cell
and probes neighbouring cells: those of the lattice points next nearest in either group. Vectors
that meet in a cell are verified by cosine in double precision. Once components are known, links
are counted within them, block against block, which finds the links that no table has shown.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, save, spread_join
from .fmindex import mix

#: Blocks hold at most about so many vectors; larger cells and components are dealt out as pairs of blocks.
BLOCK = 8192


@lru_cache(1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and if the sum is odd the worst coordinate the other way."""
    near = np.rint(x)
    gap = x - near
    worst = np.abs(gap).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    w = worst[rows]
    near[rows, w] += np.where(gap[rows, w] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


class Hash:
    """``tables`` tables of two E8 groups each over vectors of ``dim`` dimensions."""

    def __init__(self, dim: int, tables: int, scale: float, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        width = max(dim, 16)
        self.probes, self.dim, self.width = probes, dim, width
        self.maps = []
        for _ in range(tables):
            q, _ = np.linalg.qr(rng.normal(size=(width, width)))
            spread = scale * np.sqrt(width / 64.0)  # the same length of a projection for any width
            self.maps.append((q[:, :16] * spread, rng.uniform(0, 1, 16)))
        self.factors = rng.integers(1, 2**63, 17, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _name(self, table: int, cells: np.ndarray) -> np.ndarray:
        twice = np.rint(2 * cells).astype(np.int64).view(np.uint64)
        return mix((twice * self.factors[:16]).sum(axis=1) + self.factors[16:] * np.uint64(table + 1)).view(np.int64)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Cells of unit vectors: ``[vector, table, probe]``, the own cell first."""
        if self.dim < self.width:
            unit = np.pad(unit, ((0, 0), (0, self.width - self.dim)))
        out = np.empty((len(unit), len(self.maps), 1 + self.probes), np.int64)
        step = neighbours()
        for t, (q, shift) in enumerate(self.maps):
            x = unit @ q + shift
            cells = np.concatenate([decode(x[:, :8]), decode(x[:, 8:])], axis=1)
            out[:, t, 0] = self._name(t, cells)
            # How much farther each neighbouring lattice point is: |r - s|^2 - |r|^2 = 2 - 2 r.s
            far = np.concatenate([2 - 2 * (x - cells)[:, :8] @ step.T, 2 - 2 * (x - cells)[:, 8:] @ step.T], axis=1)
            best = np.argpartition(far, self.probes, axis=1)[:, : self.probes]
            for k in range(self.probes):
                moved = cells.copy()
                which = best[:, k]
                low = which < 240
                moved[low, :8] += step[which[low]]
                moved[~low, 8:] += step[which[~low] - 240]
                out[:, t, 1 + k] = self._name(t, moved)
        return out


def unit_vectors(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of stored components as unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither tiny nor huge components lose the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _clean(kind: str):
    """``vec_id, vec``: components as they are stored; null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            values = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
            at = column.offsets.to_numpy().astype(np.int64)
            before = lambda hit: np.concatenate([[0], np.cumsum(hit)])[at]
            bad, used = np.diff(before(~np.isfinite(values))), np.diff(before(values != 0))
            good = column.is_valid().to_numpy(zero_copy_only=False) & (bad == 0) & (used > 0)
            with np.errstate(invalid="ignore", over="ignore"):
                stored = (values + 0.0).astype(kind)  # minus zero becomes zero
            offsets = pa.py_buffer((at * np.dtype(kind).itemsize).astype(np.int32))
            valid = pa.py_buffer(np.packbits(good, bitorder="little"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(column), [valid, offsets, pa.py_buffer(stored)])], names=["vec_id", "vec"])

    return run


def _cells(kind: str, tables: int, scale: float, probes: int, seed: int):
    def run(batches):
        hashes: dict[int, Hash] = {}
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            size = np.diff(np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1])
            for n in np.unique(size).tolist():  # vectors of other lengths have no cosine with these
                dim = n // np.dtype(kind).itemsize
                h = hashes.setdefault(dim, Hash(dim, tables, scale, probes, seed))
                rows = np.flatnonzero(size == n)
                for i in range(0, len(rows), 2048):
                    at = pa.array(rows[i : i + 2048])
                    part = vectors.take(at)
                    keys = h.keys(unit_vectors(part.to_pylist(), kind)) ^ np.int64(dim)
                    many = keys.shape[1] * keys.shape[2]
                    again = pa.array(np.repeat(np.arange(len(part)), many))
                    home = np.tile(np.arange(keys.shape[2]) == 0, len(part) * keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), ids.take(at).take(again), pa.array(home)], names=["cell", "id", "home"])

    return run


def _blocks(n, block: int):
    """Blocks of a group of n: of at most ``block`` members, and up to sixteen, of a 128th of a block or more, so that many tasks share a group."""
    small = F.greatest(F.lit(1), F.least(F.lit(16), F.floor(n / F.lit(max(block // 128, 1)))))
    return F.greatest(F.ceil(n / F.lit(block)), small).cast("int")


def _pairs_of_blocks(df: DataFrame, group: str, member: str, sizes: DataFrame, block: int) -> DataFrame:
    """Deal the members of each group to pairs of blocks ``(bi, bj)``, bi <= bj, that cover all pairs of members.

    A group of one block is one pair of it with itself; a row of a larger group goes to as many
    pairs as the group has blocks.
    """
    df = df.join(sizes.select(group, _blocks(F.col("n"), block).alias("blocks")), group)
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    df = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))


def _by_group(name: str, handle):
    """Run ``handle`` on the rows of whole groups ``(name, bi, bj)`` of one vector length, which arrive sorted.

    Groups are bounded by two blocks; a task holds a batch and the group that it ends in.
    """

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = np.stack([held.column(c).to_numpy().astype(np.int64) for c in (name, "bi", "bj")])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if len(change):
                yield from parts(held.slice(0, int(change[-1])), key[:, : change[-1]])
                held = held.slice(int(change[-1]))
        if held is not None and held.num_rows:
            key = np.stack([held.column(c).to_numpy().astype(np.int64) for c in (name, "bi", "bj")])
            yield from parts(held, key)

    def parts(table, key):
        vectors = table.column("vec").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        size = np.diff(np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1])
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            k = key[:, rows]
            starts = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)]))
            yield handle(table.take(pa.array(rows)), starts, np.diff(np.append(starts, len(rows))))

    return run


def _near_pairs(unit: np.ndarray, starts: np.ndarray, size: np.ndarray, own: np.ndarray, bi: np.ndarray, bj: np.ndarray, threshold: float):
    """Pairs of rows of a group, from either of its blocks, with a cosine of at least the threshold: yields (x, y) in pieces.

    Small groups are compared all at once, rows a step apart at a time; larger ones block by block.
    """
    small = size <= 32
    where = np.arange(len(unit)) - np.repeat(starts, size)
    left = np.where(np.repeat(small, size), np.repeat(size, size) - where, 0)
    for step in range(1, int(size[small].max(initial=1))):
        x = np.flatnonzero(left > step)
        for i in range(0, len(x), 1 << 15):
            a = x[i : i + (1 << 15)]
            b = a + step
            a, b = (v[(own[a] != own[b]) | (bi[a] == bj[a])] for v in (a, b))
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            yield a[near], b[near]
    for s, n in zip(starts[~small].tolist(), size[~small].tolist(), strict=True):
        rows = np.arange(s, s + n)
        first, second = rows[own[rows] == bi[s]], rows[own[rows] == bj[s]]
        for i in range(0, len(first), 256):
            a = first[i : i + 256]
            x, y = np.nonzero(unit[a] @ unit[second].T >= threshold)
            x, y = a[x], second[y]
            keep = x < y if bi[s] == bj[s] else slice(None)
            yield x[keep], y[keep]


def _link(threshold: float, kind: str):
    """Tree links of whole cells or pairs of their blocks: homes against everyone who probes."""

    def handle(table, starts, size):
        ids, own, bi, bj, home = (table.column(c).to_numpy() for c in ("id", "own", "bi", "bj", "home"))
        unit = unit_vectors(table.column("vec").to_pylist(), kind)
        found = [(np.zeros(0, np.int64),) * 2]
        for x, y in _near_pairs(unit, starts, size, own, bi, bj, threshold):
            good = (home[x] | home[y]) & (ids[x] != ids[y])
            found.append(forest(ids[x[good]], ids[y[good]]))
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        if len(x):
            x, y = forest(x, y)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return _by_group("cell", handle)


def _count(threshold: float, kind: str):
    """Links of each vector with those of the other block of its component, copies counted."""

    def handle(table, starts, size):
        ids, own, bi, bj, copies = (table.column(c).to_numpy() for c in ("id", "own", "bi", "bj", "copies"))
        unit = unit_vectors(table.column("vec").to_pylist(), kind)
        n = np.zeros(len(ids), np.int64)
        for x, y in _near_pairs(unit, starts, size, own, bi, bj, threshold):
            np.add.at(n, x, copies[y])
            np.add.at(n, y, copies[x])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n)], names=["id", "n"])

    return _by_group("component_id", handle)


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = 6, scale: float = 3.0, probes: int = 3, block: int = BLOCK, seed: int = 88,
) -> DataFrame:
    """Link vectors whose cosine is ``threshold`` or more: ``id_col, n_links, component_id, kept``.

    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest id
    reachable over links, itself included, and ``kept`` marks that vector. Components are found over
    links that a table of the hash shows; a link it misses is missed only if no chain of shown links
    joins its ends. None below the threshold is ever found.

    Equal vectors are compared once and counted. Cells move by key, without being collected; large
    cells and components are dealt out as pairs of blocks of at most ``block`` vectors, so every
    task is bounded, and cells hand on a tree of links, not all of them. Counting the links of a
    component of n vectors compares all its pairs and moves each vector n / ``block`` times.

    Null, zero and empty vectors and those with a null or non-finite component link with nothing,
    nor do vectors of different lengths. Rows with a null id are returned unlinked. Repeated rows
    of one id are compared as one vector if equal and are all returned. Empty in, empty out.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = save(source.mapInArrow(_clean(kind), "vec_id long, vec binary"), "vectors")
    good = rows.where("vec is not null and vec_id is not null")
    # A vector stands for its copies; its id is the smallest of theirs.
    distinct = save(good.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"), F.count(F.lit(1)).alias("rows")), "distinct")
    cells = save(distinct.select("id", "vec").mapInArrow(_cells(kind, tables, scale, probes, seed), "cell long, id long, home boolean"), "cells")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("used")).where("used and n > 1")
    dealt = _pairs_of_blocks(cells, "cell", "id", sizes, block).join(distinct.select("id", "vec"), "id")
    grouped = lambda df, name: df.repartition(name, "bi", "bj").sortWithinPartitions(name, "bi", "bj")
    edges = grouped(dealt.select("cell", "bi", "bj", "own", "id", "home", "vec"), "cell").mapInArrow(_link(threshold, kind), "a long, b long")
    labels = save(components(edges).select(F.col("node").alias("id"), F.col("component").alias("component_id")), "labels")

    members = distinct.join(labels, "id").select("id", "vec", "copies", "component_id")
    sizes = labels.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    dealt = _pairs_of_blocks(members, "component_id", "id", sizes, block)
    counted = grouped(dealt.select("component_id", "bi", "bj", "own", "id", "copies", "vec"), "component_id").mapInArrow(_count(threshold, kind), "id long, n long")
    links = counted.groupBy("id").agg(F.sum("n").alias("n"))
    known = save(distinct.join(labels, "id", "left").join(links, "id", "left").select(
        "vec", "rows", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ), "known")
    linked = spread_join(good, known, ["vec"], ["vec_id"], "rows").select(F.col("vec_id").alias(id_col), "n_links", "component_id")
    alone = rows.where("vec is null or vec_id is null").select(F.col("vec_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
