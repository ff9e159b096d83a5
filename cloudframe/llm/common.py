"""Helpers shared by the corpus operators: the shared folder, text columns, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: ASCII white space: what separates words wherever a contract says ``[^\x20\x09-\x0D]+``.
SPACES = b" \t\n\x0b\x0c\r"


#: A key that one in so many rows or more have is hot; there are no more of them than that.
HOT_SHARE = 1000
#: Buckets in which keys are marked: a table of marks has no more rows.
MARKS = 1 << 18
#: Links up to which a round of ``components`` sends its minima, two a link at most, to all tasks.
FEW_LINKS = 1 << 16

#: Cut the lineage: write to the shared folder and return what was written.
save = cut


def tidy(run):
    """``run`` over Arrow batches, giving freed memory back to the system at the end: Python workers live on and hold it."""

    @wraps(run)
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied


def by_bytes(batches, text: int, most: int = 4 << 20):
    """Batches cut so that the texts of each have about ``most`` bytes."""
    for batch in batches:
        size = max(1, batch.column(text).nbytes)
        rows = max(1, batch.num_rows * most // size)
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def renamed(df: DataFrame, made: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named like one of ``made``, in any case, as ``<name>_in`` (again until free); and all names, old to new."""
    new, taken = {m.lower() for m in made}, {c.lower() for c in (*df.columns, *made)}
    names = []
    for c in df.columns:
        free = c
        if c.lower() in new:
            while free.lower() in taken:
                free += "_in"
            taken.add(free.lower())
        names.append(free)
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by number, so that no name clashes, has dots or differs by case only; and all names, old to new."""
    names = [f"__cf_c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def binary(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A text or binary Arrow column as large binary, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.fill_null(b"")


def unsent(side: DataFrame) -> DataFrame:
    """``side`` of a join, a table that grows with the input: the join is a merge join, and neither side is ever broadcast.

    Spark sizes a table by its packed files and takes the rows that ``mapInArrow`` or ``explode`` make
    of one for one, so left alone it sends far more through the driver than its threshold says.
    """
    return side.hint("merge")


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], by: list[str], count: str = "n", how: str = "left") -> DataFrame:
    """Join ``rows`` with ``groups``, which has one row a key and in ``count`` how many rows have that key.

    Hot keys, at most ``HOT_SHARE`` of them by their counts, are broadcast, whatever the size of the
    tables; nothing else is. Rows that meet theirs so move by ``by`` and no longer by the key, as do
    rows with a null key. So no task gets more than its share of a key. ``groups`` is read twice and
    should be a written table. ``how`` is ``left`` or ``inner``; an inner join tells hot rows of both sides by the
    hashes of the hot keys, a filter, and without a hot key it is a plain join.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    most = max(2, total // HOT_SHARE)
    values = [c for c in groups.columns if c not in (*on, count)]
    if how == "inner":
        # Keys that share a hot key's hash go with it on both sides.
        key = F.xxhash64(*[F.col(c).try_cast(groups.schema[c].dataType) for c in on])
        hashes = [r[0] for r in groups.where(F.col(count) >= most).select(key).distinct().collect()]  # HOT_SHARE at most
        plain = groups.select(*on, *values)
        if not hashes:
            return rows.join(unsent(plain), on).select(*rows.columns, *values)
        met = rows.where(key.isin(hashes)).join(F.broadcast(plain.where(key.isin(hashes))), on)
        return met.unionByName(rows.where(~key.isin(hashes)).join(unsent(plain.where(~key.isin(hashes))), on)).select(*rows.columns, *values)
    found = F.struct(F.lit(True).alias("__in"), *values)
    hot = F.broadcast(groups.where(F.col(count) >= most).select(*on, found.alias("__hot")))
    cold = groups.where(F.col(count) < most)
    settled = F.col("__hot").isNotNull()
    for c in on:
        settled = settled | F.col(c).isNull()
    dealt = rows.join(hot, on, "left").withColumn("__deal", F.when(settled, F.xxhash64(*by)).otherwise(F.lit(0)))
    cold = cold.select(*on, F.lit(0).cast("long").alias("__deal"), found.alias("__cold"))
    joined = dealt.join(unsent(cold), [*on, "__deal"], "left")
    hit = F.coalesce("__hot", "__cold")
    return joined.select(*rows.columns, *[hit[c].alias(c) for c in values])


def marked(rows: DataFrame, keys: DataFrame, on: list[str], name: str = "__marked") -> DataFrame:
    """``rows`` with a column ``name``: true where the key ``on`` may be among ``keys``, null where it is not.

    Every task gets the marks: which of ``MARKS`` buckets hold a key. The more keys there are, the
    more rows are marked in vain, but none is missed. A null key is not marked.
    """
    bucket = F.pmod(F.xxhash64(*on), F.lit(MARKS)).alias("__bucket")
    marks = save(keys.select(bucket).distinct().withColumn(name, F.lit(True)), "marks")
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    dealt = rows.withColumn("__bucket", F.when(~null, bucket))
    return dealt.join(F.broadcast(marks), "__bucket", "left").drop("__bucket")


def sparse_join(rows: DataFrame, groups: DataFrame, on: list[str], by: list[str], count: str = "n") -> DataFrame:
    """``spread_join`` for ``groups`` that few rows belong to: the others, told by ``marked``, do not move.

    ``rows`` is read twice and should be a table or what one scan of it gives.
    """
    told = marked(rows, groups, on)
    values = [f for f in groups.schema.fields if f.name not in (*on, count)]
    alone = told.where("__marked is null").select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in values])
    met = spread_join(told.where("__marked").drop("__marked"), groups, on, by, count)
    return met.unionByName(alone)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as ``(node, smallest node reachable)`` for every node but the smallest ones."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches):
    """Replace the links of one task by a forest of them, batch by batch."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column("a").to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column("b").to_numpy(zero_copy_only=False)])
        if len(a) > 200_000:
            a, b = forest(a, b)
        if len(a) > 2_000_000:  # a forest this large goes on as it is
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``, component the smallest node.

    Links are first contracted to forests within tasks; then large-star and small-star rounds run
    as joins and minima until the links are stars; the minima are broadcast where there are at most
    ``FEW_LINKS`` links and never beyond. Each round is written to the shared folder, so a lost
    executor costs one round at most. Nodes without a link are not in the result; rows with
    a null end are left out; an empty table gives an empty one.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = save(links.mapInArrow(_contract, "a long, b long").distinct(), "links")
    links = save(links.repartition("a").mapInArrow(_contract, "a long, b long").distinct(), "links")

    def fingerprint(df):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = None
    for _ in range(max_rounds):
        now = fingerprint(links)
        if now == before or not now[0]:
            break
        before = now
        met = F.broadcast if now[0] <= FEW_LINKS else unsent
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(met(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(met(low), "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = save(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
