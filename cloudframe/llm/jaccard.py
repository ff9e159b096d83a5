"""Near-duplicates by the Jaccard similarity of word shingles: SimHash anchors first, more fingerprints for what they cannot reach.

The anchors of ``simhash`` show texts whose 64-bit SimHashes differ in at most two bits. At a
similarity of 0.8 SimHashes differ in some ten bits, far beyond that, so further candidates come
from independent MinHash fingerprints: each is a hash of ``ROWS`` minima over the shingles of a
text, and texts that agree in one of the ``BANDS`` fingerprints form a bucket. Two texts of
similarity s share a bucket with probability ``1 - (1 - s**ROWS)**BANDS``: 0.9994 at 0.8. Every
candidate that could change the components is compared by its whole sets of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import binary, components, forest, marked, save, sparse_join, spread_join, tidy, unsent
from .simhash import majority, near_links, shingle_hashes

BANDS, ROWS = 40, 8
#: Hashes of shingles that a task keeps while it compares.
CACHED = 2_000_000
#: Texts, and shingles, of a block of a bucket: buckets of more are compared block by block.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 500_000
#: Shingles whose presence a task holds at once for the texts of two blocks.
COLUMNS = 4096
_RNG = np.random.default_rng(20)
_XOR, _MUL = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_MUL |= np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of hashed shingles, as signed numbers."""
    low = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for i in range(0, len(shingles), 256):
        np.minimum(low, ((shingles[None, i : i + 256] ^ _XOR) * _MUL).min(axis=1), out=low)
    parts = low.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], np.uint64).view(np.int64)


def _sets(words: int):
    """Append ``__key``, a hash of the set of shingles, ``__fp``, the SimHash, ``__size`` and ``__bands``."""

    @tidy
    def run(batches):
        for batch in batches:
            keys, prints, sizes, bands = [], [], [], []
            for text in binary(batch.column(0)).to_pylist():
                hashes = shingle_hashes(text, words)
                shingles = np.unique(hashes)
                keys.append(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), 42) - (1 << 63))
                prints.append(majority(hashes))
                sizes.append(len(shingles))
                bands.append(band_keys(shingles))
            flat = pa.array(np.concatenate(bands)) if bands else pa.array([], pa.int64())
            listed = pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(keys) + 1, BANDS), pa.int32()), flat)
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            prints = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(keys, pa.int64()), prints, pa.array(sizes, pa.int64()), listed], names=[*batch.schema.names[1:], "__key", "__fp", "__size", "__bands"])

    return run


def _verify(words: int, similarity: float):
    """Of rows ``a, b, ta, tb`` the pairs ``a, b`` whose texts are similar enough."""

    @tidy
    def run(batches):
        sets: dict[int, np.ndarray] = {}
        held = 0

        def hashed(key, text):
            nonlocal held
            if key not in sets:
                if held > CACHED:
                    sets.clear()
                    held = 0
                sets[key] = np.unique(shingle_hashes(text.as_py(), words))
                held += len(sets[key]) + 64
            return sets[key]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            ta, tb = binary(batch.column(2)), binary(batch.column(3))
            for i in range(len(a)):
                left, right = hashed(a[i], ta[i]), hashed(b[i], tb[i])
                if min(len(left), len(right)) < similarity * max(len(left), len(right)):
                    continue
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both >= similarity * (len(left) + len(right) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], pa.int64()) for c in (a, b)], names=["a", "b"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set of ``left`` shares with each set of ``right``."""
    flat = [np.concatenate(sets) for sets in (left, right)]
    common = np.intersect1d(*flat)
    both = np.zeros((len(left), len(right)), np.int64)
    placed = []
    for sets, numbers in zip((left, right), flat, strict=True):
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, numbers)
        met = common[np.minimum(at, len(common) - 1)] == numbers if len(common) else np.zeros(len(numbers), bool)
        order = np.argsort(at[met], kind="stable")
        placed.append((of[met][order], at[met][order]))
    for start in range(0, len(common), COLUMNS):
        has = []
        for sets, (of, at) in zip((left, right), placed, strict=True):
            i, j = np.searchsorted(at, (start, start + COLUMNS))
            part = np.zeros((len(sets), COLUMNS), np.float32)  # whole numbers to 2**24 are exact
            part[of[i:j], at[i:j] - start] = 1
            has.append(part)
        both += (has[0] @ has[1].T).astype(np.int64)
    return both


def _compare(words: int, similarity: float):
    """Links between the texts of two blocks of a bucket (or within one) that are of different components, as a forest."""

    def run(cell, table):
        _, low, high = (c.as_py() for c in cell)
        keys, of, block = (table.column(c).to_numpy() for c in ("key", "c", "block"))
        sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in binary(table.column("t"))]
        size = np.array([len(x) for x in sets], np.int64)
        i, j = np.flatnonzero(block == low), np.flatnonzero(block == high)
        a = b = np.zeros(0, np.int64)
        if len(i) and len(j):
            both = shared_counts([sets[k] for k in i], [sets[k] for k in j])
            alike = both >= similarity * (size[i][:, None] + size[j][None, :] - both)
            x, y = np.nonzero(alike & (of[i][:, None] != of[j][None, :]))
            if len(x):
                a, b = forest(keys[i[x]], keys[j[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, keep_columns: bool = False) -> DataFrame:
    """Link texts whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more.

    Words and shingles are those of ``simhash.simhash_dedup``; sets are compared by the 64-bit
    hashes of their shingles. Returns ``id_col, component_id``, the smallest id reachable over
    links, itself included; with ``keep_columns`` all columns of ``docs`` (a clashing
    ``component_id`` is replaced).

    Equal sets count once. Candidates are each SimHash fingerprint with the least one that its anchors
    show and, in each bucket, each member with a random one of its members; where a bucket then still holds more than one
    component, all its pairs across components are compared, block by block: each text moves once
    for each pair of blocks it is in, and only links leave a task. So of the pairs that share a
    bucket no link is lost. Common sets, fingerprints and buckets are sent to the rows that have them.

    Texts without a word are linked with each other. A row with a null id takes part in no
    component but is returned with that of its set, null if no row with an id has it. Repeated
    rows are all returned. Empty in, empty out. Names that begin with ``__`` are reserved.
    """
    rest = [c for c in docs.columns if c != "component_id"] if keep_columns else [id_col]
    held = list(dict.fromkeys([*rest, id_col, text_col]))
    made = [StructField("__key", LongType()), StructField("__fp", LongType()), StructField("__size", LongType()), StructField("__bands", ArrayType(LongType()))]
    source = docs.select(F.col(text_col).alias("__text"), *held)
    rows = save(source.mapInArrow(_sets(words), StructType([*(docs.schema[c] for c in held), *made])), "sets")

    with_id = rows.where(F.col(id_col).isNotNull())
    spread = with_id.select(F.col("__key").alias("key"), F.col("__size").alias("size"), F.explode("__bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min(F.struct(F.xxhash64("band", "key"), "key")).alias("m"), F.min("key").alias("low"), F.max("key").alias("top"), F.count(F.lit(1)).alias("n"))
    shared = save(shared.where("low <> top").select("band", F.col("m.key").alias("root"), "n"), "bands")
    buckets = save(spread_join(spread, shared, ["band"], [], how="inner").distinct(), "buckets")

    def texts_of(ends: DataFrame, label: str) -> DataFrame:
        """One text ``t`` for each ``key`` of ``ends``, which has no key twice."""
        texts = marked(with_id.select(F.col("__key").alias("key"), F.col(text_col).alias("t")), ends, ["key"]).where("__marked").drop("__marked")
        return save(texts.dropDuplicates(["key"]).join(unsent(ends), "key"), f"{label}-texts")

    def links(pairs: DataFrame, label: str) -> DataFrame:
        pairs = save(pairs, f"{label}-pairs")
        dealt = pairs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")  # few bytes, much work
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        texts = texts_of(save(ends, f"{label}-ends"), label)
        ta, tb = (texts.select(F.col("key").alias(c), F.col("t").alias(f"t{c}")) for c in "ab")
        return dealt.join(unsent(tb), "b").join(unsent(ta), "a").select("a", "b", "ta", "tb").mapInArrow(_verify(words, similarity), "a long, b long")

    ordered = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    prints = save(with_id.groupBy(F.col("__fp").alias("fp")).agg(F.min("__key").alias("key"), F.max("__key").alias("top"), F.count(F.lit(1)).alias("n")), "prints")
    # One candidate for each fingerprint is enough: those of a large group are not paired with each other.
    ka, kb = (unsent(prints.select(F.col("fp").alias(c), F.col("key").alias(f"k{c}"))) for c in "ab")
    near = near_links(prints).groupBy("b").agg(F.min("a").alias("a")).join(ka, "a").join(kb, "b")
    alike = spread_join(with_id.select(F.col("__fp").alias("fp"), F.col("__key").alias("k")), prints.where("key <> top").drop("top"), ["fp"], [], how="inner")
    anchored = near.select(*ordered("ka", "kb")).union(alike.select(*ordered("k", "key")))
    star = buckets.where("key <> root").select(*ordered("root", "key")).union(anchored).where("a <> b").distinct()
    found = components(links(star, "star"))
    labelled = buckets.join(unsent(found.withColumnRenamed("node", "key")), "key", "left").select("band", "key", "size", F.coalesce("component", "key").alias("c"))
    labelled = save(labelled, "labelled")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("parts")
    mixed = labelled.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n"), parts)
    mixed = save(mixed.where("low <> high").select("band", "n", "parts"), "mixed")
    if not mixed.isEmpty():
        open_ = spread_join(labelled, mixed, ["band"], ["key"], how="inner")
        open_ = save(open_.groupBy("key", "c").agg(F.collect_list(F.struct("band", "parts")).alias("at")), "open")  # BANDS at most
        dealt = texts_of(open_.select("key"), "across").join(unsent(open_), "key").select("key", "c", "t", F.inline("at"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        cells = dealt.groupBy("band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
        across = cells.applyInArrow(_compare(words, similarity), "a long, b long")
        tree = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(tree.unionByName(across))

    keys = rows.groupBy("__key").agg(F.min(F.col(id_col).cast("long")).alias("first"), F.count(F.lit(1)).alias("n"))
    keys = save(keys.join(unsent(found.withColumnRenamed("node", "__key")), "__key", "left").withColumn("c", F.coalesce("component", "__key")).select("__key", "first", "n", "c"), "keys")
    classes = keys.groupBy("c").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows"))
    classes = save(classes.where("rows > 1").withColumn("met", F.lit(True)).drop("rows"), "classes")
    named = sparse_join(keys.withColumnRenamed("n", "copies"), classes, ["c"], ["__key"]).where("met")
    named = save(named.select("__key", F.col("copies").alias("n"), "component_id", "met"), "named")
    found = sparse_join(rows, named, ["__key"], [id_col])
    return found.select(*rest, F.when(F.col("met"), F.col("component_id")).otherwise(F.col(id_col).cast("long")).alias("component_id"))
