"""SimHash near-duplicates by anchor-point covering.

Two blocks of 23 bits of a 64-bit fingerprint are words of the binary Golay space, where the
perfect (23,12) code has covering radius 3. A pair of codewords is an anchor. If fingerprints x
and y differ in at most t bits, the anchor nearest to x lies within 3 + i of y's first block and
3 + j of its second for some i + j <= t: within the covering radius 6 plus the threshold. So each
fingerprint is stored at its nearest anchor, replicated to every anchor within that reach, and
compared per anchor. No link is lost, whatever the data.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import binary, components, save, spread_join, unsent

#: Generator polynomial of the binary Golay code, and the radius within which it covers all words.
GOLAY, LENGTH, RADIUS = 0xAE3, 23, 3


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of all word shingles of a text, in order (see ``simhash_dedup``)."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], 42) for s, e in pairs), np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority of each bit over the hashes of all word shingles (see ``simhash_dedup``)."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            texts = binary(batch.column(0))
            found = np.fromiter((fingerprint(t, words) for t in texts.to_pylist()), np.uint64, len(texts))
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found.view(np.int64))], names=[*batch.schema.names[1:], "__fp"])

    return run


@lru_cache(1)
def _cosets() -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndromes of all bytes by place, and for each syndrome the error patterns of weight <= 3, 4 and 5."""

    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(LENGTH - 1, 10, -1):
            x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
        return x

    by_place = np.stack([syndrome(np.arange(256, dtype=np.int64) << s & (1 << LENGTH) - 1) for s in (0, 8, 16)])
    patterns: list[list[np.ndarray]] = []
    for weights in ((0, 1, 2, 3), (4,), (5,)):
        errors = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(LENGTH), w)], np.int64)
        order = np.argsort(s := syndrome(errors), kind="stable")
        cuts = np.searchsorted(s[order], np.arange(2049))
        patterns.append([errors[order[i:j]] for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
    return by_place, patterns


def anchors(fp: int, reach: int) -> tuple[int, np.ndarray]:
    """The nearest anchor of a fingerprint, and all anchors within the covering radius plus ``reach`` (0 to 2)."""
    by_place, patterns = _cosets()
    near: list[list[np.ndarray]] = []
    for shift in (0, LENGTH):
        block = fp >> shift & (1 << LENGTH) - 1
        s = int(by_place[0, block & 255] ^ by_place[1, block >> 8 & 255] ^ by_place[2, block >> 16])
        near.append([(block ^ patterns[i][s]) << shift for i in range(reach + 1)])
    home = int(near[0][0][0] | near[1][0][0])
    found = [(near[0][i][:, None] | near[1][j][None, :]).ravel() for i in range(reach + 1) for j in range(reach + 1 - i)]
    return home, np.concatenate(found)


def _replicate(reach: int):
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                both = [anchors(fp & (1 << 64) - 1, reach) for fp in part.tolist()]
                size = [len(a) for _, a in both]
                at = np.concatenate([*(a for _, a in both), np.array([h for h, _ in both])])
                of = np.concatenate([np.repeat(part, size), part])
                home = np.arange(len(at)) >= sum(size)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(of), pa.array(home)], names=["anchor", "fp", "home"])

    return run


def near_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct values of ``fps(fp)`` that differ in 1 to ``distance`` bits."""
    if not 0 <= distance <= 2:
        raise ValueError("the tables of error patterns reach up to 2 differing bits")
    replicas = fps.select("fp").mapInArrow(_replicate(distance), "anchor long, fp long, home boolean")
    home = replicas.where("home").select("anchor", F.col("fp").alias("a"))
    guest = replicas.where("not home").select("anchor", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return home.alias("h").join(unsent(guest).alias("g"), (F.col("h.anchor") == F.col("g.anchor")) & near).select("a", "b")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, words: int = 3, keep_columns: bool = False) -> DataFrame:
    """Fingerprint every text and link fingerprints at ``distance`` or fewer differing bits.

    A text's A-Z are lower-cased, its words split at ASCII white space, and each run of ``words``
    words, joined by spaces, hashed with XXH64 (seed 42); with fewer words the whole sequence is
    the one shingle. A bit of the fingerprint is set if it is set in over half the hashes. Returns
    ``id_col, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over
    links, itself included; with ``keep_columns`` also the other columns of ``docs`` (those that
    clash with the new ones are replaced).

    Documents with equal fingerprints count once when fingerprints are compared; membership is
    joined back, common fingerprints by broadcast. Null and empty texts and texts of white space have fingerprint zero and are linked
    like any other. A row with a null id takes part in no component but is returned with that of
    its fingerprint, null if no row with an id has it. Repeated rows are all returned. Empty in,
    empty out.
    """
    rest = [c for c in docs.columns if c not in (text_col, "fingerprint", "component_id")] if keep_columns else [id_col]
    source = docs.select(F.col(text_col).alias("__text"), *([text_col] if keep_columns else []), *rest)
    rows = source.mapInArrow(_fingerprints(words), StructType([*source.schema.fields[1:], StructField("__fp", LongType())]))
    rows = save(rows, "fingerprints")
    first = save(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).cast("long").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    links = near_links(first, distance)
    by_a = first.select(F.col("fp").alias("a"), F.col("first").alias("ia"))
    by_b = first.select(F.col("fp").alias("b"), F.col("first").alias("ib"))
    edges = links.join(unsent(by_a), "a").join(unsent(by_b), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    labels = components(edges).withColumnRenamed("node", "first")
    named = save(first.join(unsent(labels), "first", "left").select(F.col("fp").alias("__fp"), "n", F.coalesce("component", "first").alias("component_id")), "named")
    hexed = F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint")
    out = [text_col, *rest] if keep_columns else rest
    return spread_join(rows, named, ["__fp"], [id_col]).select(*out, hexed, "component_id")
