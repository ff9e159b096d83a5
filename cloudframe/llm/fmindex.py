"""Repeated passages found with compressed FM-indexes, one per shard.

Every window of ``window`` words is routed by its minimizer, the smallest hash among its ``K``-word
runs: equal windows have equal minimizers, wherever they start. A run of windows that share one
minimizer occurrence is a segment. Segments whose minimizer occurs once in the corpus hold no
repeated window. The others, one row for each distinct segment, go to shards by minimizer; a shard
builds an FM-index (suffix order to depth 64, a wavelet matrix over the transform) and streams its
segments through it by backward search, which gives matching statistics and the intervals of
windows that occur twice or more.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SPACES, binary, numbered, save, spread_join, tidy

K = 12
#: Words in a shard's index after which the next minimizer starts a new one.
SHARD_WORDS = 600_000
#: Distinct segments of one minimizer beyond which its windows are routed one by one.
HOT_SEGMENTS = 10_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    base = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    base[0] = 1
    return np.cumprod(base, dtype=np.uint64)


def scan_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a text, in slices cut at white space."""
    data = np.frombuffer(text, np.uint8)
    found = []
    at, step = 0, 1 << 21
    while at < len(data):
        end = min(at + step, len(data))
        while end < len(data) and not _IS_SPACE[data[end - 1]]:
            nxt = np.flatnonzero(_IS_SPACE[data[end : end + step]])
            end = end + int(nxt[0]) + 1 if len(nxt) else min(end + step, len(data))
        part = data[at:end]
        inside = np.concatenate([[False], ~_IS_SPACE[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            size = ends - starts
            index = np.flatnonzero(inside[1:-1])
            first = np.cumsum(size) - size
            place = np.arange(len(index)) - np.repeat(first, size)
            sums = np.add.reduceat(_BYTE[part[index]] * _powers(int(size.max()))[place], first)
            found.append((starts + at, ends + at, mix(sums + size.astype(np.uint64))))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _slide_min(value: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of each ``width`` consecutive values."""
    place = np.arange(len(value))
    have, done, total = (value, place), None, 0
    size = 1

    def merge(x, y):
        n = min(len(x[0]), len(y[0]))
        take = y[0][:n] < x[0][:n]
        return np.where(take, y[0][:n], x[0][:n]), np.where(take, y[1][:n], x[1][:n])

    while True:
        if width & size:
            done = have if done is None else merge(done, tuple(a[total:] for a in have))
            total += size
        if total == width:
            return done[1]
        have = merge(have, tuple(a[size:] for a in have))
        size *= 2


def segments_of(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Segments of documents whose words are ``hashes[first:last]``: document, first window, windows, minimizer, content."""
    none = np.zeros(0, np.int64)
    count = np.maximum(last - first - window + 1, 0)
    if not count.sum():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    runs = sum(hashes[j : len(hashes) - K + 1 + j] * _FACTORS[j] for j in range(K))
    runs = mix(runs)
    least = _slide_min(runs, window - K + 1)
    doc = np.repeat(np.arange(len(first)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    pos = least[at]
    cut = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])]))
    size = np.diff(np.append(cut, len(at)))
    steps = [*range(0, window - K, K), window - K]  # runs that cover a window
    whole = lambda i: mix(sum(runs[i + s] * _FACTORS[20 + k] for k, s in enumerate(steps)))
    a = at[cut]
    content = mix(whole(a) * _FACTORS[60] + whole(a + size - 1) * _FACTORS[61] + size.astype(np.uint64))
    return doc[cut], a - first[doc[cut]], size, runs[pos[cut]], content


def _groups(texts: list[bytes], most: int = 1 << 20):
    """Consecutive texts of about a megabyte, or one larger text: (first index, texts)."""
    group, size, begin = [], 0, 0
    for k, t in enumerate(texts):
        group.append(t)
        size += len(t) + 1
        if size >= most:
            yield begin, group
            group, size, begin = [], 0, k + 1
    if group:
        yield begin, group


def _words_by_doc(group: list[bytes]):
    joined = b"\n".join(group)
    starts, ends, hashes = scan_words(joined)
    size = np.fromiter(map(len, group), np.int64, len(group)) + 1
    begin = np.cumsum(size) - size
    first = np.searchsorted(starts, begin)
    return joined, starts, ends, hashes, first, np.append(first[1:], len(starts))


def _segments(window: int):
    @tidy
    def run(batches):
        for batch in batches:
            keys = [batch.column(0), batch.column(1)]
            for begin, group in _groups(binary(batch.column(2)).to_pylist()):
                _, _, _, hashes, first, last = _words_by_doc(group)
                doc, start, size, least, content = segments_of(hashes, first, last, window)
                rows = pa.array(doc + begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.array(content.view(np.int64)), *(k.take(rows) for k in keys), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["m", "sh", "k1", "k2", "start", "nw"],
                )

    return run


UNIT = "key long, m long, sh long, off int, nw int, n long, hot boolean, words binary"


def _units(window: int):
    """Cut the words of the listed segments out of each text, once a task for repeated rows; hot ones window by window."""
    names = [x.split()[0] for x in UNIT.split(", ")]

    @tidy
    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = []
            for i, row in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if row not in seen:
                    seen.add(row)
                    new.append(i)
            if len(new) < batch.num_rows:
                batch = batch.take(pa.array(new, pa.int64()))
            listed = batch.column(1)
            fields = {f.name: listed.flatten().field(k).to_pylist() for k, f in enumerate(listed.type.value_type)}
            cuts = (np.asarray(listed.offsets) - listed.offsets[0].as_py()).tolist()
            rows: dict[str, list] = {c: [] for c in names}

            def add(*values):
                for c, v in zip(names, values, strict=True):
                    rows[c].append(v)

            for begin, group in _groups(binary(batch.column(0)).to_pylist()):
                joined, starts, ends, hashes, first, _ = _words_by_doc(group)
                for d in range(len(group)):
                    for i in range(cuts[begin + d], cuts[begin + d + 1]):
                        w = int(first[d]) + fields["start"][i]
                        nw, m, sh, n = (fields[c][i] for c in ("nw", "m", "sh", "n"))
                        if not fields["hot"][i]:
                            add(m, m, sh, 0, nw, n, False, joined[starts[w] : ends[w + window + nw - 2]])
                            continue
                        for off in range(nw):
                            h = hashes[w + off : w + off + window]
                            key = int(mix((h * _powers(window)).sum(keepdims=True)).view(np.int64)[0])
                            add(key, m, sh, off, 1, n, True, joined[starts[w + off] : ends[w + off + window - 1]])
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=names)

    return run


class WaveletMatrix:
    """Rank over a sequence of integers: one packed bit row a level, with a count at every 64 bits."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.rows, n = [], len(values)
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words)[:-1], dtype=np.int64)]).astype(np.int32)
            self.rows.append((level, words, before, n - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """For each symbol and place, where the symbols before that place end in the last level's order."""
        at = list(places)
        for level, words, before, zeros in self.rows:
            one = (symbol >> level & 1).astype(bool)
            for k, i in enumerate(at):
                block = i >> 6
                ones = before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
                at[k] = np.where(one, zeros + ones, i - ones)
        return at


class FMIndex:
    """FM-index of a sequence of symbols 1 to sigma - 1, with 0 between texts and a weight for each text.

    Suffixes are ordered by their first 64 symbols, which suffices for patterns of up to 64.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, weights: np.ndarray):
        n = len(symbols)
        rank = symbols.astype(np.int64)
        depth = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: max(n - depth, 0)] = rank[depth:] + 1
            key = rank * (n + sigma + 2) + after
            order = np.argsort(key, kind="stable")
            depth *= 2
            if depth >= 64:
                break
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        self.tree = WaveletMatrix(symbols[order - 1], sigma)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.base = self.tree.rank(np.arange(sigma), np.zeros(sigma, np.int64))[0]
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that begin with symbol and then with what [low, high) begins with."""
        a, b = self.tree.rank(symbol, low, high)
        return self.start[symbol] + a - self.base[symbol], self.start[symbol] + b - self.base[symbol]


def repeated_windows(texts: list[bytes], counts: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """For each text of ``window + sizes - 1`` words, a bit mask of its windows that occur twice or more in all, counting each text ``counts`` times."""
    _, _, _, hashes, first, last = _words_by_doc(texts)
    if not np.array_equal(last - first, sizes + window - 1):
        raise RuntimeError("a segment has lost words")
    values, symbol = np.unique(hashes, return_inverse=True)
    n = len(hashes) + len(texts)
    sequence = np.zeros(n, np.int64)
    of = np.repeat(np.arange(len(texts)), last - first)
    sequence[np.arange(len(hashes)) + of] = symbol + 1
    begin = first + np.arange(len(texts))
    weights = np.zeros(n, np.int64)
    weights[np.arange(len(hashes)) + of] = np.repeat(counts, last - first)
    index = FMIndex(sequence, len(values) + 1, weights)

    mask = np.zeros(len(texts), np.int64)
    unit = np.arange(len(texts))  # searches in progress: text, last word, next word to the left, suffixes
    end = begin + sizes + window - 2
    place = end.copy()
    low, high = np.zeros(len(texts), np.int64), np.full(len(texts), n, np.int64)
    while len(unit):
        a, b = index.extend(sequence[place], low, high)
        more = index.weight[b] - index.weight[a] >= 2
        low, high = np.where(more, a, low), np.where(more, b, high)
        place = place - more
        whole = place < begin[unit]
        over = ~more | whole
        if not over.any():
            continue
        u, e, p = unit[over], end[over], place[over]
        length = e - p
        s = p + 1 - begin[u]  # windows from the s-th to the one that ends at e are repeated
        good = length >= window
        run = np.where(good, (np.int64(1) << np.where(good, length - window + 1, 0)) - 1 << np.where(good, s, 0), 0)
        np.bitwise_or.at(mask, u, run)
        after = np.where(good, p + window - 1, e - 1)  # the next window not yet decided ends here
        go = ~whole[over] & (after >= begin[u] + window - 1)
        keep = ~over
        unit, end = np.concatenate([unit[keep], u[go]]), np.concatenate([end[keep], after[go]])
        place = np.concatenate([place[keep], after[go]])
        low = np.concatenate([low[keep], np.zeros(go.sum(), np.int64)])
        high = np.concatenate([high[keep], np.full(go.sum(), n, np.int64)])
    return mask


def _search(window: int):
    def flush(rows):
        words, n, nw = [r[4] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        mask = repeated_windows(words, n, nw, window)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(n, pa.int64()), pa.array(mask)], names=["m", "sh", "n", "mask"])

    @tidy
    def run(batches):
        rows, size, key = [], 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("m", "sh", "n", "nw", "words", "key"))
            for row in zip(*columns, strict=True):
                if row[5] != key and size >= SHARD_WORDS:
                    yield from flush(rows)
                    rows, size = [], 0
                key = row[5]
                rows.append(row)
                size += row[3] + window
        if rows:
            yield from flush(rows)

    return run


def _remove(window: int, keep: int, with_text: bool, schema: pa.Schema):
    @tidy
    def run(batches):
        for batch in batches:
            texts = binary(batch.column(keep)).to_pylist()
            listed = batch.column(keep + 1).to_pylist()
            out: list[list] = [[], [], []]
            for text, found in zip(texts, listed, strict=True):
                words = text.split()
                total = len(words)
                if found:
                    hit = np.zeros(total + 1, np.int64)
                    for x in found:
                        bits = np.flatnonzero(np.int64(x["mask"]) >> np.arange(63) & 1) + x["start"]
                        np.add.at(hit, bits, 1)
                        np.add.at(hit, bits + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(hit[:-1]) == 0)]
                    left = b" ".join(words)
                else:
                    left = text if with_text else b" ".join(words)
                out[0].append(total)
                out[1].append(total - len(words))
                out[2].append(left.decode("utf-8", "replace") if with_text else sha256(left).hexdigest())
            columns = [*(batch.column(i) for i in range(keep)), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema) if schema else pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keep], "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts elsewhere.

    Words are runs without ASCII white space, compared unchanged; windows lie within a document and
    are judged on the input. Returns the columns of ``docs`` but the text (those named like a new
    one, in any case, are replaced; other names are free) and ``n_words, n_removed, kept``: the SHA-256 of the kept words joined by spaces, or
    with ``with_text`` the text itself, joined by spaces where words were removed and unchanged
    otherwise.

    Rows move by content: segments by minimizer, distinct segments to shards, results back by
    segment and row; minimizers, windows and segments that one row in a thousand has are sent to the
    rows instead. A minimizer with more than ``hot_segments`` distinct segments is routed window
    by window, equal windows being added up first, so no shard grows with a frequent passage.

    A null text has no words. Rows are told apart by id and text; repeated rows repeat each other's
    windows. Null ids are allowed, very long texts are hashed in slices, and an empty table gives
    no rows.
    """
    if not 2 * K <= window <= 39:
        raise ValueError("windows of 24 to 39 words are supported: searches are at most 64 words long")
    docs, inner = numbered(docs)
    id_col, text_col = inner[id_col], inner[text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1 = F.xxhash64(text).alias("k1")
    k2 = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text, F.lit(1))).alias("k2")
    keyed = docs.select(k1, k2, text.alias("__text"))
    segments = save(keyed.mapInArrow(_segments(window), "m long, sh long, k1 long, k2 long, start int, nw int"), "segments")
    again = save(segments.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minimizers")
    found = save(spread_join(segments, again, ["m"], [], how="inner"), "repeated")

    distinct = save(found.groupBy("m", "sh").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "start", "nw")).alias("r")), "distinct")
    hot = distinct.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_segments).withColumn("hot", F.lit(True))
    chosen = spread_join(distinct, save(hot, "hot"), ["m"], ["m", "sh"])
    chosen = chosen.select("r.*", "m", "sh", F.col("copies").alias("n"), F.coalesce("hot", F.lit(False)).alias("hot"))
    by_row = chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "nw", "m", "sh", "n", "hot")).alias("listed"))
    once = keyed.join(by_row, ["k1", "k2"]).select("__text", "listed", "k1", "k2")
    units = save(once.mapInArrow(_units(window), UNIT), "units")

    # Rows with equal words give the same units again, as do repeated rows in several tasks; each is searched once.
    plain = units.where("not hot").dropDuplicates(["m", "sh"]).select("key", "m", "sh", "nw", "n", "words")
    hot_units = units.where("hot").select("key", "m", "sh", "off", "n", "words").dropDuplicates(["m", "sh", "off"])
    hot_keys = hot_units.groupBy("key").agg(F.sum("n").alias("n"), F.min("words").alias("words"))
    hot_keys = hot_keys.select("key", F.col("key").alias("m"), F.lit(None).cast("long").alias("sh"), F.lit(1).alias("nw"), "n", "words")
    sharded = plain.unionByName(hot_keys).repartition("key").sortWithinPartitions("key")
    masks = save(sharded.mapInArrow(_search(window), "m long, sh long, n long, mask long").where("mask <> 0"), "masks")
    # A hot window is in n rows, so in no more of the hot units.
    back = spread_join(hot_units.select("key", "m", "sh", "off", F.col("n").alias("copies")), masks.where("sh is null").select(F.col("m").alias("key"), "n"), ["key"], [], how="inner")
    back = back.groupBy("m", "sh").agg(F.max("copies").alias("n"), F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask"))
    masks = save(masks.where("sh is not null").unionByName(back), "masks")

    # Repeated rows share their hits: each is kept once.
    hits = spread_join(found, masks, ["m", "sh"], [], how="inner").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "mask")).alias("hits"))
    rest = {n: c for c, n in inner.items() if n != text_col and c.lower() not in ("n_words", "n_removed", "kept")}
    source = docs.select(*rest, text.alias("text"), k1, k2).join(hits, ["k1", "k2"], "left").select(*rest, "text", "hits")
    made = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
    out = source.mapInArrow(_remove(window, len(rest), with_text, None), StructType([*source.schema.fields[: len(rest)], *made]))
    return out.toDF(*rest.values(), *out.columns[len(rest) :])
