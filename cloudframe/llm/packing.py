"""Sequence packing by non-negative least squares over length combinations."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, by_bytes, save, tidy
from .tokens import encode_ids


def combinations_filling(window: int) -> np.ndarray:
    """All multisets of one to three lengths that fill the window exactly, one a row, padded with zeros."""
    one = np.array([[window, 0, 0]])
    half = np.arange(1, window // 2 + 1)
    two = np.stack([half, window - half, np.zeros_like(half)], axis=1)
    a = np.arange(1, window // 3 + 1)
    b, c = np.meshgrid(a, np.arange(1, window + 1), indexing="ij")
    third = window - b - c
    ok = (c >= b) & (third >= c)
    return np.concatenate([one, two, np.stack([b[ok], c[ok], third[ok]], axis=1)])


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 of the combinations whose lengths come nearest to the histogram.

    Accelerated projected gradient; A has at most three entries a column, so A x is a bincount and
    A'r three gathers. Length zero (padding of a short row) is left out of the fit.
    """
    target = histogram.astype(float)
    weight = np.ones_like(target)
    weight[0] = 0.0

    def apply(x):
        return sum(np.bincount(combos[:, k], x, len(target)) for k in range(3)) * weight

    def adjoint(r):
        r = r * weight
        return r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]

    v = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue of A'A
        v = adjoint(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - adjoint(apply(y) - target) / top, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence, how often) that use up ``histogram[length]`` pieces of every length.

    The fitted repeats are rounded, largest first, within what is left of each length; the residual
    is packed greedily, longest piece first, each gap with the longest piece that fits. Work and
    result depend on the window, not on the number of pieces.
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            left[n] -= times
        out.append((lengths, times))

    if left[window]:
        take((window,), int(left[window]))
    if left.any():
        combos = combinations_filling(window)
        x = repeat_counts(combos, left)
        for k in np.argsort(-x, kind="stable")[: int((x >= 0.5).sum())]:
            lengths = tuple(int(n) for n in combos[k] if n)
            times = min(round(float(x[k])), *(int(left[n]) // lengths.count(n) for n in lengths))
            if times > 0:
                take(lengths, times)
    while left.any():
        lengths, gap = [], window
        while gap:
            fits = np.flatnonzero(left[1 : gap + 1] > 0)
            fits = [n for n in (fits[::-1] + 1).tolist() if left[n] > lengths.count(n)] if len(fits) else []
            if not fits:
                break
            lengths.append(fits[0])
            gap -= fits[0]
        take(tuple(lengths), min(int(left[n]) // lengths.count(n) for n in set(lengths)))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]], window: int) -> list[np.ndarray]:
    """For each length the places of its pieces: rows of (first rank, first sequence, offset), by rank."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(window + 1)]
    rank = [0] * (window + 1)
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            found[n].append((rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return [np.array(x, np.int64).reshape(-1, 3) for x in found]


def _pieces(path: str, window: int, end_id: int, with_ids: bool, schema: pa.Schema):
    @tidy
    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in by_bytes(batches, 1):
            texts, keys = binary(batch.column(1)), batch.column(0)
            rows: dict[str, list] = {name: [] for name in schema.names}
            source = []
            for k, text in enumerate(texts.to_pylist()):
                ids = encode_ids(text.decode("utf-8", "replace"), path) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    n = len(piece) // 4
                    source.append(k)
                    for name, value in (("start", start), ("length", n), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", total), ("__part", part), ("__rank", int(seen[n]))):
                        rows[name].append(value)
                    if with_ids:
                        rows["ids"].append(np.frombuffer(piece, "<u4").astype(np.int32))
                    seen[n] += 1
            rows.pop(schema.names[0])
            first = keys.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([first, *(pa.array(v, schema.field(c).type) for c, v in rows.items())], schema=schema)

    return run


def _place(table, keep: list[str]):
    @tidy
    def run(batches):
        where = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__at").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows, m = where[n], length == n
                slot = rows[np.searchsorted(rows[:, 0], rank[m], "right") - 1]
                sequence[m], offset[m] = slot[:, 1] + rank[m] - slot[:, 0], slot[:, 2]
            columns = [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the tokens of all documents into sequences of at most ``window`` tokens.

    A document is its ids by the tokenizers file at ``path`` and then ``end_id``. It is cut into
    pieces of the window's length and one rest; rests are combined by a non-negative least squares
    fit over all combinations of up to three lengths that fill a window. Returns a row per piece:
    ``id_col, start`` (ids before it), ``length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    with ``with_ids``, ``ids`` (array of int).

    Pieces are written once to the shared folder, each with its task and its rank among the task's
    pieces of that length; a sum over tasks makes ranks global without bringing a length's pieces
    together. The driver sees the histogram only: one number for each length up to the window.

    A null or empty text is the end id alone. Null ids and repeated rows are packed like others;
    other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    names = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("__part", pa.int32()), ("__rank", pa.int64())]
    names += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema([(id_col, to_arrow_type(kind)), *names])
    ddl = f"`{id_col}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, __part int, __rank long" + ", ids array<int>" * with_ids
    pieces = save(docs.select(id_col, text_col).mapInArrow(_pieces(path, window, end_id, with_ids, schema), ddl), "pieces")

    counts = pieces.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():  # at most one row for each length
        histogram[n] = c
    where = spark.sparkContext.broadcast(slots(plan(histogram, window), window))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    ranked = pieces.join(starts, ["__part", "length"]).withColumn("__at", F.col("__rank") + F.col("__before"))
    keep = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    types = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in keep)
    return ranked.select(*keep, "__at").mapInArrow(_place(where, keep), f"{types}, sequence_id long, offset long")
