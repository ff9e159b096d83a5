"""Document quality by a byte-level convolutional network, trained and run in numpy.

Bytes are embedded; learned filters look at windows of eight bytes; each filter is max-pooled over
overlapping chunks of 256 bytes that cover the whole document; a hidden layer combines a chunk's
filters, is max-pooled over the chunks, and gives one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import binary, numbered, tidy

#: Bytes a window, from one window to the next, a block, blocks a chunk and from one chunk to the next.
WINDOW, STRIDE, BLOCK, CHUNK, HOP = 8, 4, 64, 4, 3
DIM, FILTERS, HIDDEN = 8, 32, 16
#: The driver fits on at most so many labelled documents, whose texts have at most so many bytes in all.
SAMPLE_DOCS, SAMPLE_BYTES = 2400, 1 << 23
#: Bytes that are convolved at a time.
PART = 1 << 18


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    return {
        "embed": normal(256, DIM, by=0.5), "filters": normal(WINDOW * DIM, FILTERS, by=(WINDOW * DIM) ** -0.5), "bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(FILTERS + 1, HIDDEN, by=FILTERS**-0.5), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, by=0.3), "out_bias": np.zeros(1, np.float32),
    }


def _windows(data: np.ndarray, model: dict) -> np.ndarray:
    """Embedded windows of bytes whose number is a multiple of the block, plus what the last windows need beyond."""
    cells = model["embed"][data].reshape(-1, STRIDE * DIM)
    return np.concatenate([cells[:-1], cells[1:]], axis=1)


def _blocks(data: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each filter in each block, and the window that has it."""
    per = BLOCK // STRIDE
    top, where = [], []
    for i in range(0, len(data) - STRIDE, PART):
        value = _windows(data[i : i + PART + STRIDE], model) @ model["filters"]
        value = value.reshape(-1, per, FILTERS)
        at = value.argmax(axis=1)
        top.append(np.take_along_axis(value, at[:, None, :], axis=1)[:, 0])
        where.append(at + (np.arange(len(at)) * per)[:, None] + i // STRIDE)
    return np.concatenate(top), np.concatenate(where)


def _largest(data: np.ndarray, model: dict) -> np.ndarray:
    per = BLOCK // STRIDE
    return np.concatenate([(_windows(data[i : i + PART + STRIDE], model) @ model["filters"]).reshape(-1, per, FILTERS).max(axis=1) for i in range(0, len(data) - STRIDE, PART)])


def layout(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of each text, and the chunks that cover it: text, blocks of the chunk, share of it that is text.

    A text begins with a cell of zeros, so no window reaches from one text into the next.
    """
    size = size + STRIDE
    blocks = np.maximum(-(-size // BLOCK), 1)
    chunks = np.maximum(-(-(blocks - CHUNK) // HOP), 0) + 1
    of = np.repeat(np.arange(len(size)), chunks)
    n = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = np.minimum(n * HOP, np.maximum(blocks - CHUNK, 0)[of])  # the last chunk ends with the text
    places = np.minimum(start[:, None] + np.arange(CHUNK), blocks[of][:, None] - 1)
    share = np.clip((size[of] - start * BLOCK) / (CHUNK * BLOCK), 0, 1)
    return blocks, of, places, share.astype(np.float32)


def joined(texts: list[bytes], blocks: np.ndarray) -> np.ndarray:
    data = b"".join(bytes(STRIDE) + t.ljust(b * BLOCK - STRIDE, b"\0") for t, b in zip(texts, blocks.tolist(), strict=True))
    return np.frombuffer(data + bytes(STRIDE), np.uint8)


def _head(pooled: np.ndarray, share: np.ndarray, of: np.ndarray, model: dict):
    features = np.concatenate([np.maximum(pooled + model["bias"], 0), share[:, None]], axis=1)
    hidden = np.maximum(features @ model["hidden"] + model["hidden_bias"], 0)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    best = np.maximum.reduceat(hidden, first, axis=0)
    return features, hidden, best, 1 / (1 + np.exp(-(best @ model["out"] + model["out_bias"][0])))


def predict(texts: list[bytes], model: dict) -> np.ndarray:
    """Probability of label 1 for every whole text; long texts take no more memory than their block maxima."""
    blocks, of, places, share = layout(np.fromiter(map(len, texts), np.int64, len(texts)))
    top = _largest(joined(texts, blocks), model)
    begin = np.cumsum(blocks) - blocks
    at = begin[of][:, None] + places
    pooled = top[at[:, 0]]
    for k in range(1, CHUNK):
        np.maximum(pooled, top[at[:, k]], out=pooled)
    return _head(pooled, share, of, model)[3]


def _gradients(texts: list[bytes], label: np.ndarray, weight: np.ndarray, model: dict) -> dict[str, np.ndarray]:
    blocks, of, places, share = layout(np.fromiter(map(len, texts), np.int64, len(texts)))
    data = joined(texts, blocks)
    top, where = _blocks(data, model)
    at = (np.cumsum(blocks) - blocks)[of][:, None] + places
    stacked = top[at]
    choice = stacked.argmax(axis=1)
    pooled = np.take_along_axis(stacked, choice[:, None, :], axis=1)[:, 0]
    window = where[np.take_along_axis(at, choice, axis=1), np.arange(FILTERS)]
    features, hidden, best, p = _head(pooled, share, of, model)
    d = ((p - label) * weight).astype(np.float32)  # of the logit
    grad = {"out": best.T @ d, "out_bias": np.array([d.sum()], np.float32)}
    # The first chunk that has the largest hidden value of its text gets the gradient.
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    is_best = hidden == best[of]
    order = np.where(is_best, np.arange(len(of))[:, None], len(of))
    chosen = np.minimum.reduceat(order, first, axis=0)
    dh = np.zeros_like(hidden)
    np.put_along_axis(dh, chosen, d[:, None] * model["out"][None, :], axis=0)
    dh *= hidden > 0
    used = np.flatnonzero(dh.any(axis=1))
    dh = dh[used]
    grad |= {"hidden": features[used].T @ dh, "hidden_bias": dh.sum(axis=0)}
    df = (dh @ model["hidden"].T)[:, :FILTERS] * (features[used, :FILTERS] > 0)
    grad["bias"] = df.sum(axis=0)
    grad["filters"] = np.zeros_like(model["filters"])
    embed = np.zeros((256, DIM), np.float32)
    for f in range(FILTERS):
        rows = np.flatnonzero(df[:, f])
        g = df[rows, f]
        seen = data[window[used[rows], f][:, None] * STRIDE + np.arange(WINDOW)]
        grad["filters"][:, f] = g @ model["embed"][seen].reshape(len(rows), -1)
        by_place = model["filters"][:, f].reshape(WINDOW, DIM)
        for j in range(WINDOW):
            embed += np.bincount(seen[:, j], g, 256)[:, None].astype(np.float32) * by_place[j]
    grad["embed"] = embed
    return grad


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by Adam on weighted cross-entropy; with one label only the network gives that label's share."""
    model = initial(seed)
    labels = np.asarray(labels, np.float32)
    ones = int(labels.sum())
    if ones in (0, len(labels)):
        model["out"][:] = 0
        model["out_bias"][0] = 6.0 if len(labels) and ones else -6.0 if len(labels) else 0.0
        return model
    rng = np.random.default_rng(seed)
    weight = np.where(labels > 0, 0.5 / ones, 0.5 / (len(labels) - ones)) * len(labels)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    steps, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            grad = _gradients([texts[k] for k in rows], labels[rows], (weight[rows] / len(rows)).astype(np.float32), model)
            steps += 1
            now = rate * min(1.0, steps / 20) * (1 - 0.95 * steps / total)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model[k] -= (now * first[k] / (1 - 0.9**steps) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most_docs: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of a bounded sample: labelled ids in the order of their hashes, at most ``most_docs``, with texts of at most ``most_bytes`` bytes in all.

    Ids are chosen among ``labels`` first; then only the sizes of their texts are asked for, and
    texts are taken in order while they fit into what is left of the bytes, however long they are.
    Repeated label rows count once, and of the rows of an id the smallest text is taken.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("__label")).distinct()
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col, "__label").limit(most_docs)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # at most most_docs rows
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    rows = rows.groupBy(id_col, "__label").agg(F.min(text_col).alias("__text"))
    sizes = rows.select(id_col, "__label", F.xxhash64(id_col).alias("h"), F.coalesce(F.octet_length("__text"), F.lit(0)).alias("bytes")).collect()
    taken, left = [], most_bytes
    for r in sorted(sizes, key=lambda r: (r.h, r[0], r[1])):
        if r.bytes <= left:
            taken.append((r[0], r[1]))
            left -= r.bytes
    taken = docs.sparkSession.createDataFrame(taken, chosen.schema)
    rows = rows.join(F.broadcast(taken), [id_col, "__label"]).select(id_col, "__text", "__label").collect()
    rows.sort(key=lambda r: (r[0], r[2]))
    return [(r[1] or "").encode("utf-8") for r in rows], np.array([r[2] for r in rows], np.int64)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray]:
    """Train on a bounded sample of ``labels(doc_id, label_col)``, see ``labelled_sample``."""
    return train(*labelled_sample(docs, labels, label_col, sample_docs, sample_bytes))


def _score(model, keep: int):
    @tidy
    def run(batches):
        net = model.value
        for batch in batches:
            texts = binary(batch.column(keep)).to_pylist()
            scores = []
            group, size = [], 0
            for k, t in enumerate(texts):
                group.append(t)
                size += len(t) + BLOCK
                if size >= PART or k == len(texts) - 1:
                    scores.append(predict(group, net))
                    group, size = [], 0
            found = np.concatenate(scores).astype(np.float64) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), pa.array(found)], names=[*batch.schema.names[:keep], "score"])

    return run


def score_quality(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """Score every whole text: the columns of ``docs`` and ``score``, the probability of label 1.

    Only the text is read by the network, which is broadcast (some 20 kB). One scan, no shuffle.
    Null and empty texts score as one chunk without bytes; null ids, repeated rows and other columns
    pass unchanged (a column named ``score``, in any case, is replaced). Empty in, empty out.
    """
    docs, inner = numbered(docs)
    rest = {n: c for c, n in inner.items() if c.lower() != "score"}
    source = docs.select(*rest, F.col(inner[text_col]).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = source.mapInArrow(_score(shared, len(rest)), StructType([*source.schema.fields[:-1], StructField("score", DoubleType())]))
    return scored.toDF(*rest.values(), "score")
