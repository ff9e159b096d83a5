"""Lattice hashing against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from cloudframe.llm.lattice import Hash, _clean, decode, embedding_dedup, neighbours
from tests.llm.test_dedup import groups


def test_decode_finds_the_nearest_lattice_point():
    x = np.random.default_rng(1).normal(size=(500, 8)) * 1.3
    d = decode(x)
    assert len(neighbours()) == 240 and np.allclose((neighbours() ** 2).sum(axis=1), 2)
    assert (np.rint(2 * d) == 2 * d).all() and (d.sum(axis=1) % 2 == 0).all()
    for s in neighbours():
        assert (((x - d) ** 2).sum(axis=1) <= ((x - d - s) ** 2).sum(axis=1) + 1e-9).all()


def sample():
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=64)
        rows += [(centre + rng.normal(size=64) * rng.uniform(0.05, 0.3)).astype(np.float32) for _ in range(rng.integers(2, 30))]
    rows += list(rng.normal(size=(150, 64)).astype(np.float32))
    rows += [rows[3], rows[3] * np.float32(2), np.zeros(64, np.float32)]
    nan = rows[5].copy()
    nan[4] = np.nan
    out = [r.tolist() for r in [*rows, nan]]
    return [*out, None, [], [None, *out[0][1:]], [1e30] * 64, [1.0] * 64, [1.0, 2.0], [2.0, 4.0]]


@pytest.mark.parametrize("block", [1024, 8])
def test_links(spark, block):
    data = sample()
    # component_id and label clash with the results or are ignored
    table = spark.createDataFrame([(k, v, 1, k) for k, v in enumerate(data)], "vec_id long, embedding array<float>, label int, component_id long").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup(table, block=block).collect()}
    assert len(got) == len(data)
    links, close, shown = [], 0, 0
    good = {k: np.array(v, float) for k, v in enumerate(data) if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {k: v / np.linalg.norm(v) for k, v in good.items()}
    degree = dict.fromkeys(range(len(data)), 0)
    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links.append((a, b))
                degree[a] += 1
                degree[b] += 1
    want = groups(range(len(data)), links)
    found = sum(got[k].n_links for k in degree)
    assert all(got[k].n_links <= n for k, n in degree.items()) and found >= 0.97 * sum(degree.values())
    for a, b in links:
        close += 1
        shown += got[a].component_id == got[b].component_id
    assert shown >= 0.97 * close
    for k in range(len(data)):
        assert want[got[k].component_id] == want[k] and got[k].kept == (got[k].component_id == k)


def test_null_ids_and_repeated_rows(spark):
    v = [1.0] * 16
    rows = [(None, v), (4, v), (4, v), (6, [x * 3 for x in v]), (8, None)]
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (4, 1, 4, True), (4, 1, 4, True), (6, 1, 4, False), (8, 0, 8, True)]
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("cosine,least", [(0.901, 0.95), (0.91, 0.97), (0.92, 0.98), (0.95, 0.995)])
def test_isolated_pairs_meet_in_a_cell(cosine, least):
    rng = np.random.default_rng(5)
    h = Hash(64, 6, 3.0, 3, 88)  # as embedding_dedup makes it
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = h.keys(x), h.keys(y)
    meets = [bool(set(p[:, 0]) & set(q.ravel()) or set(q[:, 0]) & set(p.ravel())) for p, q in zip(a, b, strict=True)]
    assert np.mean(meets) >= least


def test_clean_keeps_stored_components():
    rows = [[1.5, -0.0], None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [2.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(rows, pa.list_(pa.float64()))], names=["vec_id", "v"])
    for start in (0, 3):
        out = pa.Table.from_batches(_clean("<f4")(iter([batch.slice(start)]))).column("vec").to_pylist()
        want = [np.array(v, "<f4").tobytes() if k in (0, 7) else None for k, v in enumerate([[1.5, 0.0], *[[0]] * 6, [2.0]])]
        assert out == want[start:]


def test_links_over_batches_and_large_groups(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    data = [(centre + rng.normal(size=32) * 0.25).tolist() for _ in range(700)] + [(centre * -1 + rng.normal(size=32) * 0.25).tolist() for _ in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>").repartition(3), block=512).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = np.array(data) / np.linalg.norm(data, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert sum(got[k].n_links for k in got) >= 0.99 * want.sum() and all(got[k].n_links <= want[k] for k in got)
